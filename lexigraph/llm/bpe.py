"""BPE encoding and decoding through a table of distinct words.

Texts are split into words; each distinct word is encoded once and kept in a bounded table; a document's ids are the
table's entries joined back by position. Decoding joins ids to their pieces. The table lives in the Arrow task (and
outlives it in a reused worker): a table shared by all tasks would need every occurrence of every word shuffled to it
and back, several times the size of the texts.

Splitting, hashing and joining work on arrays of code points of many texts at once. A word is known by two sums of its
code points times random 64-bit keys by place, drawn anew in each process: no text can be made so that two of its words
agree in both. Texts that hold a special token, code points that Python's Unicode tables do not know, or runs of more
than BLOCK + LONGEST code points without white space go through the library, as do all texts for a file with other normalisers or split rules; so
results are the library's in every case.

Null texts are empty texts, and an empty text has no ids. Repeated rows and doc_ids give one result each. Columns
other than the two named are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, slices

# The normalisers and the split rule of the tokenizer files that are split here.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space ends a part of a long text.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Texts with code points from here on may change by composition.
COMPOSED = re.compile("[\u0300-\U0010ffff]")
#: Characters that are split at once; slots of the word table, and ids that it holds before it is emptied.
BLOCK, SLOTS, HELD_IDS = 1 << 18, 1 << 21, 8_000_000
#: Code points beyond BLOCK up to which a part of a text without white space is split here.
LONGEST = 1 << 18
_LETTER, _NUMBER, _OTHER, _UNKNOWN = 1, 2, 3, 4

_coders: dict[str, "Coder"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def kinds() -> np.ndarray:
    """White space 0, letter, number, other or unknown, for every code point."""
    by_name = {"L": _LETTER, "N": _NUMBER, "Z": 0}
    out = np.array([_UNKNOWN if c == "Cn" else by_name.get(c[0], _OTHER) for c in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8)
    out[[*range(9, 14), 0x85]] = 0
    return out


def normalised(text: str) -> str:
    """Composed and in lower case, letter by letter: a sigma that ends a word is like any other."""
    if not text.isascii() and COMPOSED.search(text):
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
    return text.lower()


def pieces(kind: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text: runs of letters, single numbers, runs of others, and contractions, which
    take "'" (alone) and s, t, m, d, re, ve or ll from what follows."""
    edge = np.empty(len(kind) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[:-1] |= kind == _NUMBER
    if "'" in text:
        for m in re.finditer("'(?:[stmd]|re|ve|ll)", text):
            at = m.start()
            if edge[at] and edge[at + 1]:
                edge[at + 1] = False
                edge[m.end()] = True
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    words = kind[starts] != 0
    return starts[words], ends[words]


def splits_here(file: dict) -> bool:
    """Whether a tokenizer file has the normalisers and the split rule that ``pieces`` follows."""
    normalisers = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
    rules = [(p.get("pattern") or {}).get("Regex") for p in (file.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
    return file["model"]["type"] == "BPE" and normalisers == NORMALISERS and rules == [SPLIT]


class Coder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.letters, self.kinds = self.library.model, byte_letters(), kinds()
        self.splits, self.special = splits_here(json.loads(self.library.to_str())), [t.content for t in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.pieces = np.array([self.library.id_to_token(i) or "" for i in range(size)], dtype=object)
        self.keys = np.random.default_rng().integers(0, 1 << 64, (2, BLOCK + LONGEST + 1), np.uint64)
        self.first, self.second = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at, self.size = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.flat, self.held = np.zeros(1 << 16, self.dtype), 0

    def _hashes(self, points: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        if not len(starts):
            return [np.zeros(0, np.uint64)] * 2
        origin = np.zeros(len(points), np.int32)
        origin[starts] = starts
        place = np.minimum(np.arange(len(points), dtype=np.int32) - np.maximum.accumulate(origin), BLOCK + LONGEST)
        valued = (points + np.uint32(1)).astype(np.uint64) * (kind > 0)
        first, second = (np.add.reduceat(valued * keys[place], starts) for keys in self.keys)
        return [first | np.uint64(1), second]

    def _learn(self, words: list[str], slots: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words and puts them into their slots; returns where their ids are and how many."""
        tokenize, letters = self.model.tokenize, self.letters
        ids = [[t.id for t in tokenize(w if w.isascii() and w.isalpha() else "".join([letters[b] for b in w.encode()]))] for w in words]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        at = self.held + np.cumsum(size) - size
        more = int(size.sum())
        if self.held + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), more), self.dtype)])
        self.flat[self.held : self.held + more] = np.fromiter(chain.from_iterable(ids), self.dtype, more)
        self.held += more
        self.first[slots], self.second[slots], self.at[slots], self.size[slots] = first, second, at, size
        return at, size

    def _block(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a normalised text, the starts of its words and how many ids each has."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kinds[points]
        starts, ends = pieces(kind, text)
        first, second = self._hashes(points, kind, starts)
        slots = (first >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        if self.held > HELD_IDS:
            self.first[:], self.held = 0, 0
        at, size = self.at[slots], self.size[slots]
        missing = np.flatnonzero((self.first[slots] != first) | (self.second[slots] != second))
        if len(missing):
            order = missing[np.lexsort((second[missing], first[missing]))]
            fresh = np.concatenate(([True], (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])))
            new, back = order[fresh], np.cumsum(fresh) - 1
            missing = order
            words = [text[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist())]
            places, sizes = self._learn(words, slots[new], first[new], second[new])
            at[missing], size[missing] = places[back], sizes[back]
        ids_at = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.flat[ids_at], starts, size

    def _known(self, text: str) -> bool:
        """Whether all code points have a kind; the check is cheap for the common ones."""
        return text.isascii() or not COMPOSED.search(text) or not (self.kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == _UNKNOWN).any()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as integers of ``dtype``."""
        out: list[np.ndarray | None] = [None] * len(texts)
        parts: list[tuple[int, str]] = []
        whole = lambda text: np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, self.dtype)
            elif not self.splits or any(map(text.__contains__, self.special)) or not self._known(text):
                out[i] = whole(text)
            else:
                low, start, own = normalised(text), 0, []
                while len(low) - start > BLOCK and (gap := SPACE.search(low, start + BLOCK)) and gap.start() - start <= BLOCK + LONGEST:
                    own.append((i, low[start : gap.start()]))
                    start = gap.end()
                if len(low) - start > BLOCK + LONGEST:
                    out[i] = whole(text)
                else:
                    parts += [*own, (i, low[start:])]
        found: dict[int, list[np.ndarray]] = {}
        group: list[tuple[int, str]] = []
        held = 0
        for k, part in enumerate(parts):
            group.append(part)
            held += len(part[1])
            if held >= BLOCK or k + 1 == len(parts):
                ids, starts, size = self._block("\n".join([p for _, p in group]))
                after = np.cumsum([len(p) + 1 for _, p in group])
                cuts = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, after)]
                for (i, _), own in zip(group, np.split(ids, cuts[:-1])):
                    found.setdefault(i, []).append(own)
                group, held = [], 0
        for i, own in found.items():
            out[i] = own[0] if len(own) == 1 else np.concatenate(own)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined by one space, as the library does for a file without a decoder."""
        if self.library.decoder is not None:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(self.pieces[ids].tolist())


def coder(path: str) -> Coder:
    """One coder for each worker process and file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches):
            parts = c.encode_all(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, parts)])
            ids = np.concatenate(parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Adds decoded string to rows (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                most = at
                held = 0
                while most < whole.num_rows and held < SLICE_CHARS // 4:
                    held += len(whole.column(1)[most])
                    most += 1
                batch, at = whole.slice(at, most - at), most
                ids = batch.column(1)
                flat, ends = ids.flatten().to_numpy(), np.cumsum([0, *(pc.list_value_length(ids).to_pylist())])
                texts = [c.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
