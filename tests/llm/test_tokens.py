"""Encoding, decoding and packing against the tokenizer library itself."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lexigraph.llm import bpe, packing, queries

from ..conftest import SMALL

PATH = public_tokenizers.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_every_letter_that_is_split_here(library):
    c = bpe.Coder(PATH)
    texts = [f"a{chr(i)}b {chr(i)} {chr(i)}'s Q{chr(i)}, '{chr(i)}" for i in range(0x260)] + ["don't I'LL we'Re x''s 'S ''ve 12.5|a,b c! d; e", "<| |> <|endoftext|>", "İ ss ẞ"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert c.encode_all([text])[0].tolist() == want.ids, text
    assert [x.tolist() for x in c.encode_all(texts)] == [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]


def test_every_known_letter_is_split_as_the_library_does(library, monkeypatch):
    """All code points, each between letters, alone, doubled and after an apostrophe; the library is asked for no text."""
    c = bpe.Coder(PATH)
    known = np.flatnonzero(c.kinds != 4).tolist()
    texts = ["".join(f"a{chr(i)}b {chr(i)} !{chr(i)}{chr(i)}'{chr(i)}s " for i in known[k : k + 64] if not 0xD800 <= i <= 0xDFFF) for k in range(0, len(known), 64)]
    texts = [t for k, t in enumerate(texts) if t and (known[64 * k] < 0x3400 or known[64 * k] > 0xD7FF and known[64 * k] < 0x20000 or k % 16 == 0)]
    want = [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(c, "library", None)
    assert [x.tolist() for x in c.encode_all(texts)] == want


def test_texts_of_many_scripts(library, monkeypatch):
    c, r = bpe.Coder(PATH), np.random.default_rng(0)
    pools = ["“”‘’–—…• ", "привет мир ёЁЙ", "日本語テキスト。", "😀👩\u200d👧🇩🇪", "ΣΑΣ ς σΣ", "e\u0301a\u0308 o\u0302\u0323", "한국어 \u1112\u1161\u11ab", "عربى ١٢٣", "don't I'LL ’s 'Ve", "½²Ⅷ 12.5", "\x1c\x1f\x85\u2028\u3000\u180e", "İıſẞǅ"]
    letters = [list(p) for p in pools]
    texts = ["".join(r.choice(letters[r.integers(len(pools))] + [" ", "a", "B"], 12).tolist()[0] if r.random() < 0.3 else "".join(r.choice(letters[r.integers(len(pools))], r.integers(1, 6)).tolist()) for _ in range(60)) for _ in range(400)] + pools
    want = [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(c, "library", None)
    assert [x.tolist() for x in c.encode_all(texts)] == want


def test_words_that_collide_in_polynomial_hashes(library):
    """Thue-Morse words and their mirrors agree in every polynomial modulo a power of two from some length on."""
    c, word = bpe.Coder(PATH), "ab"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        mirror = word.translate(str.maketrans("ab", "ba"))
        assert [x.tolist() for x in c.encode_all([word, mirror, f"{word} {mirror}"])] == [w.ids for w in library.encode_batch([word, mirror, f"{word} {mirror}"], add_special_tokens=False)]


def test_long_runs_and_files_with_other_rules(library, monkeypatch):
    texts = ["x1" * 3000 + " " + "y" * 900, "é" * 2500, "q " * 2000, "ab" * 700 + "'s"]
    want = [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "BLOCK", 300)
    monkeypatch.setattr(bpe, "LONGEST", 1000)
    c = bpe.Coder(PATH)
    assert c.splits and [x.tolist() for x in c.encode_all(texts)] == want
    c.splits = False
    assert [x.tolist() for x in c.encode_all(texts)] == want


def test_table_is_bounded_and_right_when_full(library, monkeypatch, prose):
    monkeypatch.setattr(bpe, "HELD_IDS", 50)
    monkeypatch.setattr(bpe, "SLOTS", 1 << 4)
    monkeypatch.setattr(bpe, "BLOCK", 500)
    c = bpe.Coder(PATH)
    texts = prose(20) * 2
    assert [x.tolist() for x in c.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(c.first) == 16 and c.held <= 50 + 4 * 1000


def test_roundtrip_of_odd_rows(spark, make_docs, odd_rows, library):
    docs = make_docs(odd_rows)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    texts = defaultdict(list)
    for i, t in odd_rows:
        texts[i].append(t or "")
    assert len(got) == len(odd_rows)
    for r in got:
        want = [library.encode(t, add_special_tokens=False).ids for t in texts[r["doc_id"]]]
        assert r["ids"] in want and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_query_7(spark, library):
    got = {r["doc_id"]: r for r in queries.op7_bpe_roundtrip(spark, SMALL).collect()}
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    for i, text in zip(t["doc_id"], t["text"]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def packed_rightly(rows, texts, library, length=4096):
    """Every id lies in one piece, sequences are gapless and no longer than allowed; returns their sizes."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        todo = [np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in texts[i]]
        assert sum(p["length"] for p in pieces) == sum(map(len, todo))
        if len(todo) == 1 or all((x == todo[0]).all() for x in todo if len(x) == len(todo[0])) and len({*map(len, todo)}) == 1:
            at = defaultdict(int)
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["doc_tokens"] == len(todo[0]) and p["length"] > 0
                assert p["ids_crc32"] == zlib.crc32(todo[0][p["start"] : p["start"] + p["length"]].tobytes())
                at[p["start"]] += 1
            assert sum(p["length"] for p in pieces) == len(todo[0]) * len(todo)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
    return {s: sum(p["length"] for p in pieces) for s, pieces in by_sequence.items()}


def test_packing_odd_rows(spark, make_docs, odd_rows, library):
    texts = defaultdict(list)
    for i, t in odd_rows:
        texts[i].append(t)
    packed_rightly(packing.pack(make_docs(odd_rows), PATH).collect(), texts, library)
    assert packing.pack(make_docs(odd_rows).limit(0), PATH).count() == 0


def test_query_8(spark, library):
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    sizes = packed_rightly(queries.op8_hilbert_packing(spark, SMALL).collect(), {i: [x] for i, x in zip(t["doc_id"], t["text"])}, library)
    assert sum(sizes.values()) / (len(sizes) * 4096) > 0.97


def test_neighbours_share_sequences(spark, make_docs, prose):
    a, b = prose(40, seed=1), [" ".join(str(len(w) * 37 + ord(w[0])) for w in t.split()) for t in prose(40, seed=2)]
    rows = packing.pack(make_docs([(i, x) for i, x in enumerate([y for p in zip(a, b) for y in p])]), PATH).collect()
    kinds = defaultdict(list)
    for r in rows:
        kinds[r["sequence_id"]].append(r["doc_id"] % 2)
    alike = sum(max(k.count(0), k.count(1)) for k in kinds.values()) / len(rows)
    assert alike > 0.8


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3)])
def test_hilbert_steps_to_neighbours(dimensions, bits):
    grid = np.stack(np.meshgrid(*[range(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    key = packing.hilbert(grid, bits)
    assert sorted(key) == list(range(len(grid))) and np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1).max() == 1
