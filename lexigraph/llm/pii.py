"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in a whole text: at-signs, plus signs, digits, URL schemes and cues of account
numbers. A parser for each kind expands an anchor to both sides as far as its grammar goes and validates the result.
Anchors are taken in order and a kind's spans never overlap, so base kinds give what a leftmost scan of their grammar
gives: email, ip (parts at most 255), card (16 to 19 digits passing Luhn), phone (8 to 15 digits).
Added kinds: url (a scheme with user information), account (an IBAN that passes its check, or 6 to 20 digits after a cue).

Null and empty texts have no spans. Repeated rows give one result each. Offsets count code points, the end exclusive.
Columns other than doc_id and text are carried by ``redacted`` and not read otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"[ ().0-9-]*")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>|]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"[\s:#=.\-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|[0-9]{6,20})(?![0-9A-Za-z])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def iban(text: str) -> bool:
    packed = text.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


class Finder:
    def __init__(self) -> None:
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for i in range(10):
            self.anchors.add_word(str(i), ("digit", 1))
        self.anchors.add_word("@", ("at", 1))
        self.anchors.add_word("+", ("plus", 1))
        self.anchors.add_word("://", ("scheme", 3))
        for cue in CUES:
            for spelled in {cue, cue.upper(), cue.capitalize()}:
                self.anchors.add_word(spelled, ("cue", len(spelled)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """All valid spans, by kind as in KINDS, then by start."""
        out: dict[str, list[Span]] = {k: [] for k in KINDS}
        done = dict.fromkeys(("email", "dotted", "digits", "phone", "url", "account"), 0)
        for last, (kind, size) in self.anchors.iter(text):
            at = last - size + 1
            if kind == "digit":
                if at >= done["dotted"]:
                    done["dotted"] = self._dotted(text, at, out["ip"])
                if at >= done["digits"]:
                    done["digits"] = self._digits(text, at, out["card"])
            elif kind == "at":
                if at >= done["email"]:
                    done["email"] = self._email(text, at, done["email"], out["email"])
            elif kind == "plus":
                if at >= done["phone"]:
                    done["phone"] = self._phone(text, at, out["phone"])
            elif kind == "scheme":
                if at >= done["url"]:
                    done["url"] = self._url(text, at, done["url"], out["url"])
            elif at >= done["account"]:
                done["account"] = self._account(text, at, last + 1, out["account"])
        return [s for k in KINDS for s in out[k]]

    @staticmethod
    def _email(text: str, at: int, floor: int, out: list[Span]) -> int:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start == at or not (domain := _DOMAIN.match(text, at + 1)):
            return floor
        out.append(("email", start, domain.end()))
        return domain.end()

    @staticmethod
    def _dotted(text: str, at: int, out: list[Span]) -> int:
        """Groups of four of the numbers that single dots join; a number begins at its first digit."""
        chain = _DOTTED.match(text, at)
        if "." in chain[0]:
            parts, where = chain[0].split("."), at
            for i in range(0, len(parts) - len(parts) % 4, 4):
                four = parts[i : i + 4]
                end = where + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                    out.append(("ip", where, end))
                where = end + 1
        return chain.end()

    @staticmethod
    def _digits(text: str, at: int, out: list[Span]) -> int:
        run = _DIGITS.match(text, at)
        digits = run[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", at, run.end()))
        return run.end()

    @staticmethod
    def _phone(text: str, at: int, out: list[Span]) -> int:
        if not ("0" <= text[at + 1 : at + 2] <= "9"):
            return at
        run = _PHONE.match(text, at + 2)[0]
        kept = run.rstrip(" ().-")
        if len(kept) < 2:
            return at
        end = at + 2 + len(kept)
        if 8 <= sum("0" <= c <= "9" for c in text[at + 1 : end]) <= 15:
            out.append(("phone", at, end))
        return end

    @staticmethod
    def _url(text: str, at: int, floor: int, out: list[Span]) -> int:
        start = at
        while start > floor and (text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        host = _AUTHORITY.match(text, at + 3)
        name, found, _ = host[0].rpartition("@")
        if start == at or not found or not name.strip(":"):
            return floor
        out.append(("url", start, host.end()))
        return host.end()

    @staticmethod
    def _account(text: str, at: int, end: int, out: list[Span]) -> int:
        number = _NUMBER.match(text, end)
        if not number:
            return end
        if number[1][:2].isalpha():
            short = _IBAN.match(number[1])[0]
            while len(short) > 14 and not iban(short):
                short = short[:-1].rstrip()
            if len(short) <= 14:
                return end
            out.append(("account", number.start(1), number.start(1) + len(short)))
        else:
            out.append(("account", number.start(1), number.end(1)))
        return number.end()


_finder: list[Finder] = []


def finder() -> Finder:
    if not _finder:
        _finder.append(Finder())
    return _finder[0]


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one, named by the longest) replaced by <KIND>."""
    out, at = [], 0
    for kind, start, end in _merged(spans):
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def _merged(spans: list[Span]) -> list[Span]:
    out: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if out and start < out[-1][2]:
            if end - start > out[-1][3]:
                out[-1][0], out[-1][3] = kind, end - start
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([kind, start, end, end - start])
    return [(k, s, e) for k, s, e, _ in out]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end>>) for every row, in the order of KINDS, then by start."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder().spans
        for batch in slices(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of their text masked; a null text stays null."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder().spans
        for batch in slices(batches):
            texts = [t and (masked(t, s) if (s := spans(t)) else t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
