import hashlib
import re

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigraph.llm import pii, queries

from ..conftest import SMALL

GRAMMAR = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


VALID = {
    "email": lambda s: True,
    "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 16 <= len(d := re.sub("[ -]", "", s)) <= 19 and plain_luhn(d),
    "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15,
}


def plain(text):
    return [(k, m.start(), m.end()) for k, p in GRAMMAR.items() for m in re.finditer(p, text) if VALID[k](m[0])]


def base(text):
    return [s for s in pii.finder().spans(text) if s[0] in pii.BASE]


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="0123456789..  --++@@()aZ_%é\n:/", max_size=60))
def test_base_kinds_are_a_leftmost_scan(text):
    assert base(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "a@b.c", "x.y+z@q-r.s.t", "+1 (706) 555-3138", "+49 30", "@", ".", " ", "0", "é", "+", "😀", "4644348398010899"]), max_size=12))
def test_pieces_of_personal_data(parts):
    assert base("".join(parts)) == plain("".join(parts))


def test_added_kinds():
    text = "see https://user:pw@host.example/x and iban: DE89 3704 0044 0532 0130 00, Account no 1; account 12345678. IBAN DE89370400440532013001"
    kinds = [(k, text[a:b]) for k, a, b in pii.finder().spans(text) if k not in pii.BASE]
    assert kinds == [("url", "https://user:pw@host.example"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]
    assert not [s for s in pii.finder().spans("https://host/a b://c the account of 99 days") if s[0] not in pii.BASE]


def test_masking():
    text = "Mail a@b.cd or http://u:p@h.i.j/, call +1 (706) 555-3138!"
    assert pii.masked(text, pii.finder().spans(text)) == "Mail <EMAIL> or <URL>/, call <PHONE>!"
    assert pii.masked("none", []) == "none"


def test_query_4(spark):
    got = {r["doc_id"]: r for r in queries.op4_pii_anchors(spark, SMALL).collect()}
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    assert len(got) == len(t["doc_id"])
    for i, text in zip(t["doc_id"], t["text"]):
        want = plain(text or "")
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",")) | {""} - {""}


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs([*odd_rows, (20, "😀 a@b.cd 😀"), (21, "1." * 50_000 + "1"), (22, "9" * 5000), (23, "+" * 1000 + "@" * 1000)])
    got = {r["doc_id"]: r["found"] for r in pii.find(docs).collect()}
    assert got[0] == got[1] == [] and [tuple(s) for s in got[20]] == [("email", 2, 8)] and len(got[21]) == 50_001 // 4 and got[22] == [] and got[23] == []
    masked = pii.redacted(docs)
    assert masked.columns == docs.columns and {r["doc_id"]: r["text"] for r in masked.collect()}[20] == "😀 <EMAIL> 😀"
    assert masked.where("doc_id = 0 AND text IS NULL").count() == 1
    assert pii.find(docs.limit(0)).count() == 0 and pii.redacted(docs.limit(0)).count() == 0
