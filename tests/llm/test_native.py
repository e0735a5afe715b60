"""Fingerprints and shards: DataFrame functions alone, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import fingerprints, queries, sharding, splitters

from ..conftest import SMALL


def bag(text):
    return Counter(w for w in re.split(r"[\W_]+", text.lower()) if w)


def jaccard(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 1.0


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_query_2(spark):
    df = queries.op2_weighted_fingerprints(spark, SMALL)
    assert no_python(df)
    got = {r["doc_id"]: r for r in df.collect()}
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"]))
    ids = sorted(texts)
    assert sorted(got) == ids
    off = []
    for i, j in zip(ids, ids[1:] + ids[:1]):
        n = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - n] + texts[j][:n]
        assert got[i]["n_chars"] == len(texts[i]) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off += [got[i]["near_edited"] - jaccard(bag(texts[i]), bag(edited)), got[i]["near_next"] - jaccard(bag(texts[i]), bag(texts[j]))]
    assert np.sqrt(np.mean(np.square(off))) < 0.1 and abs(np.mean(off)) < 0.03
    by_text = defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(got[i]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


@pytest.mark.parametrize("shared", [2, 10, 18])
def test_collision_rate_is_generalised_jaccard(spark, shared):
    r = np.random.default_rng(shared)
    weights = {f"w{i}": int(r.integers(1, 9)) for i in range(40)}
    a = {f"w{i}": weights[f"w{i}"] for i in range(20)}
    b = {f"w{i}": max(1, weights[f"w{i}"] + int(r.integers(-2, 3))) for i in range(20 - shared, 40 - shared)}
    texts = spark.createDataFrame([(i, " ".join(w for w, n in x.items() for _ in range(n))) for i, x in enumerate((a, b))], "k int, text string")
    x, y = (np.array(s["samples"]) for s in fingerprints.fingerprints(texts, ["k"], 400).orderBy("k").collect())
    assert abs((x == y).mean() - jaccard(Counter(a), Counter(b))) < 0.08


def test_fingerprints_of_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = {r["doc_id"]: r for r in fingerprints.edited_with_next(docs).collect()}
    assert sorted(got) == list(range(10))
    assert got[9]["n_chars"] == len("same id") and got[9]["next_id"] == 0 and got[0]["next_id"] == 1
    assert got[0]["samples"] is None and got[3]["samples"] == got[4]["samples"]
    n = len("same id") // 2
    assert got[9]["edited_sha256"] == hashlib.sha256("same id"[: 7 - n].encode()).hexdigest()
    assert got[5]["n_chars"] == len(dict(odd_rows)[5])
    alone = fingerprints.edited_with_next(docs.where("doc_id = 3")).collect()
    assert alone[0]["next_id"] == 3 and alone[0]["edited_samples"] is not None
    assert fingerprints.edited_with_next(docs.limit(0)).count() == 0


def test_likeness_of_nothing(spark):
    df = spark.createDataFrame([(None, None), ([1], None), ([1, 2], [1, 3])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]


def sharded_rightly(rows, sizes, count=40):
    by = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < count
        by[r["shard"]].append(r)
    for held in by.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    mean, largest = sum(sizes) / count, max(sizes)
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    assert all(abs(sum(r["size"] for r in by[s]) - mean) <= largest for s in range(count))


def test_query_6(spark):
    df = queries.op6_sampled_splitters(spark, SMALL)
    assert no_python(df)
    rows = df.collect()
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"]))
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    sharded_rightly(rows, [len((x or "").encode()) + 16 for x in texts.values()])


def test_shards_of_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = sharding.shards(docs, 5).collect()
    sharded_rightly(rows, [len((x or "").encode()) + 16 for _, x in odd_rows], 5)
    assert sharding.shards(docs.limit(0)).count() == 0


def test_one_text_in_most_rows(make_docs, prose):
    """A hot group is cut by doc_id; copies lie side by side."""
    texts = ["the very same text"] * 2000 + prose(300)
    rows = sharding.shards(make_docs(list(enumerate(texts)))).collect()
    sharded_rightly(rows, [len(x) + 16 for x in texts])
    shards = sorted({r["shard"] for r in rows if r["doc_id"] < 2000})
    assert shards == list(range(shards[0], shards[-1] + 1))


def test_splitters_balance_and_subdivide(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, F.lit(7)).otherwise(F.col("id")).alias("key"), F.col("id").alias("tie"))
    found = splitters.splitters_of(rows, F.lit(1), 50)
    got = [r["count"] for r in rows.groupBy(splitters.range_of(F.col("key"), F.col("tie"), found).alias("r")).count().collect()]
    assert max(got) <= 2 * 20_000 / 50 and sum(got) == 20_000
    assert found == sorted(set(found))
    assert splitters.splitters_of(rows.limit(0), F.lit(1), 50) == []
