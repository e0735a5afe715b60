import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import ann, queries

EVERY = "vec_id % 20 = 0"


def brute(ids, x, wanted, k=20):
    out = {}
    for q in wanted:
        s = x @ x[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def check(rows, want, least):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hit = total = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))
        hit += len({f[1] for f in found} & {w[0] for w in want[q]})
        total += len(want[q])
    assert hit >= least * total
    return got


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_10(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").to_pydict()
    ids, x = t["vec_id"], np.array(t["embedding"], float)
    want = brute(ids, x, [i for i in ids if i % 20 == 0])
    got = check(queries.op10_ivfpq_search(spark, f"/root/testdata/{sf}").collect(), want, 0.9)
    for q, found in got.items():
        assert all(s == pytest.approx(x[ids.index(v)] @ x[ids.index(q)], abs=1e-12) for _, v, s in found)


def test_clustered_vectors_and_a_hot_one(spark):
    """A third of the rows are one vector: lists are cut into blocks, ties go by vec_id."""
    r = np.random.default_rng(4)
    x = r.normal(size=(30, 12))[r.integers(0, 30, 6000)] + 0.2 * r.normal(size=(6000, 12))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    old = ann.BLOCK_ROWS, ann.BLOCK_QUERIES
    try:
        ann.BLOCK_ROWS, ann.BLOCK_QUERIES = 500, 40
        rows = ann.search(df, F.expr(EVERY)).collect()
    finally:
        ann.BLOCK_ROWS, ann.BLOCK_QUERIES = old
    check(rows, brute(list(range(6000)), x, range(0, 6000, 20)), 0.9)
    assert [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == 0), key=lambda r: r["rank"])][:3] != [0, 3, 6]


def test_groups_of_near_copies(spark):
    """Codes cannot order the rows of such a group; the exact scores must."""
    for groups, size in ((100, 200),):
        r = np.random.default_rng(groups)
        x = np.repeat(r.normal(size=(groups, 64)), size, 0)
        x /= np.sqrt((x**2).sum(1))[:, None]
        x += 1e-4 * r.normal(size=x.shape)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        rows = ann.search(df, F.expr("vec_id % 200 = 0")).collect()
        check(rows, brute(range(len(x)), x, range(0, len(x), 200)), 0.97)


def test_vectors_of_other_lengths_hide_none(spark):
    """The commonest length takes part, whatever the others are."""
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, [1.0, 2.0, 3.0, 4.0]), (120, [1.0, 2.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.expr(EVERY)).collect()
    check(got, brute(list(range(60)), x, range(0, 60, 20)), 0.9)


def test_clustered_vectors_are_not_scanned(spark, monkeypatch):
    """Where neighbours lie in few lists, few rows are ranked for a query: twenty times the rows, far less than twenty times as many."""
    pairs = []
    for n in (1000, 20_000):
        r = np.random.default_rng(n)
        x = r.normal(size=(n // 50, 24))[r.integers(0, n // 50, n)] * 2 + 0.3 * r.normal(size=(n, 24))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        rows = ann.usable(df)
        index = ann.fit(rows, 20)
        coded = ann.assigned(rows, index).groupBy("list").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()
        index.sizes, index.radii = np.zeros(len(index.coarse), int), np.zeros(len(index.coarse))
        for c in coded:
            index.sizes[c["list"]], index.radii[c["list"]] = c["n"], c["radius"]
        asked = np.arange(0, n, 20)
        lists = index.lists(x[asked], 20)
        lists = index.reachable(x[asked], lists, index.floors(x[asked], asked, lists, 20))
        pairs.append(np.mean([index.sizes[own].sum() for own in lists]))
    assert pairs[1] < 8 * pairs[0] and pairs[1] < 0.1 * 20_000


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [-1.0, 0.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (20, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, rank string, score double")
    got = ann.search(df, F.expr(EVERY)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.5), (0, 2, 20, 0.5), (0, 3, 7, -1.0), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 7, -0.5)]
    assert ann.search(df.limit(0), F.expr(EVERY)).count() == 0 and ann.search(df.where("vec_id = 0"), F.expr(EVERY)).count() == 0 and ann.search(df.where("vec_id = 1"), F.expr(EVERY)).count() == 0
