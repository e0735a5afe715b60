import hashlib
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigraph.llm import queries, warc

from ..conftest import SMALL

ROWS = [(0, "http://a/", "<p>é</p>"), (1, None, None), (2, "u\r\nX: y", ""), (2, "u", "other"), (2, "u", "other"), (None, "n", "x\r\n\r\nWARC/1.1\r\n"), (None, "n", "y"), (5000, "http://b/", "y" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id bigint, url string, html string, node string, digest int")


def test_written_records_read_back(spark, pages, tmp_path):
    rows = warc.records(pages)
    path = str(tmp_path / "a")
    warc.write(rows, path, "record_id")
    got = warc.read(spark, path, payload=True).collect()
    want = rows.collect()
    assert len(got) == len(want) == len(ROWS)
    assert Counter((r["record_id"], r["length"], r["digest"]) for r in got) == Counter((r["record_id"], r["length"], r["digest"]) for r in want)
    assert Counter((r["record_id"], r["payload"]) for r in got) == Counter((i, h or "") for i, _, h in ROWS)
    assert {r["url"] for r in got} == {"http://a/", "", "u%0D%0AX: y", "u", "n", "http://b/"}
    for file in {r["file"] for r in got}:
        raw = warc.unpacked(next((tmp_path / "a").glob(file)).read_bytes())
        own = sorted((r for r in got if r["file"] == file), key=lambda r: r["offset"])
        assert [r["offset"] + r["length"] for r in own] == [r["offset"] for r in own[1:]] + [len(raw)]
        assert all(hashlib.sha256(raw[r["offset"] : r["offset"] + r["length"]]).hexdigest() == r["digest"] for r in own)


def test_damaged_volumes(tmp_path, spark, pages):
    one = warc.records(pages).where("record_id = 0").first()["record"].encode() + b"\r\n\r\n"
    broken = b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort" + one
    assert [g[3].decode() for g in warc.parsed(broken)] == ["<p>é</p>"] and list(warc.parsed(b"junk")) == []
    path = str(tmp_path / "b")
    warc.write(warc.records(pages), path, "record_id")
    whole = max((tmp_path / "b").glob("*.gz"), key=lambda f: f.stat().st_size).read_bytes()
    assert warc.unpacked(whole[: len(whole) // 2]) == warc.unpacked(whole)[: len(warc.unpacked(whole[: len(whole) // 2]))]
    assert warc.unpacked(whole[:10] + b"\xff" * 50) is not None and warc.unpacked(b"plain") == b"plain"


def findings(ours, theirs):
    return {(r["record_id"], r["changed"], r["missing"], r["added"]) for r in warc.audit(ours, theirs).collect()}


def test_a_replica_laid_out_by_itself(spark, tmp_path):
    """One record lost, one put in, one flipped: three findings, whatever moved because of them."""
    many = spark.range(9000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), "id").alias("html"))
    ours = warc.records(many)
    other = many.where("page_id <> 2").withColumn("html", F.when(F.col("page_id") == 4000, "flipped").otherwise(F.col("html")))
    other = other.union(spark.createDataFrame([(70_000, "u", "new")], "page_id bigint, url string, html string"))
    path = str(tmp_path / "c")
    warc.write(warc.records(other), path, F.desc("record_id"))
    theirs = warc.read(spark, path)
    assert findings(ours, theirs) == {(2, 0, 1, 0), (4000, 1, 0, 0), (70_000, 0, 0, 1)}
    assert findings(ours, ours.withColumns({"file": F.lit("f"), "offset": F.lit(0)})) == set()
    at = {r["record_id"]: (r["file"], r["offset"]) for r in warc.audit(ours, theirs).collect()}
    place = {r["record_id"]: (r["file"], r["offset"]) for r in theirs.collect()}
    assert at[4000] == place[4000] and at[70_000] == place[70_000] and at[2] == (None, None)


def test_repeated_and_missing_ids(spark, pages):
    ours = warc.records(pages).withColumns({"file": F.lit("f"), "offset": F.lit(0)})
    assert findings(ours, ours) == set()
    assert findings(ours, ours.where("NOT (record_id <=> 2)")) == {(2, 0, 3, 0)}
    lost = ours.withColumn("k", F.row_number().over(Window.partitionBy("record_id", "digest").orderBy("length"))).where("k = 1").drop("k")
    assert findings(ours, lost) == {(2, 0, 1, 0)} and findings(lost, ours) == {(2, 0, 0, 1)}
    changed = ours.withColumn("digest", F.when(F.col("record_id").isNull(), F.sha2(F.col("digest").cast("binary"), 256)).otherwise(F.col("digest")))
    assert sorted(tuple(r)[2:5] for r in warc.audit(ours, changed).collect()) == [(0, 0, 1)] * 2 + [(0, 1, 0)] * 2
    nodes = {r["node"] // warc.FANOUT ** (warc.LEVELS - 1) for r in spark.range(500).select(F.lit(None).cast("bigint").alias("record_id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest")).select(warc.leaf().alias("node")).collect()}
    assert len(nodes) > 490


def test_roots_follow_every_record(pages):
    root = lambda df: {r["node"]: r["hash"] for r in warc.tree(warc.records(df))[-1].collect()}
    a, b = root(pages), root(pages.withColumn("html", F.when(F.col("page_id") == 1, "z").otherwise(F.col("html"))))
    assert a.keys() == b.keys() and a[0] != b[0] and a[1] == b[1]


def test_empty_archive(spark, pages, tmp_path):
    none, full = (warc.records(x).withColumns({"file": F.lit("f"), "offset": F.lit(0)}) for x in (pages.limit(0), pages))
    assert findings(none, none) == set() and sum(r["added"] for r in warc.audit(none, full).collect()) == len(ROWS)
    warc.write(none, str(tmp_path / "d"), "record_id")
    assert warc.read(spark, str(tmp_path / "d")).count() == 0


def test_query_5(spark):
    rows = queries.op5_merkle_audit(spark, SMALL).collect()
    fate = {r["page_id"]: r["f"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", F.pmod(F.xxhash64("page_id"), F.lit(100)).alias("f")).collect()}
    assert len(rows) == len(fate)
    assert all(r["finding"] == {0: "missing", 1: "changed", 2: "added"}.get(fate[r["page_id"]], "intact") for r in rows)
    assert all((r["file"] is None) == (r["finding"] in ("missing", "intact")) for r in rows)
