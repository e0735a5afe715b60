import re

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lexigraph.llm import neardup, pii, quality, toxicity

from ..conftest import SMALL


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's result on the smallest tables, as lists of rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SMALL)
        out.append(got.collect())
        docs = spark.createDataFrame(out[-1], got.schema)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_filters_take_effect(spark, stages):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    marks = spark.read.parquet(f"{SMALL}/labels.parquet")
    score = {r["doc_id"]: r["s"] for r in quality.scored_texts(docs, quality.fit(docs, marks.where(~quality.is_held_out())), "s").collect()}
    assert {r["doc_id"] for r in stages[1]} == {i for i, s in score.items() if s >= quality.KEEP_FROM}
    kept = spark.createDataFrame(stages[1], docs.schema)
    p = {r["doc_id"]: r["p_toxic"] for r in toxicity.scored(kept, toxicity.fit(kept, marks)).collect()}
    assert {r["doc_id"] for r in stages[2]} == {i for i, x in p.items() if x < toxicity.TOXIC_FROM}


def test_clean_documents_stay(stages):
    t = pq.read_table(f"{SMALL}/labels.parquet").to_pydict()
    good = {i for i, q, x in zip(t["doc_id"], t["quality"], t["toxic"]) if q and not x}
    bad = {i for i, q in zip(t["doc_id"], t["quality"]) if not q}
    kept = {r["doc_id"] for r in stages[2]}
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.2 * len(bad)


def test_one_of_each_class(spark, stages):
    docs = spark.createDataFrame(stages[2], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    classes = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(set(classes.values()))


def test_personal_data_is_masked(stages):
    assert len(stages[4]) == len(stages[3])
    before = {r["doc_id"]: r["text"] for r in stages[3]}
    for r in stages[4]:
        assert r["n_chars"] == len(r["text"]) and not pii.finder().spans(re.sub("<[A-Z]+>", " ; ", r["text"]))
        if not pii.finder().spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]


def test_run_and_registration(spark, stages):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    got = corpus_pipeline.run(spark, SMALL).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sum(r["length"] for r in got) == sum(r["length"] for r in stages[5])
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in stages[4]} and sorted(map(key, got)) == sorted(map(key, stages[5]))


def test_odd_rows(spark, make_docs, odd_rows, tmp_path):
    docs = make_docs(odd_rows)
    spark.createDataFrame([(3, 1, 0), (8, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.schema == docs.schema or name
        assert got.count() <= len(odd_rows)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.pack_tokens(spark, docs, str(tmp_path)).count() >= len(odd_rows)
