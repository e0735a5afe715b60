"""What must hold for large tables: bounded tasks, narrow exchanges, and queries that keep to their SQL at other sizes."""

import time
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexigraph.functions.text import indexed_text, searchable_text
from lexigraph.operators import index
from lexigraph.operators.store import Store, publication_rows
from lexigraph.plans import stored
from lexigraph.schemas import columns
from lexigraph.session import cut
from lexigraph.streaming import update

from .conftest import SMALL


def test_terms_are_dealt_by_bytes(spark, monkeypatch):
    """A task splits so many bytes of texts at most, whatever adaptive execution would put into one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = index.stored_bytes(docs)
    monkeypatch.setattr(index, "DEALT_BYTES", held // 9)
    for made in (index.term_frequencies, index.positions):
        assert made(docs, "doc_id", F.col("text")).rdd.getNumPartitions() >= 9
    assert index.stored_bytes(spark.createDataFrame([(1, "a")], "k int, t string")) is None


def test_weights_are_dealt_by_bytes(spark, monkeypatch):
    """The session's two partitions do not decide how many rows of weights a task sorts."""
    built = index.build(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id", F.col("text"))
    monkeypatch.setattr(index, "DEALT_BYTES", index.stored_bytes(built.tf) // 9)
    got = index.weights(built.tf, built.idf, "doc_id")
    assert got.rdd.getNumPartitions() >= 9
    due = {(k, t): w for k, t, w in index.of_unit_length(index.raw_weights(built.tf, built.idf, "doc_id"), "doc_id").collect()}
    rows = got.collect()
    assert len(rows) == len(due) and all(abs(w - due[k, t]) < 1e-12 for k, t, w in rows)


def test_postings_are_moved_once(spark):
    """From a document's occurrences of a term to where the postings are written, keys in half their letters."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("k"), "text")
    placed = index.positions(docs, "k", F.col("text"))
    own = cut(index.occurrences(placed, "k"))
    idf = cut(index.document_frequencies(own.select("k", "term"), docs))
    got = index.posted(own, idf, "k", 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(") == 1 and "hashpartitioning(" not in plan
    rows, whole = got.collect(), {r["term"]: r for r in index.postings(placed, "k").collect()}
    assert len(rows) > len(whole) == len({r["term"] for r in rows})
    for r in rows:
        assert r["document_frequency"] == whole[r["term"]]["document_frequency"]
    assert sorted((r["term"], *p) for r in rows for p in r["postings"]) == sorted((t, *p) for t, r in whole.items() for p in r["postings"])
    keys = spark.createDataFrame([("",), ("ab",), ("AB",), ("abc",), ("01ff",), ("é",)], "k string")
    assert all(r[0] == r[1] for r in keys.select("k", index.unpacked(index.packed(F.col("k")))).collect())


def test_terms_of_one_document_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, "delta beta alpha")], "k int, text string")
    built = index.build(docs, "k", F.col("text"))
    due = sorted(map(tuple, built.weights.collect()))
    for turns in ([False, True], [False, False]):
        monkeypatch.setattr(index, "is_small", lambda df, left=list(turns): left.pop(0))
        assert sorted(map(tuple, index.weights(built.tf, built.idf, "k").collect())) == due


def _duck(name, at):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    return c.sql(entry.oracle_sql()[name]).df()


def _same(spark, name, at):
    got, due = (sorted(df[sorted(df.columns)].astype(str).values.tolist()) for df in (entry.queries()[name](spark, str(at)).toPandas(), _duck(name, at)))
    assert got == due and got


@pytest.fixture(scope="module")
def odd_pages(tmp_path_factory):
    """References without a semicolon, as a cut text ends with one."""
    at = tmp_path_factory.mktemp("pages")
    texts = ["One &amp", "A &amp;&amp B &copy 1", "x && y &lt z &amp;lt; &quot;&#39;", "&", "plain &middot; text"]
    pages = [(i, f"https://p.example/{i}/", f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>Text {t}</p></body></html>") for i, t in enumerate(texts)]
    pq.write_table(pa.table({k: list(v) for k, v in zip(("page_id", "url", "html"), zip(*pages))}), at / "pages.parquet")
    for t in ("documents", "embeddings"):
        (at / f"{t}.parquet").write_bytes(Path(SMALL, f"{t}.parquet").read_bytes())
    return at


@pytest.mark.parametrize("name", ["page_visible_text", "page_title_h1", "page_records", "page_tree_text"])
def test_references_without_semicolon(spark, odd_pages, name):
    _same(spark, name, odd_pages)


@pytest.fixture(scope="module")
def more_vectors(tmp_path_factory):
    """Half as many vectors again as the SQL of the fits has seeds for."""
    at = tmp_path_factory.mktemp("vectors")
    e = pq.read_table(f"{SMALL}/embeddings.parquet")
    more = e.slice(0, len(e) // 2).to_pydict()
    more["vec_id"] = [i + len(e) for i in more["vec_id"]]
    more["embedding"] = [v[::-1] for v in more["embedding"]]
    pq.write_table(pa.concat_tables([e, pa.table(more, schema=e.schema)]), at / "embeddings.parquet")
    for t in ("documents", "pages"):
        (at / f"{t}.parquet").write_bytes(Path(SMALL, f"{t}.parquet").read_bytes())
    return at


@pytest.mark.parametrize("name", ["kmeans_assign", "kmeans_update", "cluster_summary", "kmeans_fit", "text_kmeans_lang"])
def test_seeds_of_the_sql(spark, more_vectors, name):
    _same(spark, name, more_vectors)


def test_names_are_dealt_by_bytes(spark, monkeypatch):
    """A small file of names gives one task; matching them takes more."""
    held = index.stored_bytes(spark.read.parquet(f"{SMALL}/customer.parquet"))
    monkeypatch.setattr(index, "LEAST_DEALT_BYTES", held // 7)
    assert entry.queries()["author_match_pairs"](spark, SMALL).rdd.getNumPartitions() >= 7


def test_index_is_rebuilt_slice_by_slice(spark, tmp_path, monkeypatch):
    """Postings hold numbers for keys, lie in as many folders as slices, and search as from one; nothing of a shuffle stays."""
    held = {}
    for slices in (1, 3):
        s = Store(spark, f"file://{tmp_path}/{slices}")
        s.upsert_publications(stored.publications(spark, SMALL))
        monkeypatch.setattr(update, "SLICES", slices)
        monkeypatch.setattr(update, "SLICE_BYTES", 1)
        update.rebuild_index(s)
        assert len(s.version("inverted_index")) == slices
        rows = s.read("inverted_index").select("term", "document_frequency", F.explode("postings").alias("p")).join(s.read("document_vectors").select(F.col("number").alias("at"), "publication_key"), F.col("p.number") == F.col("at"))
        held[slices] = sorted((r["term"], r["document_frequency"], r["publication_key"], r["p"]["term_frequency"], r["p"]["positions"]) for r in rows.collect())
        places = s.read("inverted_index").selectExpr("inline(postings)").selectExpr("max(size(positions) - term_frequency) AS off").first()
        assert places["off"] == 0
    assert held[1] == held[3] and held[1]
    publications = s.read("publications")
    due = index.segmented_postings(index.positions(publications, "publication_key", indexed_text()), "publication_key")
    due = due.select("term", "document_frequency", F.explode("postings").alias("p")).select("term", "document_frequency", "p.*").collect()
    assert held[1] == sorted(map(tuple, due))
    weights = index.build(publications, "publication_key", indexed_text()).weights.collect()
    got = s.read("document_vectors").select("publication_key", F.explode("vector")).collect()
    assert sorted((k, t) for k, t, _ in got) == sorted((k, t) for k, t, _ in weights)
    due = {(k, t): w for k, t, w in weights}
    assert all(abs(w - due[k, t]) < 1e-12 for k, t, w in got)
    searched = [(k, t, w) for k, t, w in update.stored_index(s).weights.collect()]
    assert len(searched) == len(due) and all(abs(w - due[k, t]) < 1e-12 for k, t, w in searched)


def test_store_holds_no_text_twice(spark, tmp_path):
    """The search text is read as it was written, also where it is not what the fields give, and stored only there."""
    s = Store(spark, f"file://{tmp_path}")
    s.upsert_publications(stored.publications(spark, SMALL))
    bare = spark.read.parquet(f"file://{tmp_path}/publications/*")
    assert bare.where("searchable_text IS NOT NULL").isEmpty() and not bare.isEmpty()
    read = s.read("publications")
    assert read.where(~F.col("searchable_text").eqNullSafe(searchable_text())).isEmpty() and read.columns == columns("publications")
    odd = read.withColumn("searchable_text", F.when(F.col("publication_year") > 2000, "odd").when(F.col("publication_year") > 1995, F.col("searchable_text"))).select("publication_key", "searchable_text").collect()
    s.replace("publications", read.withColumn("searchable_text", F.when(F.col("publication_year") > 2000, "odd").when(F.col("publication_year") > 1995, F.col("searchable_text"))))
    assert sorted(map(str, s.read("publications").select("publication_key", "searchable_text").collect())) == sorted(map(str, odd))


def test_texts_of_distinct_keys_are_not_moved(spark):
    batch = stored.publications(spark, SMALL)
    assert "Exchange" not in publication_rows(batch)._jdf.queryExecution().executedPlan().toString()
    twice = batch.union(batch.withColumn("ord", F.col("ord") + 1_000_000).withColumn("title", F.lit("later")))
    rows = publication_rows(twice)
    assert rows.count() == batch.count() and rows.where("title <> 'later' OR NOT startswith(searchable_text, 'later')").isEmpty()


def test_shuffles_go_with_their_query(spark):
    """Their files are removed when a table has been cut, and the setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, local = spark.conf.get(name), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in local.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    held = files()
    cut(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count())
    for _ in range(50):
        if files() <= held:
            break
        time.sleep(0.1)
    assert files() <= held and spark.conf.get(name) == before
