"""Registered queries over stored publications: search from the index, its tables, what pages show, keys, times, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions.dates import local_to_utc, shown
from lexigraph.functions.text import absolute_url, author_key, indexed_text, searchable_text
from lexigraph.operators import browse, index, search
from lexigraph.operators.store import Store
from lexigraph.session import scratch
from lexigraph.streaming.update import rebuild_index, stored_index

from .retrieval import QUERY, documents, table
from .sql import index_sql, queries_sql, terms_sql

ZONE, OTHER_ZONE = "Europe/Berlin", "America/New_York"
REFS = ["../up?x=1", "./here", "a/../b/", "/root/../top", "//host.example/p", "?q=2", "#f", "mailto:x@y"]
_stores: dict[tuple[str, str], Store] = {}


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as publications of their sources, with gaps in every optional field."""
    d = table(spark, sf_dir, "documents")
    person = F.struct(F.col("source").alias("name"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("https://portal.example/en/persons/"), "source")).alias("profile_url"), F.lit(None).cast("string").alias("affiliation"))
    return d.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("https://portal.example/en/publications/"), "doc_id").alias("publication_url"), F.when(F.col("doc_id") % 11 > 0, F.concat_ws(" ", F.lit("Work of"), "source")).otherwise("").alias("title"),
        F.when(F.col("doc_id") % 5 > 0, F.array(person)).otherwise(F.array().cast("array<struct<name:string,profile_url:string,affiliation:string>>")).alias("authors"),
        F.when(F.col("doc_id") % 7 > 0, 1990 + F.col("doc_id") % 30).cast("int").alias("publication_year"), F.when(F.col("doc_id") % 2 > 0, F.col("lang")).alias("source"),
        F.when(F.col("doc_id") % 4 > 0, "Article").otherwise("").alias("publication_type"), F.lit(None).cast("string").alias("abstract"), F.col("text").alias("full_text"),
    )


def store(spark: SparkSession, sf_dir: str) -> Store:
    """A store with the publications and their index; the queries of a session share it."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stores:
        s = Store(spark, scratch(spark))
        s.check()
        s.upsert_publications(publications(spark, sf_dir))
        rebuild_index(s)
        _stores[at] = s
    return _stores[at]


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    hits = search.with_publications(search.search(stored_index(s), QUERY, 25), s.read("publications"))
    return hits.select(F.col("rank").cast("bigint").alias("rank"), "publication_url", "title", F.round("score", 6).alias("score"), F.array_join("matched_terms", " ").alias("matched"))


def stored_hits_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    hits = search.with_publications(search.search(stored_index(s), QUERY, 10), s.read("publications"))
    return browse.displayed_hits(hits).withColumn("rank", F.col("rank").cast("bigint"))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store(spark, sf_dir).read("document_vectors")
    square = F.aggregate(F.map_values("vector"), F.lit(0.0), lambda a, w: a + w * w)
    return kept.select("publication_key", "title", F.coalesce("publication_year", F.lit(0)).alias("publication_year"), "token_count", "unique_term_count", F.size("vector").cast("bigint").alias("entries"), F.round(square, 6).alias("square"))


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store(spark, sf_dir).read("inverted_index").select("term", "document_frequency", F.explode("postings").alias("p"))
    return kept.groupBy("term").agg(F.max("document_frequency").alias("document_frequency"), F.count("*").alias("postings"), F.sum("p.term_frequency").alias("occurrences"), F.sum(F.expr("aggregate(p.positions, 0L, (a, x) -> a + x)")).alias("places"))


def stored_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).read("index_metadata").select("name", "document_count", "vocabulary_size")


def stored_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored authors by name, as a page shows them."""
    return browse.displayed_authors(browse.authors_by_name(store(spark, sf_dir).read("authors"), 15))


def stored_publications_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown_ = browse.displayed(browse.browse(store(spark, sf_dir).read("publications"), sort_by="title", limit=60))
    return shown_.select("title", "year", "source", "authors")


def sorted_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return index.vocabulary(index.term_frequencies(docs, "doc_id", F.col("text")))


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = publications(spark, sf_dir).withColumn("searchable_text", searchable_text())
    return whole.select("publication_url", F.md5("searchable_text").alias("searchable"), F.md5(indexed_text()).alias("indexed"))


def author_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of customers as authors: untidy names, and a profile for every third."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("\t ")), F.lit("\n"))
    profile = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://p.example/"), "c_custkey")).otherwise("")
    return c.select("c_custkey", author_key(name, profile).alias("author_key"))


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' times in another zone, and their dates with a time of day of a third zone, in UTC."""
    e = table(spark, sf_dir, "events")
    utc = local_to_utc(F.to_date("ts"), F.lit("09:30"), OTHER_ZONE)
    return e.select("event_id", shown(F.col("ts"), ZONE).alias("shown"), F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("utc"))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every kind seen from each page."""
    refs = F.explode(F.array(*map(F.lit, REFS))).alias("ref")
    return table(spark, sf_dir, "pages").select("page_id", "url", refs).select("page_id", "ref", absolute_url(F.col("url"), F.col("ref")).alias("link"))


def runs_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest events as crawl runs, as a page shows them."""
    one = F.struct(F.col("event_type").alias("url"), F.lit("e").alias("error"))
    runs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("finished_at"), F.col("event_type").alias("status"), F.col("user_id").cast("int").alias("pages_visited"), F.lit(1).alias("publications_found"),
        F.lit(2).alias("publications_saved"), F.when(F.col("event_id") % 2 == 0, F.array(one, one)).alias("failed_urls"),
    )
    return browse.displayed_runs(browse.latest_runs(runs, 20), ZONE)


QUERIES = (
    stored_search, stored_hits_shown, stored_vectors, stored_postings, stored_metadata, stored_authors, stored_publications_shown, sorted_vocabulary, search_texts, author_keys, local_times, resolved_links, runs_shown,
)


def oracle_sql() -> dict[str, str]:
    spaced = lambda *parts: "trim(concat_ws(' ', " + ", ".join(f"nullif({p}, '')" for p in parts) + "))"
    fields = ("title", "names", "publication_year::VARCHAR", "source", "publication_type")
    pubs = f"""pubs0 AS (SELECT doc_id AS ord, 'https://portal.example/en/publications/' || doc_id AS publication_url, CASE WHEN doc_id % 11 > 0 THEN 'Work of ' || source ELSE '' END AS title, CASE WHEN doc_id % 5 > 0 THEN source ELSE '' END AS names,
  CASE WHEN doc_id % 3 > 0 THEN 'https://portal.example/en/persons/' || source END AS profile, CASE WHEN doc_id % 7 > 0 THEN (1990 + doc_id % 30)::INT END AS publication_year, CASE WHEN doc_id % 2 > 0 THEN lang END AS source,
  CASE WHEN doc_id % 4 > 0 THEN 'Article' ELSE '' END AS publication_type, text AS full_text FROM documents),
pubs1 AS (SELECT *, {spaced(*fields, "full_text")} AS searchable FROM pubs0),
pubs AS (SELECT *, sha256(publication_url) AS doc_id, {spaced(*fields, "searchable")} AS indexed FROM pubs1)"""
    one = "(SELECT 0 AS query_id, '" + QUERY + "' AS query)"
    hits = lambda n: f"WITH {pubs}, {index_sql('pubs', 'doc_id', 'indexed')}, {queries_sql(one)}, best AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, score, matched FROM hits QUALIFY rank <= {n})"
    terms = f"WITH {pubs}, {terms_sql('pubs', 'doc_id', 'indexed')}"
    name = "'  ' || replace(c_name, '#', chr(9) || ' ') || chr(10)"
    origin, path = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)", "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')"
    seen_from = {
        REFS[0]: "origin || parent || 'up?x=1'", REFS[1]: "origin || folder || 'here'", REFS[2]: "origin || folder || 'b/'", REFS[3]: "origin || '/top'", REFS[4]: "regexp_extract(url, '^([a-z]+:)', 1) || '//host.example/p'",
        REFS[5]: "origin || path || '?q=2'", REFS[6]: "regexp_replace(url, '#.*$', '') || '#f'", REFS[7]: "'mailto:x@y'",
    }
    return {
        "stored_search": f"{hits(25)} SELECT rank, publication_url, title, round(score, 6) AS score, matched FROM best JOIN pubs USING (doc_id)",
        "stored_hits_shown": f"{hits(10)} SELECT rank, coalesce(nullif(title, ''), 'Untitled publication') AS title, printf('%.4f', score) AS score, replace(matched, ' ', ', ') AS matched FROM best JOIN pubs USING (doc_id)",
        "stored_vectors": f"{terms} SELECT doc_id AS publication_key, any_value(title) AS title, coalesce(any_value(publication_year), 0) AS publication_year, count(term) AS token_count, count(DISTINCT term) AS unique_term_count, count(DISTINCT term) AS entries, CASE WHEN count(term) > 0 THEN 1.0 ELSE 0.0 END AS square FROM pubs LEFT JOIN terms USING (doc_id) GROUP BY doc_id",
        "stored_postings": f"{terms} SELECT term, count(DISTINCT doc_id) AS document_frequency, count(DISTINCT doc_id) AS postings, count(*) AS occurrences, sum(position)::BIGINT AS places FROM terms GROUP BY term",
        "stored_metadata": f"{terms} SELECT 'publication_index' AS name, (SELECT count(*) FROM pubs) AS document_count, count(DISTINCT term) AS vocabulary_size FROM terms",
        "stored_authors": f"WITH {pubs}, a AS (SELECT names AS name, profile, sha256(coalesce(profile, lower(names))) AS k, count(*) AS n FROM pubs WHERE names <> '' GROUP BY ALL) SELECT name, n::INT AS publications, coalesce(profile, '') AS profile FROM a ORDER BY name, k LIMIT 15",
        "stored_publications_shown": f"""WITH {pubs} SELECT coalesce(nullif(title, ''), 'Untitled publication') AS title, coalesce(publication_year::VARCHAR, 'Unknown year') AS year, coalesce(source, nullif(publication_type, ''), 'No source recorded') AS source,
  CASE WHEN names = '' THEN 'Unknown authors' WHEN profile IS NULL THEN names ELSE '[' || names || '](' || profile || ')' END AS authors FROM pubs ORDER BY pubs.title, doc_id LIMIT 60""",
        "sorted_vocabulary": f"WITH {terms_sql()} SELECT row_number() OVER (ORDER BY term) - 1 AS place, term FROM (SELECT DISTINCT term FROM terms)",
        "search_texts": f"WITH {pubs} SELECT publication_url, md5(searchable) AS searchable, md5(indexed) AS indexed FROM pubs",
        "author_keys": f"SELECT c_custkey, sha256(CASE WHEN c_custkey % 3 = 0 THEN 'https://p.example/' || c_custkey ELSE lower(trim(regexp_replace({name}, '\\s+', ' ', 'g'))) END) AS author_key FROM customer",
        "local_times": f"SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}', '%Y-%m-%d %H:%M') AS shown, strftime(((ts::DATE + TIME '09:30:00') AT TIME ZONE '{OTHER_ZONE}') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc FROM events",
        "resolved_links": f"WITH a AS (SELECT page_id, url, {origin} AS origin, {path} AS path FROM pages), b AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder, regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') AS parent FROM a) " + " UNION ALL ".join(f"SELECT page_id, '{r}' AS ref, {link} AS link FROM b" for r, link in seen_from.items()),
        "runs_shown": f"SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}', '%Y-%m-%d %H:%M') AS finished, event_type AS status, user_id::INT AS pages_visited, 1 AS publications_found, 2 AS publications_saved, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS failed FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 20",
    }
