"""Registered queries over a small portal of hand-built pages: links, records, a crawl, an update.

Its pages have what generated ones lack: links in every form, metadata, abstracts, redirects, failures, forbidden pages.
The SQL lists the results that were worked out by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.config import EngineConfig
from lexigraph.functions.text import canonical_url, is_listing_url, on_domain, path_below
from lexigraph.operators.store import Store
from lexigraph.session import scratch
from lexigraph.sources import html_records
from lexigraph.sources.pages import TablePages
from lexigraph.streaming.crawl import crawl
from lexigraph.streaming.update import run_once, stored_index

ROOT = "https://portal.example"
SEED = f"{ROOT}/en/organisations/lab/"
DOMAIN, FORBIDDEN = "portal.example", (f"{ROOT}/en/publications/secret",)
LISTING = f"""<html><body><nav><a href="/en/organisations/lab/">home</a></nav><!-- <a href="/en/publications/hidden">x</a> -->
<ul><li><a href="/en/publications/caf&eacute;/?x=1#top">Caf&eacute; &amp; bar&#8217;s</a> by <a href='/en/persons/jane/'>Doe, J.</a> and <a href=/en/persons/images>Image of Jane</a>
Research output: Article Open Access 2020</li>
<li class="result"><a href="../../publications/old">Old</a> <a href="/en/persons/li">&#26446;&#26126;</a> Research output: Book 3 Downloads 1999</li></ul>
<div class="Portal_List_Item"><div><a href="/en/publications/secret">Secret <b>work</b></a></div> inside 2001 <script>no</script></div>
<a href="{SEED}publications/?page=1">next</a> <a href="{SEED}publications/?sort=1">sorted</a> <a href="/en/publications/">all</a> <a href="https://other.example/en/publications/far">Far</a></body></html>"""
SECOND = """<ul><li><a href="/en/publications/old/">Old again</a> 1998</li><li><a href="/en/publications/gone">Gone</a> <a href="/en/persons/jane">Jane Doe</a> 2010</li></ul><a href="?page=2">more</a>"""
CAFE = """<html><head><title>page</title><meta name="citation_title" content=" Caf&eacute; and bar "><meta name="citation_publication_date" content="2019/05/01"><meta property="citation_conference_title" content="Proc. X">
<meta name="citation_author" content="Doe, Jane"><meta name="citation_author" content="Roe, R."><meta name="citation_author" content=" "></head>
<body><nav>menu</nav><h1>Heading</h1><a href="../persons/jane?v=2">Doe, J.</a> <a href="/en/persons/">Persons</a> Research output: Contribution to journal File x
<h3> ABSTRACT </h3><p>First &lt;part&gt;.</p>loose<div>Second <i>one</i></div><h4>Next</h4><p>not this</p></body></html>"""
MOVED = """<html><head><title>only a title 2003</title></head><body><p>text of 1234 and 2002</p><header>2001</header><a href="../persons/li">&#26446;&#26126;</a></body></html>"""
PROFILE = """<article><a href="/en/publications/solo">Solo</a><div><a href="/en/persons/jane">Jane Doe</a></div> Research output: Thesis</article>"""
#: url, html, status, and where it was really found.
PAGES = [
    (SEED, LISTING, 200, None),
    (f"{SEED}publications/?page=1", SECOND, 200, None),
    (f"{SEED}publications/?page=2", "down", 503, None),
    (f"{ROOT}/en/persons/jane", PROFILE, 200, None),
    (f"{ROOT}/en/publications/café", CAFE, 200, None),
    (f"{ROOT}/en/publications/old", MOVED, 200, f"{ROOT}/en/publications/new/place/?from=old"),
    (f"{ROOT}/en/publications/solo", "<h1></h1><h2>Abstract</h2>", 200, None),
]


def config() -> EngineConfig:
    return EngineConfig(seed_url=SEED, allowed_domain=DOMAIN)


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "url string, html string, status_code int, final_url string")


def source(spark: SparkSession) -> TablePages:
    return TablePages(pages(spark), DOMAIN, FORBIDDEN)


def names(authors: str = "authors"):
    return F.array_join(F.transform(authors, lambda a: F.concat(a["name"], F.lit("="), F.coalesce(F.regexp_extract(a["profile_url"], "([^/]*)$", 1), F.lit("-")))), "; ")


def filled(df: DataFrame) -> DataFrame:
    """Without nulls, for comparison."""
    return df.fillna("").fillna(0)


def portal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's links in order, and what each is."""
    found = html_records.page_links(pages(spark).where(F.col("url") == SEED))
    link = F.col("link")
    return found.select(
        F.col("place").cast("bigint").alias("place"), canonical_url(link).alias("link"), on_domain(link, DOMAIN).alias("inside"), path_below(link, html_records.PUBLICATIONS).alias("publication"),
        path_below(link, html_records.PERSONS).alias("person"), is_listing_url(link, "/en/organisations/lab").alias("listing"),
    )


def portal_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_records.summaries(pages(spark).where("status_code = 200"))
    place = F.regexp_replace("page_url", f"^{ROOT}/en/", "")
    return filled(found.select(place.alias("page"), F.col("ord").cast("bigint").alias("ord"), F.regexp_extract("publication_url", "([^/]*)$", 1).alias("publication"), "title", "publication_year", "publication_type", names().alias("authors"), F.length("full_text").cast("bigint").alias("letters")))


def portal_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_records.details(pages(spark).where(F.col("url").contains("/publications/") & ~F.col("url").contains("?page")))
    return filled(found.select("publication_url", "title", "published_date", "source", "abstract", "publication_year", "publication_type", names().alias("authors")))


def portal_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crawl(spark, config(), source(spark)).publications
    out = out.select(F.col("ord").cast("bigint").alias("ord"), "publication_url", "title", "publication_year", "publication_type", "source", names().alias("authors"), F.regexp_replace("crawled_from", ROOT, "").alias("crawled_from"), (F.length("publication_key") == 64).alias("keyed"))
    return filled(out)


def portal_crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages visited, and those skipped or failed."""
    out = crawl(spark, config(), source(spark))
    visited = spark.createDataFrame([("visited", str(out.pages_visited)), ("profiles", str(out.profile_pages_visited))], "what string, value string")
    return visited.union(out.skipped.select(F.lit("skipped"), "url")).union(out.failed.select(F.lit("failed"), F.concat_ws(" ", F.regexp_extract("error", "([0-9]+|missing)$", 1), "url")))


def portal_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates into one store: what each table then holds."""
    store = Store(spark, scratch(spark))
    for _ in range(2):
        run_once(spark, config(), source(spark), store)
    authors, runs = store.read("authors"), store.read("crawl_runs")
    rows = [
        store.read("publications").agg(F.lit("publications").alias("what"), F.concat_ws(" ", F.count("*"), F.count_if(F.col("first_seen_at") < F.col("updated_at")), F.count_if(F.col("searchable_text").startswith(F.col("title")))).alias("value")),
        authors.select(F.lit("author").alias("what"), F.concat_ws(" ", "name", F.size("publication_keys")).alias("value")),
        runs.agg(F.lit("runs").alias("what"), F.concat_ws(" ", F.count("*"), F.count_distinct("run_id"), F.max("pages_visited"), F.max("publications_found"), F.max("publications_saved"), F.max(F.size("skipped_by_robots")), F.max(F.size("failed_urls")), F.max("status")).alias("value")),
        stored_index(store).metadata().select(F.lit("index").alias("what"), F.concat_ws(" ", "name", "document_count", F.col("vocabulary_size") == store.read("inverted_index").select("term").distinct().count()).alias("value")),
        store.read("document_vectors").agg(F.lit("vectors").alias("what"), F.concat_ws(" ", F.count("*"), F.count_if(F.size("vector") == F.col("unique_term_count"))).alias("value")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


QUERIES = (portal_links, portal_summaries, portal_details, portal_crawl, portal_crawl_log, portal_update)


#: What the queries above give, by their columns in order.
EXPECTED = {
    "portal_links": ("place link inside publication person listing", [
        (0, f"{ROOT}/en/organisations/lab", True, False, False, False),
        (1, f"{ROOT}/en/publications/café", True, True, False, False),
        (2, f"{ROOT}/en/persons/jane", True, False, True, False),
        (3, f"{ROOT}/en/persons/images", True, False, True, False),
        (4, f"{ROOT}/en/publications/old", True, True, False, False),
        (5, f"{ROOT}/en/persons/li", True, False, True, False),
        (6, f"{ROOT}/en/publications/secret", True, True, False, False),
        (7, f"{ROOT}/en/organisations/lab/publications", True, False, False, True),
        (8, f"{ROOT}/en/organisations/lab/publications", True, False, False, False),
        (9, f"{ROOT}/en/publications", True, False, False, False),
        (10, "https://other.example/en/publications/far", False, True, False, False),
    ]),
    "portal_summaries": ("page ord publication title publication_year publication_type authors letters", [
        ("organisations/lab/", 0, "café", "Café & bar’s", 2020, "Article", "Doe, J.=jane", 83),
        ("organisations/lab/", 1, "old", "Old", 1999, "Book", "李明=li", 45),
        ("organisations/lab/", 2, "secret", "Secret work", 2001, "", "", 23),
        ("organisations/lab/", 3, "far", "Far", 2020, "Article", "Doe, J.=jane; 李明=li", 173),
        ("organisations/lab/publications/?page=1", 0, "old", "Old again", 1998, "", "", 14),
        ("organisations/lab/publications/?page=1", 1, "gone", "Gone", 2010, "", "Jane Doe=jane", 18),
        ("persons/jane", 0, "solo", "Solo", 0, "Thesis", "Jane Doe=jane", 37),
    ]),
    "portal_details": ("publication_url title published_date source abstract publication_year publication_type authors", [
        (f"{ROOT}/en/publications/café", "Café and bar", "2019/05/01", "Proc. X", "First <part>. Second one", 2019, "Contribution to journal", "Doe, Jane=jane; Roe, R.=-"),
        (f"{ROOT}/en/publications/new/place", "only a title 2003", "", "", "", 2003, "", ""),
        (f"{ROOT}/en/publications/solo", "", "", "", "", 0, "", ""),
    ]),
    "portal_crawl": ("ord publication_url title publication_year publication_type source authors crawled_from keyed", [
        (0, f"{ROOT}/en/publications/café", "Café and bar", 2019, "Contribution to journal", "Proc. X", "Doe, J.=jane; Roe, R.=-", "/en/organisations/lab/", True),
        (1, f"{ROOT}/en/publications/new/place", "only a title 2003", 2003, "Book", "", "李明=li", "/en/organisations/lab/", True),
        (2, f"{ROOT}/en/publications/secret", "Secret work", 2001, "", "", "", "/en/organisations/lab/", True),
        (3, "https://other.example/en/publications/far", "Far", 2020, "Article", "", "Doe, J.=jane; 李明=li", "/en/organisations/lab/", True),
        (1, f"{ROOT}/en/publications/gone", "Gone", 2010, "", "", "Jane Doe=jane", "/en/organisations/lab/publications/?page=1", True),
        (0, f"{ROOT}/en/publications/solo", "Solo", 0, "Thesis", "", "Jane Doe=jane", "/en/persons/jane", True),
    ]),
    "portal_crawl_log": ("what value", [
        ("visited", "3"), ("profiles", "1"), ("skipped", f"{ROOT}/en/publications/secret"), ("skipped", "https://other.example/en/publications/far"),
        ("failed", f"503 {SEED}publications/?page=2"), ("failed", f"missing {ROOT}/en/persons/images"), ("failed", f"missing {ROOT}/en/persons/li"), ("failed", f"missing {ROOT}/en/publications/gone"),
    ]),
    "portal_update": ("what value", [
        ("publications", "6 6 6"), ("author", "Doe, J. 4"), ("author", "李明 2"), ("author", "Roe, R. 1"), ("runs", "2 2 3 6 6 2 4 completed"), ("index", "publication_index 6 true"), ("vectors", "6 6"),
    ]),
}
#: The columns that are not text.
TYPES = {"place": "BIGINT", "ord": "BIGINT", "letters": "BIGINT", "publication_year": "INT", "inside": "BOOLEAN", "publication": "BOOLEAN", "person": "BOOLEAN", "listing": "BOOLEAN", "keyed": "BOOLEAN"}


def oracle_sql() -> dict[str, str]:
    said = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    out = {}
    for name, (columns, rows) in EXPECTED.items():
        typed = ", ".join(f"{c}::{TYPES[c] if not isinstance(rows[0][i], str) else 'VARCHAR'} AS {c}" if c in TYPES else f"{c}::VARCHAR AS {c}" for i, c in enumerate(columns.split()))
        out[name] = f"SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) v({', '.join(columns.split())})"
    return out
