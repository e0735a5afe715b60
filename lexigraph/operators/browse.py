"""Browsing: optional filters, sort orders, counts, years, previews and display columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.dates import shown
from lexigraph.functions.text import present

# Columns that browsing leaves out, sort orders by name.
HIDDEN_COLUMNS = ("searchable_text", "full_text")
SORTS = {"newest": ("-publication_year", "title"), "oldest": ("publication_year", "title"), "title": ("title",), "recently crawled": ("-updated_at",)}


def holds(column: Column, wanted: str) -> Column:
    """Case-insensitive literal substring; nulls do not match."""
    return F.coalesce(F.contains(F.lower(column), F.lower(F.lit(wanted))), F.lit(False))


def any_holds(columns: list[str], wanted: str) -> Column:
    return reduce(or_, (holds(F.col(c), wanted) for c in columns))


def author_holds(wanted: str, authors: str = "authors") -> Column:
    return F.coalesce(F.exists(authors, lambda a: holds(a["name"], wanted)), F.lit(False))


def ordered(df: DataFrame, sort: tuple[str, ...], tie: str | None = None) -> DataFrame:
    """Nulls are least: first where ascending, last where descending."""
    keys = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in (*sort, *([tie] if tie else []))]
    return df.orderBy(*keys)


def browse(publications: DataFrame, year: int | None = None, author_query: str | None = None, text_query: str | None = None, sort_by: str = "newest", limit: int = 50) -> DataFrame:
    """Filters that are given, all of them; an unknown order is the newest first; a limit of 0 is none."""
    out = publications
    if year is not None:
        out = out.where(F.col("publication_year") == year)
    if author_query:
        out = out.where(author_holds(author_query))
    if text_query:
        out = out.where(any_holds(["title", "source", "publication_type"], text_query))
    out = ordered(out.drop(*HIDDEN_COLUMNS), SORTS.get(sort_by, SORTS["newest"]), "publication_key")
    return out.limit(abs(limit)) if limit else out


def years(publications: DataFrame) -> DataFrame:
    return publications.select("publication_year").where("publication_year IS NOT NULL").distinct().orderBy(F.desc("publication_year"))


def authors_by_name(authors: DataFrame, limit: int = 100) -> DataFrame:
    return ordered(authors, ("name",), "author_key").limit(limit)


def latest_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return ordered(runs, ("-finished_at",), "run_id").limit(limit)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with a count a table, as columns."""
    one = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), one)


def by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed; no keys, no rows."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def preview(df: DataFrame, category: str, order: str, each: int = 10) -> DataFrame:
    """The first rows of each category."""
    place = Window.partitionBy(category).orderBy(order)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= each)


def author_links(authors: str = "authors") -> Column:
    link = lambda a: F.when(present(a["profile_url"]).isNotNull(), F.concat(F.lit("["), F.coalesce(present(a["name"]), F.lit("Unknown author")), F.lit("]("), a["profile_url"], F.lit(")"))).otherwise(F.coalesce(present(a["name"]), F.lit("Unknown author")))
    return F.coalesce(present(F.array_join(F.transform(authors, link), ", ")), F.lit("Unknown authors"))


def displayed(publications: DataFrame, zone: str = "UTC") -> DataFrame:
    """Titles, years, sources, authors and times as a page shows them."""
    return publications.select(
        F.coalesce(present("title"), F.lit("Untitled publication")).alias("title"),
        F.coalesce(F.nullif(F.col("publication_year"), F.lit(0)).cast("string"), F.lit("Unknown year")).alias("year"),
        F.coalesce(present("source"), present("publication_type"), F.lit("No source recorded")).alias("source"),
        author_links().alias("authors"),
        shown(F.col("updated_at"), zone).alias("updated"),
    )


def displayed_authors(authors: DataFrame) -> DataFrame:
    return authors.select("name", F.coalesce(F.size("publication_keys"), F.lit(0)).alias("publications"), F.coalesce("profile_url", F.lit("")).alias("profile"))


def displayed_runs(runs: DataFrame, zone: str = "UTC") -> DataFrame:
    return runs.select(shown(F.col("finished_at"), zone).alias("finished"), "status", "pages_visited", "publications_found", "publications_saved", F.coalesce(F.size("failed_urls"), F.lit(0)).alias("failed"))


# Least, greatest and default number of rows or pages that a request may name.
BOUNDS = {"browse": (5, 100, 25), "search": (5, 50, 10), "listing_pages": (1, 5, 1), "profile_pages": (0, 25, 0), "publications": (1, 100, 25)}


def bounded(kind: str, value: int | None = None) -> int:
    """The value if its kind allows it, the default if there is none."""
    least, greatest, default = BOUNDS[kind]
    value = default if value is None else value
    if not least <= value <= greatest:
        raise ValueError(f"{kind} must lie between {least} and {greatest}")
    return value


def displayed_clusters(summaries: DataFrame) -> DataFrame:
    return summaries.select("cluster", "documents", "majority_category", F.array_join("top_terms", ", ").alias("top_terms"))


def displayed_hits(hits: DataFrame) -> DataFrame:
    """Search results as shown: rank, title, score to four places, matched terms."""
    return hits.select("rank", F.coalesce(present("title"), F.lit("Untitled publication")).alias("title"), F.format_string("%.4f", "score").alias("score"), F.array_join("matched_terms", ", ").alias("matched"))


def dashboard(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What an overview shows: one row of counts, index metadata, years, the first authors, the latest runs."""
    none = [n for n in ("publications", "authors", "crawl_runs", "idf", "index_metadata") if n not in tables]
    if none:
        raise ValueError(f"missing tables: {', '.join(none)}")
    return {
        "counts": counts({n: tables[n] for n in ("publications", "authors", "crawl_runs", "idf")}).withColumnRenamed("idf", "terms"),
        "metadata": tables["index_metadata"].where("name = 'publication_index'").limit(1),
        "years": years(tables["publications"]),
        "authors": authors_by_name(tables["authors"]),
        "runs": latest_runs(tables["crawl_runs"]),
    }
