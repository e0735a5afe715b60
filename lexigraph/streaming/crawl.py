"""A bounded breadth-first crawl as frontier DataFrames.

Each turn fetches the queued listing pages that the cap still allows, reads their publications, persons and further
listings, and queues those not seen before. One hop to profile pages and one to publication pages follow. Order is
explicit: pages by turn and place, links by place in the page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.config import EngineConfig
from lexigraph.functions.text import canonical_url, is_listing_url, path_below, url_path, without_fragment
from lexigraph.session import cut
from lexigraph.sources import html_records
from lexigraph.sources.html_records import PERSONS, combined, details, summaries

_LINKS = "url string, page_ord bigint, place int"


@dataclass
class CrawlOutput:
    publications: DataFrame
    pages_visited: int
    profile_pages_visited: int
    skipped: DataFrame
    failed: DataFrame


def page_links(pages: DataFrame) -> DataFrame:
    """(page_ord, place, href seen from the page) for every link of pages (final_url, html, page_ord)."""
    return html_records.page_links(pages.select(F.col("final_url").alias("url"), "html", "page_ord"), "page_ord")


def first_seen(links: DataFrame) -> DataFrame:
    """(url, page_ord, place): each URL once, where it was first."""
    at = F.min(F.struct("page_ord", "place"))
    return links.groupBy("url").agg(at.alias("at")).select("url", "at.page_ord", "at.place")


def unseen(links: DataFrame, seen: DataFrame) -> DataFrame:
    """(url, page_ord, place) of the links to places that ``seen`` (url) does not have, each once."""
    return first_seen(links).join(seen, "url", "left_anti").select("url", "page_ord", "place")


def numbered(df: DataFrame, start: int, *order: str) -> DataFrame:
    """An ordinal in the given order; ``df`` is a capped frontier."""
    return df.withColumn("page_ord", (F.row_number().over(Window.orderBy(*order)) + start - 1).cast("bigint"))


def visited_by(source, urls: DataFrame) -> DataFrame:
    """What a source fetched, once and for all; a source that is polite hears of it before the next turn."""
    fetched = cut(source.fetch(urls))
    source.heard(fetched)
    return fetched


def crawl(spark: SparkSession, config: EngineConfig, source, max_listing_pages: int | None = None, max_profile_pages: int | None = None, max_publications: int | None = None) -> CrawlOutput:
    """A cap of 0 stands for the default, but 0 profile pages are none. Failed pages do not use up the listing cap."""
    listings = max_listing_pages or config.max_listing_pages
    profiles = config.max_profile_pages if max_profile_pages is None else max_profile_pages
    wanted = max_publications or config.max_publications
    organisation = config.seed_url.partition("#")[0].partition("?")[0]
    organisation = "/" + organisation.split("://", 1)[-1].partition("/")[2].rstrip("/")

    queue = spark.createDataFrame([(config.seed_url, 0, 0)], _LINKS)
    seen = queue.select("url")
    got = None
    visited = tried = 0
    while visited < listings:
        turn = numbered(queue.orderBy("page_ord", "place").limit(listings - visited), tried, "page_ord", "place").select("url", "page_ord")
        fetched = visited_by(source, turn)
        n = fetched.count()
        if not n:
            break
        good = fetched.where("error_kind IS NULL")
        visited, tried = visited + good.count(), tried + n
        got = fetched if got is None else cut(got.unionByName(fetched))
        links = page_links(good).withColumn("url", without_fragment(F.col("link"))).where(is_listing_url(F.col("url"), organisation))
        rest = queue.join(fetched.select("url"), "url", "left_anti")
        new = unseen(links, seen)
        seen = cut(seen.union(new.select("url")))
        queue = cut(rest.unionByName(new))

    good = got.where("error_kind IS NULL")
    people = page_links(good).withColumn("url", canonical_url(F.col("link"))).where(path_below(F.col("link"), PERSONS))
    asked = numbered(first_seen(people).orderBy("page_ord", "place").limit(profiles), tried, "page_ord", "place").select("url", "page_ord")
    profile_pages = visited_by(source, asked)
    visited_profiles = profile_pages.where("error_kind IS NULL").count()
    pages = good.unionByName(profile_pages.where("error_kind IS NULL")).select(F.col("final_url").alias("url"), "html", "page_ord")

    found = summaries(pages).join(pages.select(F.col("url").alias("page_url"), "page_ord"), "page_url")
    first = Window.partitionBy("publication_url").orderBy("page_ord", "ord")
    once = found.withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")
    chosen = cut(once.orderBy("page_ord", "ord").limit(wanted))
    detail_pages = visited_by(source, chosen.select(F.col("publication_url").alias("url")))
    detail = details(detail_pages.where("error_kind IS NULL").select("url", "final_url", "html"))
    publications = combined(chosen, detail)
    every = got.select("url", "error_kind", "error").unionByName(profile_pages.select("url", "error_kind", "error")).unionByName(detail_pages.select("url", "error_kind", "error"))
    return CrawlOutput(cut(publications).orderBy("page_ord", "ord"), visited + visited_profiles, visited_profiles, every.where("error_kind = 'robots'").select("url"), every.where("error_kind = 'fetch'").select("url", "error"))


def run_row(spark: SparkSession, config: EngineConfig, output: CrawlOutput, saved: int, started_at, finished_at) -> DataFrame:
    """The crawl's one-row record; publications found are those extracted."""
    skipped = output.skipped.agg(F.collect_list("url").alias("skipped_by_robots"))
    failed = output.failed.agg(F.collect_list(F.struct("url", "error")).alias("failed_urls"))
    one = {"seed_url": F.lit(config.seed_url), "pages_visited": F.lit(output.pages_visited), "publications_found": F.lit(output.publications.count()), "publications_saved": F.lit(saved), "status": F.lit("completed"), "started_at": F.lit(started_at), "finished_at": F.lit(finished_at)}
    return skipped.crossJoin(failed).withColumns(one)


__all__ = ["CrawlOutput", "crawl", "first_seen", "numbered", "page_links", "run_row", "unseen", "url_path"]
