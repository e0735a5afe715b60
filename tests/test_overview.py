from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import dates
from lexigraph.operators import browse
from lexigraph.operators.cache import ResultCache


def test_dates(spark):
    df = spark.sql("SELECT DATE'2024-07-01' AS d, '09:30' AS t, TIMESTAMP'2024-01-01 12:00:00' AS ts, CAST(NULL AS TIMESTAMP) AS none")
    got = df.select(dates.local_to_utc(F.col("d"), F.col("t"), "Europe/Berlin"), dates.local_to_utc(F.col("d"), F.lit("25:99"), "UTC"), dates.shown(F.col("ts"), "Asia/Kathmandu"), dates.shown(F.col("none")), dates.default_slot(F.col("ts"))).first()
    assert got[0] == datetime(2024, 7, 1, 7, 30) and got[1] is None and got[2] == "2024-01-01 17:45" and got[3] == "Unknown" and got[4] == datetime(2024, 1, 1, 12, 5)


def test_results_are_kept_until_old_or_outdated(spark):
    now, made = [0.0], []
    cache = ResultCache(60, lambda: now[0])

    def make():
        made.append(1)
        return spark.range(3)

    get = lambda version=0: cache.get("k", make, version)
    first = get()
    assert get() is first and first.is_cached and len(made) == 1
    assert get(1) is not first and len(made) == 2 and not first.is_cached
    now[0] = 61
    get(1)
    assert len(made) == 3
    cache.clear()
    assert not cache.held


def test_bounds():
    assert browse.bounded("search") == 10 and browse.bounded("profile_pages", 0) == 0
    for kind, value in (("browse", 4), ("search", 51), ("publications", 0)):
        with pytest.raises(ValueError):
            browse.bounded(kind, value)


def test_displays(spark):
    clusters = spark.createDataFrame([(0, 2, "A", ["x", "y"])], "cluster int, documents int, majority_category string, top_terms array<string>")
    assert browse.displayed_clusters(clusters).first()["top_terms"] == "x, y"
    hits = spark.createDataFrame([(1, "", 0.123456, ["a", "b"])], "rank int, title string, score double, matched_terms array<string>")
    assert tuple(browse.displayed_hits(hits).first()) == (1, "Untitled publication", "0.1235", "a, b")
    people = spark.createDataFrame([("k", "N", None, ["a"]), ("l", "M", "u", None)], "author_key string, name string, profile_url string, publication_keys array<string>")
    assert [tuple(r) for r in browse.displayed_authors(people).collect()] == [("N", 1, ""), ("M", 0, "u")]
    runs = spark.createDataFrame([("r", datetime(2024, 1, 1), "completed", 1, 2, 2, [("u", "e")])], "run_id string, finished_at timestamp, status string, pages_visited int, publications_found int, publications_saved int, failed_urls array<struct<url:string,error:string>>")
    assert browse.displayed_runs(runs).first()["failed"] == 1
    publications = spark.createDataFrame([("p", 2001)], "publication_key string, publication_year int")
    board = browse.dashboard({"publications": publications, "authors": people, "crawl_runs": runs, "idf": spark.range(5), "index_metadata": spark.createDataFrame([("publication_index", 1)], "name string, n int")})
    assert tuple(board["counts"].first()) == (1, 2, 1, 5) and board["authors"].first()["name"] == "M" and board["years"].first()[0] == 2001 and board["runs"].count() == 1 and board["metadata"].count() == 1
    with pytest.raises(ValueError):
        browse.dashboard({})
