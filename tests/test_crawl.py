import time
from datetime import datetime, timedelta, timezone

import pytest

from lexigraph.cli import main
from lexigraph.config import EngineConfig, read_settings
from lexigraph.operators.store import Store
from lexigraph.sources import html_records as records
from lexigraph.sources.pages import FETCHED, HttpPages, TablePages, Visitor
from lexigraph.streaming.crawl import crawl
from lexigraph.streaming.schedule import Schedule
from lexigraph.streaming.update import interval_seconds, run_forever, run_once, stream

ROOT = "https://portal.example"
SEED = f"{ROOT}/en/organisations/lab/"


def listing(*publications, more=""):
    return "<body><ul>" + "".join(f'<li class="result"><a href="/en/publications/{p}/?x=1#y">Title {p}</a> <a href="/en/persons/jane">Doe, J.</a> Research output: Article Open Access 2020</li>' for p in publications) + f"</ul>{more}</body>"


DETAIL = """<html><head><meta name="citation_title" content="Full p1"><meta name="citation_publication_date" content="2019/05"><meta property="citation_journal_title" content="Journal">
<meta name="citation_author" content="Jane Doe"><meta name="citation_author" content="Roe, R."></head><body><nav>menu</nav><h1>Other</h1><a href="/en/persons/jane">Doe, J.</a><a href="/en/persons/x">Persons</a>
<h2> Abstract </h2><p>First part.</p><div>Second</div><h2>Next</h2><p>no</p></body></html>"""
PAGES = [
    (SEED, listing("p1", "p2", more=f'<a href="{SEED}publications/?page=1">n</a><a href="{SEED}publications/?q=1">no</a><a href="/elsewhere">no</a>'), 200),
    (f"{SEED}publications/?page=1", listing("p2", "p3", more=f'<a href="{SEED}publications/?page=2">n</a>'), 200),
    (f"{SEED}publications/?page=2", "gone", 500),
    (f"{ROOT}/en/persons/jane", listing("p4"), 200),
    (f"{ROOT}/en/publications/p1", DETAIL, 200),
    (f"{ROOT}/en/publications/p3", "<h1>p3 page</h1>", 200),
]


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    return EngineConfig(seed_url=SEED, allowed_domain="portal.example", crawl_delay_seconds=0.5, store=str(tmp_path_factory.mktemp("store")))


@pytest.fixture(scope="module")
def source(spark):
    return TablePages(spark.createDataFrame(PAGES, "url string, html string, status_code int"), "portal.example", (f"{ROOT}/en/publications/p2",))


def test_records():
    got = records.summaries_of(listing("a", "a") + '<a href="/en/publications/a/">Last</a><a href="/en/publications/">all</a><a href="/en/publications/b"> </a>', SEED)
    assert [(r["publication_url"], r["title"], r["ord"]) for r in got] == [(f"{ROOT}/en/publications/a", "Last", 0)]
    page = records.detail_of(DETAIL, f"{ROOT}/en/publications/p1/?v=1")
    assert page["title"] == "Full p1" and page["source"] == "Journal" and page["abstract"] == "First part. Second" and "menu" not in page["full_text"] and page["publication_url"].endswith("/p1")
    assert [a["name"] for a in page["authors"]] == ["Doe, J.", "Jane Doe", "Roe, R."]
    assert records.detail_of(None, "")["title"] == "" and records.summaries_of("", SEED) == [] and records.detail_of("<title>t</title>", SEED)["title"] == "t"


def test_crawl(spark, config, source):
    out = crawl(spark, config, source)
    rows = out.publications.collect()
    assert [r["publication_url"].rpartition("/")[2] for r in rows] == ["p1", "p2", "p3", "p4"]
    first = rows[0]
    assert first["title"] == "Full p1" and first["publication_year"] == 2019 and first["publication_type"] == "Article" and first["crawled_from"] == SEED
    assert rows[1]["title"] == "Title p2" and rows[1]["publication_year"] == 2020
    assert out.pages_visited == 3 and out.profile_pages_visited == 1
    assert [r[0] for r in out.skipped.collect()] == [f"{ROOT}/en/publications/p2"]
    assert {r["url"] for r in out.failed.collect()} == {f"{SEED}publications/?page=2", f"{ROOT}/en/publications/p4"}
    capped = crawl(spark, config, source, max_listing_pages=1, max_profile_pages=0, max_publications=1)
    assert capped.publications.count() == 1 and capped.pages_visited == 1


def test_update_and_cli(spark, config, source, capsys):
    store = Store(spark, config.store)
    result = run_once(spark, config, source, store)
    assert result.crawl.publications.count() == result.saved == result.indexed == 4 and str(result).endswith(f"4 documents and {result.terms} terms are in the index")
    stored = store.read("document_vectors").collect()
    assert len(stored) == 4 and all(r["token_count"] >= r["unique_term_count"] == len(r["vector"]) > 0 and r["title"] for r in stored) and len({r["indexed_at"] for r in stored}) == 1
    run = store.read("crawl_runs").collect()
    assert len(run) == 1 and run[0]["status"] == "completed" and len(run[0]["failed_urls"]) == 2
    assert main(["search", "first part abstract"], config, source) == 0 and "Full p1 (2019)" in capsys.readouterr().out.splitlines()[0]
    assert main(["check-db"], config, source) == 0 and main(["crawl", "--dry-run"], config, source) == 0 and "Authors: Doe, J., Roe, R." in capsys.readouterr().out
    assert main(["crawl", "--skip-index"], config, source) == 0 and store.read("crawl_runs").count() == 2 and store.read("publications").count() == 4
    with pytest.raises(RuntimeError):
        main(["check-db"], EngineConfig())


def test_polite_visits():
    clock, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += seconds

    def get(url, agent, timeout):
        if url.endswith("robots.txt"):
            return url, 200, "User-agent: *\nDisallow: /no\nCrawl-delay: 3"
        if url.endswith("/down"):
            raise OSError("down")
        return url + "#final", 404 if url.endswith("/missing") else 200, "body"

    v = Visitor(EngineConfig(allowed_domain="portal.example"), get, lambda: clock[0], sleep)
    assert v.visit(f"{ROOT}/a")[:5] == (f"{ROOT}/a#final", "body", 200, None, None)
    assert v.visit(f"{ROOT}/b")[3] is None and slept == [3.0]
    assert v.visit(f"{ROOT}/no/x")[3] == "robots" and v.visit("https://other.org/")[3] == "robots" and v.visit("ftp://portal.example/")[3] == "robots"
    later = Visitor(EngineConfig(allowed_domain="portal.example"), lambda url, *a: (url, 200, "x") if "robots" not in url else 1 / 0, lambda: clock[0], sleep, {"portal.example": v.visit(f"{ROOT}/c")[:4:-1]})
    assert slept == [3.0, 3.0] and later.visit(f"{ROOT}/d")[3] is None and slept == [3.0] * 3 and later.visit(f"{ROOT}/no")[3] == "robots"
    assert v.visit(f"{ROOT}/down")[3] == "fetch" and v.visit(f"{ROOT}/missing")[2:4] == (404, "fetch")


def test_http_source(spark):
    def get(url, agent, timeout):
        return (url, 404, "") if url.endswith("robots.txt") else (url, 200, f"<p>{url}</p>")

    got = HttpPages(EngineConfig(allowed_domain="example", crawl_delay_seconds=0.0), get).fetch(spark.createDataFrame([(f"{ROOT}/{i}",) for i in range(3)], "url string"))
    assert got.columns == [c.split()[0] for c in FETCHED.split(", ")] and got.where("error_kind IS NULL").count() == 3


def test_schedule():
    soon = lambda s: datetime.now(timezone.utc) + timedelta(seconds=s)
    seen = []
    job = Schedule(lambda **caps: seen.append(caps) or "done")
    assert job.state.status == "idle"
    with pytest.raises(ValueError):
        job.at(soon(-1))
    job.at(soon(0.2).replace(tzinfo=None), max_publications=1)
    with pytest.raises(RuntimeError):
        job.at(soon(1))
    job.join(5)
    assert job.state.status == "completed" and job.state.result == "done" and seen == [{"max_publications": 1}]
    job.at(soon(30))
    assert job.cancel().status == "cancelled" and job.cancel().status == "cancelled"
    job.join(5)
    failing = Schedule(lambda **caps: 1 / 0)
    failing.at(soon(0.1))
    failing.join(5)
    assert failing.state.status == "failed" and "zero" in failing.state.error
    failing.reset()
    assert failing.state.status == "idle"


def test_intervals():
    assert interval_seconds(7) == 604800 and interval_seconds(1e-9) == 1
    with pytest.raises(ValueError):
        interval_seconds(0)
    done, waits = [], []
    run_forever(lambda: done.append(1), 1, sleep=waits.append, turns=2)
    assert len(done) == 3 and waits == [86400, 86400]
    run_forever(lambda: done.append(1), 1, run_immediately=False, sleep=waits.append, turns=1)
    assert len(done) == 4
    with pytest.raises(ZeroDivisionError):
        run_forever(lambda: 1 / 0, 1, sleep=waits.append, turns=1)
    run_forever(lambda: 1 / 0, 1, keep_going=True, sleep=waits.append, turns=1)


def test_stream_of_page_files(spark, tmp_path):
    pages, seen = str(tmp_path / "pages"), []
    df = spark.createDataFrame(PAGES, "url string, html string, status_code int")
    df.limit(2).write.mode("append").parquet(pages)
    read = lambda: stream(spark, pages, df.schema, lambda b, i: seen.append(b.count()), str(tmp_path / "cp")).awaitTermination()
    read()
    df.limit(3).write.mode("append").parquet(pages)
    read()
    assert seen == [2, 3]


def test_settings(tmp_path, monkeypatch):
    file = tmp_path / ".env"
    file.write_text("# c\n\nLEXIGRAPH_SEED_URL='s'\nLEXIGRAPH_MAX_PUBLICATIONS=3\nbroken\n")
    monkeypatch.setenv("LEXIGRAPH_MAX_PUBLICATIONS", "9")
    got = EngineConfig.from_env(file)
    assert read_settings(file)["LEXIGRAPH_SEED_URL"] == "s" and got.seed_url == "s" and got.max_publications == 9 and got.max_listing_pages == 5
    assert time and EngineConfig.from_env(tmp_path / "none").max_profile_pages == 10
