"""Commands: crawl, check-db, build-index, search, scheduler."""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import functions as F

from lexigraph.config import EngineConfig
from lexigraph.operators.search import search, with_publications
from lexigraph.operators.store import Store
from lexigraph.session import session
from lexigraph.sources.pages import HttpPages
from lexigraph.streaming.crawl import crawl, run_row
from lexigraph.streaming.update import index_line, now, rebuild_index, run_forever, run_once, stored_index

CAPS = ("max_listing_pages", "max_profile_pages", "max_publications")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexigraph")
    sub = top.add_subparsers(dest="command", required=True)
    crawling, scheduling = sub.add_parser("crawl"), sub.add_parser("scheduler")
    for p in (crawling, scheduling):
        for cap in CAPS:
            p.add_argument(f"--{cap.replace('_', '-')}", type=int)
    crawling.add_argument("--dry-run", action="store_true")
    crawling.add_argument("--skip-index", action="store_true")
    scheduling.add_argument("--once", action="store_true")
    scheduling.add_argument("--interval-days", type=float)
    scheduling.add_argument("--no-run-immediately", action="store_true")
    sub.add_parser("check-db")
    sub.add_parser("build-index")
    searching = sub.add_parser("search")
    searching.add_argument("query")
    searching.add_argument("--limit", type=int, default=10)
    return top


def main(argv: list[str] | None = None, config: EngineConfig | None = None, source=None) -> int:
    args = parser().parse_args(argv)
    config = config or EngineConfig.from_env()
    if not config.store:
        raise RuntimeError("LEXIGRAPH_STORE names no store")
    spark = session()
    store = Store(spark, config.store)
    store.check()
    caps = {c: getattr(args, c) for c in CAPS if hasattr(args, c)}
    pages = source or HttpPages(config)
    if args.command == "check-db":
        print(f"Store OK: {config.store}")
    elif args.command == "build-index":
        print(index_line(*rebuild_index(store)))
    elif args.command == "search":
        found = with_publications(search(stored_index(store), args.query, args.limit), store.read("publications")).collect()
        if not found:
            print("nothing found")
        for p in found:
            print(f"{p['rank']:>3}  {p['score']:.4f}  {p['title'] or '(no title)'} ({p['publication_year'] or 'no year'})  {p['publication_url'] or ''}  [{' '.join(p['matched_terms'])}]")
    elif args.command == "crawl":
        started = now()
        output = crawl(spark, config, pages, **caps)
        print(f"Publications extracted: {output.publications.count()}\nPages visited: {output.pages_visited}\nProfile pages visited: {output.profile_pages_visited}\nSkipped: {output.skipped.count()}\nFailed: {output.failed.count()}")
        if args.dry_run:
            for p in output.publications.limit(5).select("title", "publication_url", F.array_join(F.transform("authors", lambda a: a["name"]), ", ").alias("by"), "publication_year").collect():
                print(f"\n{p['title']}\n{p['publication_url']}\nAuthors: {p['by'] or 'Unknown'}\nYear: {p['publication_year'] or 'Unknown'}")
            return 0
        saved = store.upsert_publications(output.publications.withColumn("ord", F.struct("page_ord", "ord")).drop("page_ord"))
        print(f"Saved: {saved}\nCrawl run: {store.save_run(run_row(spark, config, output, saved, started, now()))}")
        print("The index stays as it was." if args.skip_index else index_line(*rebuild_index(store)))
    else:
        update = partial(run_once, spark, config, pages, store, **caps)
        if args.once:
            print(update())
        else:
            run_forever(update, args.interval_days or config.scheduler_interval_days, not args.no_run_immediately)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
