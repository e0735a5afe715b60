"""Table schemas; readers and writers declare them and nothing is inferred."""

import re

AUTHOR = "name string, profile_url string, affiliation string"
PAGES = "url string, html string, status_code int"
PUBLICATIONS = (
    "publication_key string, title string, publication_url string, authors array<struct<name:string,profile_url:string,affiliation:string>>, author_keys array<string>, "
    "publication_year int, published_date string, source string, publication_type string, abstract string, full_text string, searchable_text string, crawled_from string, "
    "crawled_at timestamp, updated_at timestamp, first_seen_at timestamp"
)
AUTHORS = "author_key string, name string, profile_url string, affiliation string, publication_keys array<string>, first_seen_at timestamp, updated_at timestamp"
CRAWL_RUNS = (
    "run_id string, seed_url string, pages_visited int, publications_found int, publications_saved int, skipped_by_robots array<string>, "
    "failed_urls array<struct<url:string,error:string>>, status string, started_at timestamp, finished_at timestamp"
)
TABLES = {"publications": PUBLICATIONS, "authors": AUTHORS, "crawl_runs": CRAWL_RUNS}


def columns(table: str) -> list[str]:
    """A table's column names in order; nested fields are written without spaces."""
    return re.findall(r"(?:^|, )(\w+) ", TABLES[table])
