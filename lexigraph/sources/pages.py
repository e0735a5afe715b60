"""Page sources: a table of pages, or a polite HTTP client spread over executors by host.

A source turns (url) rows into (url, final_url, html, status_code, error_kind, error). error_kind is null, "robots" (also
for other domains) or "fetch"; nothing is raised for a page. ``heard`` tells a source what a fetch has brought, so that its
next one can go on from there.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.config import EngineConfig
from lexigraph.functions.text import on_domain

_FETCHED = "final_url string, html string, status_code int, error_kind string, error string"
#: A fetched page; answered_at is when its host last answered (seconds since 1970), rules the host's robots file if it was read.
FETCHED = f"url string, {_FETCHED}, answered_at double, rules string"
_COLUMNS = [c.split()[0] for c in FETCHED.split(", ")[1:]]

#: (url, user agent, timeout) -> (final url, status code, body); raises OSError where the network fails.
Get = Callable[[str, str, float], tuple[str, int, str]]


def http_get(url: str, user_agent: str, timeout: float) -> tuple[str, int, str]:
    import requests

    response = requests.get(url, headers={"User-Agent": user_agent}, timeout=timeout)
    return response.url, response.status_code, response.text


class TablePages:
    """Pages held in a table (url, html and maybe status_code and final_url); what is not there is a failed fetch."""

    def __init__(self, pages: DataFrame, allowed_domain: str = "", disallowed: tuple[str, ...] = ()):
        status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
        final = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
        self.pages = pages.select("url", "html", status.cast("int").alias("status_code"), final.alias("final_url")).dropDuplicates(["url"])
        self.allowed_domain, self.disallowed = allowed_domain, disallowed

    def blocked(self, url: F.col) -> F.col:
        out = ~on_domain(url, self.allowed_domain)
        for prefix in self.disallowed:
            out = out | url.startswith(prefix)
        return out

    def fetch(self, urls: DataFrame) -> DataFrame:
        got = urls.join(self.pages, "url", "left")
        failed = F.col("status_code").isNull() | (F.col("status_code") >= 400)
        kind = F.when(self.blocked(F.col("url")), "robots").when(failed, "fetch")
        error = F.when(kind == "robots", F.concat(F.lit("not allowed: "), F.col("url"))).when(kind == "fetch", F.concat(F.lit("failed: "), F.col("url"), F.lit(" "), F.coalesce(F.col("status_code").cast("string"), F.lit("missing"))))
        nothing = [F.lit(None).cast("double").alias("answered_at"), F.lit(None).cast("string").alias("rules")]
        return got.select(*urls.columns, F.when(kind.isNull(), F.col("final_url")).alias("final_url"), F.when(kind.isNull(), F.col("html")).alias("html"), "status_code", kind.alias("error_kind"), error.alias("error"), *nothing)

    def heard(self, fetched: DataFrame) -> None:
        """A table needs no pause."""


def robots_text(url: str, config: EngineConfig, get: Get) -> str:
    """The host's rules as text; empty where the file is missing or cannot be read, and then everything is allowed."""
    at = urlsplit(url)
    try:
        _, status, body = get(f"{at.scheme}://{at.netloc}/robots.txt", config.user_agent, config.request_timeout_seconds)
    except OSError:
        return ""
    return "" if status >= 400 else body


class Visitor:
    """One host's requests in turn: rules first, then a pause since the last answer, then the page.

    ``known`` has each host's rules and last answer from earlier turns.
    """

    def __init__(self, config: EngineConfig, get: Get, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, known: dict[str, tuple[str | None, float | None]] | None = None):
        self.config, self.get, self.clock, self.sleep = config, get, clock, sleep
        self.texts = {host: rules for host, (rules, _) in (known or {}).items() if rules is not None}
        self.answered = {host: at for host, (_, at) in (known or {}).items() if at is not None}
        self.rules: dict[str, RobotFileParser] = {}

    def rules_of(self, url: str) -> RobotFileParser:
        host = urlsplit(url).netloc
        if host not in self.rules:
            if host not in self.texts:
                self.texts[host] = robots_text(url, self.config, self.get)
            self.rules[host] = RobotFileParser()
            self.rules[host].parse(self.texts[host].splitlines())
        return self.rules[host]

    def visit(self, url: str) -> tuple[str | None, str | None, int | None, str | None, str | None, float | None, str | None]:
        at = urlsplit(url)
        if at.scheme not in ("http", "https") or not at.netloc.endswith(self.config.allowed_domain):
            return None, None, None, "robots", f"not allowed: {url}", None, None
        rules = self.rules_of(url)
        if not rules.can_fetch(self.config.user_agent, url):
            return None, None, None, "robots", f"not allowed: {url}", self.answered.get(at.netloc), self.texts[at.netloc]
        pause = float(rules.crawl_delay(self.config.user_agent) or self.config.crawl_delay_seconds)
        since = self.clock() - self.answered.get(at.netloc, float("-inf"))
        if since < pause:
            self.sleep(pause - since)
        try:
            final, status, body = self.get(url, self.config.user_agent, self.config.request_timeout_seconds)
        except OSError as e:
            return None, None, None, "fetch", f"failed: {url} {e}", self.answered.get(at.netloc), self.texts[at.netloc]
        self.answered[at.netloc] = self.clock()
        told = self.answered[at.netloc], self.texts[at.netloc]
        if status >= 400:
            return None, None, status, "fetch", f"failed: {url} {status}", *told
        return final, body, status, None, None, *told


class HttpPages:
    """Live pages. All URLs of a host go to one task, so its delay holds across the cluster.

    Between turns the driver keeps one entry a host that was visited: its rules and when it last answered.
    """

    def __init__(self, config: EngineConfig, get: Get = http_get):
        self.config, self.get = config, get
        self.known: dict[str, tuple[str | None, float | None]] = {}

    def fetch(self, urls: DataFrame) -> DataFrame:
        config, get, known = self.config, self.get, dict(self.known)
        names = urls.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            visitor = Visitor(config, get, known=known)
            for batch in batches:
                got = [visitor.visit(u) for u in batch["url"]]
                yield batch.assign(**{c: [g[i] for g in got] for i, c in enumerate(_COLUMNS)})

        schema = ", ".join(f"{n} {t}" for n, t in urls.dtypes) + ", " + FETCHED.partition(", ")[2]
        return urls.repartition(host_of(F.col("url"))).mapInPandas(run, schema).select(*names, *_COLUMNS)

    def heard(self, fetched: DataFrame) -> None:
        for row in fetched.groupBy(host_of(F.col("url")).alias("host")).agg(F.max("rules").alias("rules"), F.max("answered_at").alias("at")).where("rules IS NOT NULL OR at IS NOT NULL").collect():
            before = self.known.get(row["host"], (None, None))
            self.known[row["host"]] = (row["rules"] if row["rules"] is not None else before[0], row["at"] if row["at"] is not None else before[1])


def host_of(url: F.col) -> F.col:
    return F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1)
