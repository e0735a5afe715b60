"""Publication and author records from pages, where they need the document tree.

One tree parse a page on the standard library's parser; Arrow carries pages in and records out. Author lists leave as
found and are merged afterwards by the column expressions of ``functions.authors``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.authors import distinct_by_key, merged
from lexigraph.functions.text import present, publication_type, stable_id, year_in

# Paths of publications and persons, metadata names by priority, containers of a result, rejected names.
PUBLICATIONS, PERSONS = "/en/publications/", "/en/persons/"
TITLE_METAS = ("citation_title", "og:title")
DATE_METAS = ("citation_publication_date", "citation_date", "article:published_time")
SOURCE_METAS = ("citation_journal_title", "citation_conference_title", "citation_publisher")
AUTHOR_METAS = ("citation_author",)
CONTAINERS, CONTAINER_CLASSES = ("li", "article"), ("result", "portal_list_item", "rendering")
HIDDEN = ("script", "style", "nav", "footer", "header", "noscript")
NOT_NAMES = ("profiles", "persons")
# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

AUTHORS = "array<struct<name:string,profile_url:string,affiliation:string>>"
LINKS = "place int, link string"
SUMMARY = f"page_url string, ord int, publication_url string, title string, full_text string, authors {AUTHORS}"
DETAIL = f"requested_url string, publication_url string, title string, published_date string, source string, abstract string, full_text string, authors {AUTHORS}"


@dataclass
class Node:
    name: str
    attributes: dict[str, str]
    parent: "Node | None" = None
    children: list["Node | str"] = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        """All elements below, in document order, without recursion."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, without: tuple[str, ...] = ()) -> str:
        parts, todo = [], list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.name not in without:
                todo += reversed(node.children)
        return squeeze(" ".join(parts))


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("[page]", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {}, self.open)
        for k, v in attrs:
            node.attributes[k] = v or ""
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.open
        while node is not self.root and node.name != tag:
            node = node.parent
        if node is not self.root:
            self.open = node.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)


def squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


def tree(html: str | None) -> Node:
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def canonical(url: str) -> str:
    at = urlsplit(url.partition("#")[0])
    path, last = at.path.rpartition("/")[::2]
    joined = f"{path}/{last.partition(';')[0]}" if "/" in at.path else last.partition(";")[0]
    return urlunsplit((at.scheme, at.netloc, joined.rstrip("/"), "", ""))


def links(node: Node, base: str) -> Iterator[tuple[Node, str]]:
    for a in node.walk():
        if a.name == "a" and "href" in a.attributes:
            try:
                yield a, urljoin(base, a.attributes["href"])
            except ValueError:
                continue


def below(url: str, prefix: str) -> bool:
    return urlsplit(url).path.rstrip("/").startswith(prefix)


def metas(page: Node, names: tuple[str, ...]) -> list[str]:
    """Non-blank values by priority of the name, then in document order."""
    all_metas = [n.attributes for n in page.walk() if n.name == "meta"]
    return [value for name in names for a in all_metas if (a.get("name") or a.get("property")) == name and (value := squeeze(a.get("content")))]


def container(link: Node) -> Node:
    node = link.parent
    while node is not None and node.parent is not None:
        classes = node.attributes.get("class", "").lower()
        if node.name in CONTAINERS or any(c in classes for c in CONTAINER_CLASSES):
            return node
        node = node.parent
    return link.parent or link


def authors(node: Node, base: str, whole_page: bool) -> list[dict]:
    """Person links, then, for whole pages, author metadata; unmerged."""
    out = []
    for a, url in links(node, base):
        name = a.text()
        if below(url := canonical(url), PERSONS) and name and not name.lower().startswith("image") and name.lower() not in NOT_NAMES:
            out.append({"name": name, "profile_url": url, "affiliation": None})
    if whole_page:
        out += [{"name": name, "profile_url": None, "affiliation": None} for name in metas(node, AUTHOR_METAS)]
    return out


def abstract(page: Node) -> str | None:
    """The element siblings after the first heading "abstract", up to the next heading."""
    heading = next((n for n in page.walk() if re.fullmatch("h[1-6]", n.name) and n.text().lower() == "abstract"), None)
    if heading is None:
        return None
    after = heading.parent.children
    parts = []
    for node in after[next(i for i, n in enumerate(after) if n is heading) + 1 :]:
        if isinstance(node, Node):
            if re.fullmatch("h[1-6]", node.name):
                break
            parts.append(node.text())
    return squeeze(" ".join(parts)) or None


def summaries_of(html: str | None, base: str) -> list[dict]:
    """A record a publication link with a title; a later link to the same place replaces an earlier one in its position."""
    found: dict[str, dict] = {}
    for a, url in links(tree(html), base):
        url, title = canonical(url), a.text()
        if below(url, PUBLICATIONS) and title:
            box = container(a)
            found[url] = {"publication_url": url, "title": title, "full_text": box.text(HIDDEN), "authors": authors(box, base, False)}
    return [{"page_url": base, "ord": i, **r} for i, r in enumerate(found.values())]


def links_of(html: str | None, base: str) -> list[str]:
    """Every link of a page as seen from it, in order."""
    return [url for _, url in links(tree(html), base)]


def page_links(pages: DataFrame, *carried: str) -> DataFrame:
    """(carried columns, place, link) for every link of pages (url, html)."""
    schema = ", ".join([*(f"{c} {t}" for c, t in pages.dtypes if c in carried), "links array<string>"])
    carried = tuple(c for c in pages.columns if c in carried)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [links_of(html, url or "") for url, html in zip(batch["url"], batch["html"])]
            yield batch[list(carried)].assign(links=found)

    found = pages.select("url", "html", *carried).mapInPandas(run, schema)
    return found.select(*carried, F.posexplode("links").alias("place", "link"))


def detail_of(html: str | None, url: str) -> dict:
    page = tree(html)
    first = lambda names: next(iter(metas(page, names)), None)
    named = lambda name: next((n.text() for n in page.walk() if n.name == name), "")
    return {
        "publication_url": canonical(url), "title": first(TITLE_METAS) or named("h1") or named("title"), "published_date": first(DATE_METAS), "source": first(SOURCE_METAS),
        "abstract": abstract(page), "full_text": page.text(HIDDEN), "authors": authors(page, url, True),
    }


def _with_fields(df: DataFrame) -> DataFrame:
    year = F.coalesce(year_in(F.col("published_date")), year_in(F.col("full_text")))
    return df.withColumns({"authors": merged(F.col("authors")), "publication_year": year, "publication_type": publication_type(F.col("full_text"))})


def summaries(pages: DataFrame) -> DataFrame:
    """One row a publication that a page (url, html) links to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for url, html in zip(batch["url"], batch["html"]) for r in summaries_of(html, url or "")], columns=[c.split()[0] for c in SUMMARY.split(", ")[:5]] + ["authors"])

    found = pages.select("url", "html").mapInPandas(run, SUMMARY)
    return _with_fields(found.withColumns({c: F.lit(None).cast("string") for c in ("published_date", "source", "abstract")}))


def details(pages: DataFrame) -> DataFrame:
    """The publication record of each page (url, html and, where it was another, the final_url that it came from)."""
    came_from = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"requested_url": asked} | detail_of(html, url or "") for asked, url, html in zip(batch["url"], batch["came_from"], batch["html"])]
            yield pd.DataFrame(rows, columns=["requested_url", "publication_url", "title", "published_date", "source", "abstract", "full_text", "authors"])

    return _with_fields(pages.select("url", came_from.alias("came_from"), "html").mapInPandas(run, DETAIL))


def combined(summary: DataFrame, detail: DataFrame) -> DataFrame:
    """Summaries with their details where there are any: the detail's field if it has one, its address included, authors of
    both by key. A detail belongs to the summary whose address was asked for."""
    fields = ("publication_url", "title", "published_date", "source", "abstract", "full_text", "authors", "publication_year", "publication_type")
    d = detail.select(F.col("requested_url").alias("asked"), *(F.col(c).alias(f"d_{c}") for c in fields))
    pick = lambda c: F.coalesce(present(f"d_{c}"), F.col(c)).alias(c)
    both = F.concat("authors", F.coalesce("d_authors", F.array().cast(summary.schema["authors"].dataType)))
    address = F.coalesce(present("d_publication_url"), F.col("publication_url"))
    return summary.join(d, summary["publication_url"] == d["asked"], "left").select(
        stable_id(address).alias("publication_key"), address.alias("publication_url"), *(pick(c) for c in ("title", "published_date", "source", "abstract", "full_text", "publication_type")),
        F.coalesce("d_publication_year", "publication_year").alias("publication_year"), distinct_by_key(both).alias("authors"), F.col("page_url").alias("crawled_from"), *[c for c in ("ord", "page_ord") if c in summary.columns],
    )
