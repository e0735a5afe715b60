"""Text functions as column expressions: tokens, stop words, stems, search text, cleaning, ids, years, URLs.

Nothing here leaves the JVM, so scans, tokenising and aggregation stay in one generated stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not indexed.
STOP_WORDS = "a an and are as at be been by for from has have in into is it its of on or that the their this to was were with".split()
# Suffixes in the order in which they are tried, and what replaces them.
SUFFIXES = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("ments", "ment"),
    ("ingly", ""), ("edly", ""), ("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""),
]
# Shortest indexed word, longest word left unstemmed, shortest stem.
SHORTEST_WORD, UNSTEMMED, SHORTEST_STEM = 3, 4, 3


def present(column: Column | str) -> Column:
    """The column with empty strings as nulls."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(c, F.lit(""))


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, in order; may hold empty strings at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")


def is_indexed(word: Column) -> Column:
    return (F.length(word) >= SHORTEST_WORD) & ~word.isin(STOP_WORDS)


def stem(word: Column) -> Column:
    """The first suffix that fits and leaves SHORTEST_STEM letters is replaced; short words stay."""
    size = F.length(word)
    rules = [(word.endswith(end) & (size >= len(end) + SHORTEST_STEM), F.concat(F.substring(word, F.lit(1), size - len(end)), F.lit(put))) for end, put in SUFFIXES]
    return reduce(lambda c, rule: c.when(*rule), rules, F.when(size <= UNSTEMMED, word)).otherwise(word)


def terms(text: Column) -> Column:
    """The array of index terms of a text; a term's position is its place here."""
    return F.transform(F.filter(words(text), is_indexed), stem)


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def joined(*parts: Column) -> Column:
    """The parts that are neither null nor empty, separated by spaces."""
    return F.trim(F.concat_ws(" ", *(present(p) for p in parts)))


def author_names(authors: str = "authors") -> Column:
    return F.array_join(F.transform(authors, lambda a: a["name"]), " ")


def searchable_text() -> Column:
    """What is stored with a publication for search: all its fields, then its full text."""
    return joined(F.col("title"), author_names(), F.col("publication_year").cast("string"), F.col("source"), F.col("publication_type"), F.col("abstract"), F.col("full_text"))


def indexed_text() -> Column:
    """What is indexed: the fields once more before the searchable text that holds them, so they weigh double."""
    return joined(F.col("title"), author_names(), F.col("publication_year").cast("string"), F.col("source"), F.col("publication_type"), F.col("abstract"), F.col("searchable_text"))


def stable_id(value: Column) -> Column:
    return F.sha2(value, 256)


def author_key(name: Column, profile_url: Column) -> Column:
    """By profile where there is one, else by name without regard to case and spacing."""
    return F.coalesce(stable_id(present(profile_url)), stable_id(F.lower(squeezed(name))))


def year_in(text: Column) -> Column:
    """The first free-standing number from 1900 to 2099."""
    return present(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(?:19|20)[0-9]{2}\b", 0)).cast("int")


# Where a publication type is found and what ends it.
TYPE_PATTERN = r"Research output:\s*(.+?)(?:\s+Open Access|\s+File|\s+\d+\s+Downloads|$)"


def publication_type(text: Column) -> Column:
    return present(squeezed(F.regexp_extract(F.coalesce(text, F.lit("")), TYPE_PATTERN, 1)))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def canonical_url(url: Column) -> Column:
    """Without fragment, query, parameters and trailing slashes."""
    bare = F.regexp_replace(F.regexp_replace(without_fragment(url), r"\?.*$", ""), r";[^/]*$", "")
    return F.regexp_replace(bare, r"(?<![:/])/+$", "")


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(without_fragment(url), r"\?.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def url_query(url: Column) -> Column:
    return F.regexp_extract(without_fragment(url), r"\?(.*)$", 1)


def folded(path: Column) -> Column:
    """A path from the root with its "." and ".." segments followed."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    step = lambda held, x: F.when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(x == ".", held).otherwise(F.concat(held, F.array(x)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    end = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``, for absolute, protocol-relative, root-relative, query, fragment and plain relative links."""
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    path = F.regexp_replace(href, r"[?#].*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(url_path(base) == "", F.lit("/")).otherwise(F.regexp_replace(url_path(base), r"[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, folded(path), tail))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(without_fragment(base), href))
        .otherwise(F.concat(origin, folded(F.regexp_replace(F.concat(folder, path), "/+", "/")), tail))
    )


def path_below(url: Column, prefix: str) -> Column:
    """Whether the path lies below a collection; the collection page itself does not."""
    return F.regexp_replace(url_path(url), "/+$", "").startswith(prefix.rstrip("/") + "/")


def is_listing_url(url: Column, organisation_path: str) -> Column:
    path, query = url_path(url), url_query(url)
    return path.startswith(organisation_path) & path.contains("/publications") & ((query == "") | query.startswith("page="))


def on_domain(url: Column, domain: str) -> Column:
    """http or https on a host that ends with ``domain``; the port and user information count as part of the host."""
    host = F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1)
    return url.rlike("^(?i:https?)://") & host.endswith(domain)
