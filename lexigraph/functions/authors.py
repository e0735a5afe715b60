"""Author name matching as column expressions, and the ordered fold that merges an author list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import author_key, present, squeezed

AUTHOR = "struct<author_key:string,name:string,profile_url:string,affiliation:string>"
# What an abbreviated given name costs a name's quality.
ABBREVIATED = 20
# What a name's match form drops, and how an abbreviated given name looks.
NOT_MATCHED, ABBREVIATION = r"[^a-z\s,]", r",\s*[A-Z](?:\.|$)"


def match_form(name: Column) -> Column:
    """Lower case, hyphens and everything but letters and commas as spaces, squeezed."""
    return squeezed(F.regexp_replace(F.replace(F.lower(name), F.lit("-"), F.lit(" ")), NOT_MATCHED, " "))


def signature(name: Column) -> Column:
    """struct(surname, initials, form): from "Surname, Given" or "Given Surname"."""
    form = match_form(name)
    comma = F.instr(form, ",") > 0
    pieces = F.filter(F.split(form, " "), lambda w: w != "")
    given = F.when(comma, F.filter(F.split(F.regexp_replace(form, "^[^,]*,", ""), " "), lambda w: w != "")).otherwise(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))))
    surname = F.when(comma, squeezed(F.regexp_extract(form, "^([^,]*),", 1))).otherwise(F.coalesce(F.try_element_at(pieces, F.lit(-1)), F.lit("")))
    return F.struct(surname.alias("surname"), F.array_distinct(F.transform(given, lambda w: F.substring(w, 1, 1))).alias("initials"), form.alias("form"))


def names_match(first: Column, second: Column) -> Column:
    """Equal surnames, or one the last words of the other, and a common initial; without initials the whole name."""
    return signatures_match(signature(first), signature(second))


def signatures_match(a: Column, b: Column) -> Column:
    """``names_match`` for signatures that are there already."""
    x, y = a["surname"], b["surname"]
    same = (x == y) | x.endswith(F.concat(F.lit(" "), y)) | y.endswith(F.concat(F.lit(" "), x))
    bare = (F.size(a["initials"]) == 0) | (F.size(b["initials"]) == 0)
    return F.when((x == "") | (y == "") | ~same, False).when(bare, a["form"] == b["form"]).otherwise(F.arrays_overlap(a["initials"], b["initials"]))


def name_quality(name: Column) -> Column:
    """The more letters the better; abbreviated given names count against it."""
    return F.length(F.regexp_replace(name, "[^A-Za-z]", "")) - F.when(name.rlike(ABBREVIATION), ABBREVIATED).otherwise(0)


def merged(authors: Column) -> Column:
    """An ordered array of authors with each merged into the first earlier one that it matches.

    The earlier key stays; the better name, and whichever profile and affiliation there is first, are kept. An author who
    matches none but has an earlier one's key, as names without Latin letters do, takes that one's place.
    """

    def same(old: Column, new: Column) -> Column:
        return F.coalesce(old["profile_url"] == new["profile_url"], F.lit(False)) | names_match(old["name"], new["name"])

    def join(old: Column, new: Column) -> Column:
        better = name_quality(new["name"]) > name_quality(old["name"])
        return F.struct(
            old["author_key"].alias("author_key"), F.when(better, new["name"]).otherwise(old["name"]).alias("name"),
            F.coalesce(present(old["profile_url"]), new["profile_url"]).alias("profile_url"), F.coalesce(present(old["affiliation"]), new["affiliation"]).alias("affiliation"),
        ).cast(AUTHOR)

    def add(held: Column, new: Column) -> Column:
        at = F.array_position(F.transform(held, lambda old: same(old, new)), True)
        known = F.array_position(F.transform(held, lambda old: old["author_key"]), new["author_key"])
        put = lambda place, value: F.transform(held, lambda old, i: F.when(i + 1 == place, value(old)).otherwise(old))
        return F.when(at > 0, put(at, lambda old: join(old, new))).when(known > 0, put(known, lambda old: new)).otherwise(F.concat(held, F.array(new)))

    keyed = F.transform(authors, lambda a: F.struct(author_key(a["name"], a["profile_url"]).alias("author_key"), a["name"].alias("name"), a["profile_url"].alias("profile_url"), a["affiliation"].alias("affiliation")).cast(AUTHOR))
    return F.aggregate(keyed, F.array().cast(f"array<{AUTHOR}>"), add)


def distinct_by_key(authors: Column) -> Column:
    """The first author of each key, in order; keys follow from the names and profiles as they are after merging."""
    keyed = F.transform(authors, lambda a: F.struct(author_key(a["name"], a["profile_url"]).alias("author_key"), a["name"].alias("name"), a["profile_url"].alias("profile_url"), a["affiliation"].alias("affiliation")).cast(AUTHOR))
    return F.aggregate(keyed, F.array().cast(f"array<{AUTHOR}>"), lambda held, a: F.when(F.exists(held, lambda h: h["author_key"] == a["author_key"]), held).otherwise(F.concat(held, F.array(a))))
