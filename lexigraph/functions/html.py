"""Page fields by column expressions, for fields that need no document tree.

Elements that lie inside others of their own name need the tree of ``sources.html_records``.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeezed

# Elements whose text is not part of a page's visible text.
HIDDEN = ("script", "style", "nav", "footer", "header", "noscript")
#: Names of character references: those that end in a semicolon, and older ones that may do without.
NAMED = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
BARE = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
#: Numbers that stand for another letter: those of the Windows code page's upper control block.
RENUMBERED = {i: bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The table is one literal of the plan."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key)


def _numbered(number: Column) -> Column:
    """The letter of a code point; what is none becomes the replacement letter."""
    none = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(F.when(none, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")
    return F.coalesce(F.nullif(_lookup({str(k): v for k, v in RENUMBERED.items()}, number.cast("string")), F.lit("")), letter)


def decoded(text: Column, ended: bool = False) -> Column:
    """The text with its character references replaced: named, decimal and hexadecimal ones.

    With ``ended``, only those that end in a semicolon.
    """
    if ended:
        text = opened(text)
    bare = "|".join(sorted(BARE, key=lambda k: (-len(k), k)))

    def first(piece: Column) -> Column:
        """A piece that begins with an ampersand."""
        part = lambda pattern: F.nullif(F.regexp_extract(piece, pattern, 1), F.lit(""))
        decimal, hexadecimal, name, short = part("^&#([0-9]+);?"), part("^&#[xX]([0-9a-fA-F]+);?"), part("^&([A-Za-z][A-Za-z0-9]*;)"), part(f"^&({bare})")
        number = F.coalesce(F.when(F.length(decimal) <= 9, decimal.cast("bigint")), F.when(F.length(hexadecimal) <= 8, F.conv(hexadecimal, 16, 10).cast("bigint")))
        named = _lookup(NAMED, name)
        return (
            F.when(decimal.isNotNull() | hexadecimal.isNotNull(), F.concat(_numbered(number), F.regexp_replace(piece, "^&#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")))
            .when(named.isNotNull(), F.concat(named, F.substring(piece, F.length(name) + 2, F.length(piece))))
            .when(short.isNotNull(), F.concat(_lookup(BARE, short), F.substring(piece, F.length(short) + 2, F.length(piece))))
            .otherwise(piece)
        )

    pieces = F.split(text, "(?=&)")
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, lambda piece: F.when(piece.startswith("&"), first(piece)).otherwise(piece)), "")).otherwise(text)


def opened(text: Column) -> Column:
    """The text with a reference put for each ampersand that begins none that ends in a semicolon: decoding leaves it as it is."""
    return F.regexp_replace(text, "&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)", "&amp;")


def without_tags(html: Column, ended: bool = False) -> Column:
    return squeezed(decoded(F.regexp_replace(html, "(?s)<[^>]*>", " "), ended))


def uncommented(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->", " ")


def without_elements(html: Column, names: tuple[str, ...]) -> Column:
    for name in names:
        html = F.regexp_replace(html, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    return html


def visible_text(html: Column, ended: bool = False) -> Column:
    return without_tags(without_elements(uncommented(html), HIDDEN), ended)


def inside(html: Column, tag: str, ended: bool = False) -> Column:
    """The text of the first element of a name; empty if there is none."""
    return without_tags(F.regexp_extract(F.coalesce(html, F.lit("")), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), ended)


def links(html: Column) -> Column:
    """The href values of a page's links in order: in double, single or no quotes, outside comments, scripts and styles."""
    bare = without_elements(uncommented(html), ("script", "style"))
    between = r"""(?:\s+(?!href[\s=])[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*"""
    found = F.regexp_extract_all(bare, F.lit(rf"""(?is)<a\b{between}\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(found, lambda x: decoded(F.trim(F.regexp_replace(x, r"""^["']|["']$""", ""))))
