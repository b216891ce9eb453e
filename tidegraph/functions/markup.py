"""Facts from page markup: comments, links, interlanguage titles, infobox, release year."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.functions.text import with_value

INFOBOX = T.StructType([T.StructField("infobox_type", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))])

#: Languages whose titles are kept; patterns of links, interlanguage links, the start of an infobox and its release line.
LANGUAGES = ("en", "nl", "de", "fr", "sv", "it", "es", "ru")
LINK = r"\[\[(?:([^|\]]*)\|)?([^\]]+)\]\]"
INFOBOX_START = re.compile(r"(?i){{ *Infobox *([^|}=]*)")
RELEASED = r"(?id)[|] *released *= *(.*)"


def without_comments(text: Column) -> Column:
    """Comments that open and close on one line are removed."""
    return F.regexp_replace(text, r"(?d)<!--(.*?)-->", "")


def without_section(title: Column) -> Column:
    return F.substring_index(title, "#", 1)


def matches_of(text: Column, pattern: str, *groups: str) -> Column:
    """Array of structs of the pattern's groups 1, 2, ... by these names, of each match in order; the text is searched once."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.struct(*(F.regexp_extract(m, pattern, k).alias(g) for k, g in enumerate(groups, 1))))


def link_titles(text: Column) -> Column:
    """Array of the targets of links, in order: the part before the first bar without its section; the rest where that part is missing
    or empty."""
    return F.transform(matches_of(text, LINK, "target", "rest"), lambda x: F.when(x["target"] == "", x["rest"]).otherwise(without_section(x["target"])))


def text_links(text: Column) -> Column:
    """Array of (article_title, count), by title. Titles are sorted once; each is counted from its first place to the next one's."""

    def runs(titles: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(titles) - 1), lambda k: (k == 0) | (F.get(titles, k) != F.get(titles, k - 1)))
        counted = with_value(first, lambda at: F.transform(at, lambda a, k: F.struct(F.get(titles, a).alias("article_title"), (F.coalesce(F.get(at, k + 1), F.size(titles)) - a).alias("count"))))
        return F.when(F.size(titles) > 0, counted).when(F.size(titles) == 0, F.array().cast("array<struct<article_title:string,count:int>>"))

    return with_value(F.sort_array(link_titles(text)), runs)


def language_titles(text: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """Map from language to title of [[language:title]]; the last of a language counts. As many passes over them as languages occur."""

    def last(found: Column) -> Column:
        kept = F.transform(F.array_distinct(F.transform(found, lambda x: x["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(found, lambda x: x["key"] == k), -1)["value"].alias("value")))
        return F.map_from_entries(kept)

    return with_value(matches_of(text, rf"\[\[({'|'.join(languages)}):(.*?)\]\]", "key", "value"), last)


def release_year(text: Column) -> Column:
    """The first four digits in the rest of the first "released =" line; -1 without."""
    line = F.regexp_extract(text, RELEASED, 1)
    return F.coalesce(F.regexp_extract(line, r"\d{4}", 0).try_cast("int"), F.lit(-1))


def parse_infobox(text: str | None) -> tuple[str, dict[str, str]] | None:
    """Type and attributes of the first infobox. Behind the type, a bar begins an attribute where braces are two deep and neither angle
    nor square brackets are open. Its name ends at the first equals sign of that depth; each further one, the next bar and the box's end
    set the value to what has come since the sign before, with the sign that ends it, if that is not empty. What no bar or end closes is lost;
    later names win."""
    start = INFOBOX_START.search(text or "")
    if not start:
        return None
    depth = {"{": 2, "<": 0, "[": 0}
    closing = {"}": "{", ">": "<", "]": "["}
    found: dict[str, str] = {}
    name, part, since = "", None, start.end()  # part: whether a name or a value is being read

    def ends(at: int, tail: str) -> None:
        nonlocal name
        held = text[since:at]
        if part == "name":
            name = held.strip()
        elif part == "value" and name and (value := (held + tail).strip()):
            found[name] = value

    for at in range(start.end(), len(text)):
        c = text[at]
        if c in depth:
            depth[c] += 1
        elif c in closing:
            depth[closing[c]] -= 1
            if c == "}" and depth["{"] == 0:
                both = text[at - 1] == "}" and at > since
                ends(at - both, "" if both else "}")
                break
        if c in "|=" and depth == {"{": 2, "<": 0, "[": 0}:
            ends(at, "=" if c == "=" and part == "value" else "")
            part, since = ("name" if c == "|" else "value"), at + 1
    return start[1].strip(), found


@F.udf(INFOBOX, useArrow=True)
def infobox(text):
    """The one function that no built-in expression states: a scanner with three depth counters."""
    got = parse_infobox(text)
    return None if got is None else {"infobox_type": got[0], "attributes": got[1]}


def first_of(attributes: Column, keys: tuple[str, ...], default: str = "") -> Column:
    """The value of the first key that the map has."""
    return F.coalesce(*[attributes[k] for k in keys], F.lit(default))
