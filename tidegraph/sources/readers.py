"""Sources: page dumps, title lists, saved API responses, anchors in HTML, ranked tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.markup import matches_of
from tidegraph.functions.text import trimmed
from tidegraph.schemas import RAW_PAGE

#: Name spaces whose pages are not articles.
NAMESPACES = ("File", "Talk", "Special", "Wikipedia", "Wiktionary", "User", "User Talk", "Category", "Portal", "Template", "Mediawiki", "Help")


def is_article_title(title: Column, namespaces: tuple[str, ...] = NAMESPACES) -> Column:
    """Whether no name space (case-sensitive, before a colon) begins the title."""
    return ~title.rlike("^(" + "|".join(namespaces) + "):")


def read_dump(spark: SparkSession, path: str, namespaces: tuple[str, ...] = NAMESPACES) -> DataFrame:
    """title, id, redirect_to (null for articles), text of each page of an XML dump; .gz and .bz2 are inflated by suffix. Elements other
    than page are skipped; a page that cannot be decoded has nulls. Name-space pages are dropped in the scan."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(RAW_PAGE).load(path)
    pages = raw.select("title", "id", F.col("redirect._title").alias("redirect_to"), F.coalesce("revision.text", F.lit("")).alias("text"))
    return pages.where(F.col("title").isNotNull() & is_article_title(F.col("title"), namespaces))


def read_titles(spark: SparkSession, path: str, upper: bool = False, trim: bool = False) -> DataFrame:
    """Distinct titles, one a line; a carriage return before the line's end is no part of it. The last line needs no line end."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("title"))
    title = trimmed(F.col("title")) if trim else F.col("title")
    return lines.select((F.upper(title) if upper else title).alias("title")).where("title <> ''").distinct()


def read_saved_links(spark: SparkSession, path: str) -> DataFrame:
    """pos, title of the links in saved list responses ({"parse": {"links": [{"*": title}]}})."""
    pages = spark.read.schema("parse STRUCT<links: ARRAY<STRUCT<`*`: STRING>>>").option("multiLine", True).json(path)
    return pages.select(F.posexplode("parse.links").alias("pos", "link")).select("pos", F.col("link.`*`").alias("title"))


#: Titles that are no films.
NOT_FILMS = r"^Lists? of|^Template( talk)?:|^Category:|[0-9]{4}s? in film|[0-9]{4} film$"


def film_titles(links: DataFrame, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Links without list, template, category and year pages, and without forbidden titles."""
    return links.where(~F.col("title").rlike(NOT_FILMS) & ~F.col("title").isin(list(forbidden) or [""]))


def first_seen(items: DataFrame, item: str, pos: str) -> DataFrame:
    """Each item once, with its first position."""
    return items.groupBy(item).agg(F.min(pos).alias(pos))


ANCHOR = r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'


def anchors(html: Column, prefix: str = "") -> Column:
    """Array of (href, text) of anchors whose href begins with prefix and whose text is not empty; the text has no tags and is trimmed."""
    found = matches_of(html, ANCHOR, "href", "text")
    pairs = F.transform(found, lambda x: F.struct(x["href"].alias("href"), trimmed(F.regexp_replace(x["text"], "(?s)<[^>]*>", "")).alias("text")))
    return F.filter(pairs, lambda x: x["href"].startswith(prefix) & (x["text"] != ""))


def read_ranked_json(spark: SparkSession, path: str) -> DataFrame:
    """title, rank of a saved JSON array of {Title, Rank} objects."""
    return spark.read.schema("Title STRING, Rank DOUBLE").option("multiLine", True).json(path).select(F.col("Title").alias("title"), F.col("Rank").alias("rank"))


def read_categories(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """category, title of the lists at several paths, by the name of each."""
    lists = [read_titles(spark, path, trim=True).select(F.lit(name).alias("category"), "title") for name, path in paths.items()]
    return reduce(DataFrame.unionByName, lists) if lists else spark.createDataFrame([], "category string, title string")


def row_count(table: DataFrame) -> int:
    """The number of rows; Parquet footers alone answer it."""
    return table.count()
