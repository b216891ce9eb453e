"""Exact lookup, ranked prefix suggestions, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import normalised_title, plain_number, significant, trimmed


def title_index(pages: DataFrame, include_aliases: bool = True) -> DataFrame:
    """key (upper case), id, rank: of equal keys the greatest rank, then the smallest id."""
    names = F.array("title")
    if include_aliases and "aliases" in pages.columns:
        names = F.array_union(names, F.coalesce("aliases", F.array().cast("array<string>")))
    keys = pages.select(F.explode(names).alias("name"), "id", "rank").select(normalised_title(F.col("name")).alias("key"), "id", "rank")
    return keys.groupBy("key").agg(F.max(F.struct("rank", (-F.col("id")).alias("back"))).alias("best")).select("key", (-F.col("best.back")).alias("id"), F.col("best.rank").alias("rank"))


def lookup(index: DataFrame, title: str) -> DataFrame:
    return index.where(F.col("key") == F.upper(F.lit(title)))


def suggest(index: DataFrame, prefix: str, n: int = 10, distinct_pages: bool = False) -> DataFrame:
    """The n keys of greatest rank that begin with the prefix; with distinct_pages each page once, by its best key."""
    found = index.where(F.col("key").startswith(F.upper(F.lit(prefix))))
    if distinct_pages:
        found = found.groupBy("id").agg(F.max("rank").alias("rank"), F.min("key").alias("key")).select("key", "id", "rank")
    return found.orderBy(F.desc("rank"), "key").limit(n)


def suggest_many(index: DataFrame, prefixes: DataFrame, n: int = 10) -> DataFrame:
    """prefix, place, key, id, rank for many prefixes at once: keys are cut to the lengths that occur and meet prefixes in an equi-join."""
    asked = prefixes.select(F.upper("prefix").alias("prefix")).distinct().withColumn("size", F.char_length("prefix"))
    sizes = asked.agg(F.collect_set("size").alias("sizes"))  # as many numbers as lengths of prefixes
    cut = index.crossJoin(F.broadcast(sizes)).select("key", "id", "rank", F.explode("sizes").alias("size")).where(F.char_length("key") >= F.col("size"))
    met = cut.withColumn("prefix", F.substring(F.col("key"), F.lit(1), F.col("size"))).join(asked, ["prefix", "size"])
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("rank"), "key"))
    return met.withColumn("place", place).where(F.col("place") <= n).select("prefix", "place", "key", "id", "rank")


def compare(a: Column, b: Column) -> tuple[Column, Column]:
    """Ratio of the greater to the smaller rank (infinite if that alone is 0, 1 if both are), and its words: "about as" up to 1.05, else
    "n x more" without the space, n at 2 significant digits below 10, at 1 from there."""
    least, most = F.least(a, b), F.greatest(a, b)
    ratio = F.when(least != 0, F.try_divide(most, least)).when(most == 0, 1.0).when(least == 0, F.lit(float("inf")))
    number = F.when(ratio == float("inf"), "Infinity").when(ratio < 10, plain_number(significant(ratio, 2))).otherwise(plain_number(significant(ratio, 1)))
    return ratio, F.when(ratio <= 1.05, "about as").otherwise(F.concat(number, F.lit("x more")))


def said_of(name_a: Column, rank_a: Column, name_b: Column, rank_b: Column) -> Column:
    """The comparison as a sentence; it begins with the name of greater rank, or with a where they are equal."""
    words = compare(rank_a, rank_b)[1]
    first, second = F.when(rank_a >= rank_b, name_a).otherwise(name_b), F.when(rank_a >= rank_b, name_b).otherwise(name_a)
    return F.concat_ws(" ", first, F.lit("is"), words, F.when(words == "about as", "influential as").otherwise("influential than"), second)


def compare_titles(index: DataFrame, titles: list[str]) -> DataFrame:
    """key_a, key_b, ratio, said, sentence of exactly two titles; no row if one of them is not in the index."""
    if len(titles) != 2:
        raise ValueError("exactly two titles can be compared")
    a, b = (lookup(index, t).select(F.col("key").alias(f"key_{c}"), F.col("rank").alias(f"rank_{c}")) for t, c in zip(titles, "ab", strict=True))
    ratio, said = compare(F.col("rank_a"), F.col("rank_b"))
    sentence = said_of(F.col("key_a"), F.col("rank_a"), F.col("key_b"), F.col("rank_b"))
    return a.crossJoin(b).select("key_a", "key_b", ratio.alias("ratio"), said.alias("said"), sentence.alias("sentence"))


def pages_by_title(index: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows of pages that titles.title name (a title or an alias, in either case, trimmed); each page once."""
    asked = titles.select(F.upper(trimmed(F.col("title"))).alias("key")).distinct()
    return pages.join(index.join(asked, "key", "left_semi").select("id").distinct(), "id", "left_semi")


def page_by_order(ranked: DataFrame, order: int, column: str = "order") -> DataFrame:
    """The row at a 1-based place; none outside."""
    return ranked.where(F.col(column) == order)


def suggest_pages(index: DataFrame, pages: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    """Rows of pages behind suggest's keys, with key, by falling rank of the keys."""
    return suggest(index, prefix, n).select("key", "id", F.col("rank").alias("__rank")).join(pages, "id").orderBy(F.desc("__rank"), "key").drop("__rank")


def category_pages(index: DataFrame, pages: DataFrame, lists: DataFrame) -> DataFrame:
    """category, and the columns of pages: the pages that the titles of each category (lists: category, title) name, each once a category;
    titles that name none are left out."""
    asked = lists.select("category", F.upper(trimmed(F.col("title"))).alias("key")).distinct()
    return pages.join(asked.join(index.select("key", "id"), "key").select("category", "id").distinct(), "id")


def category_tables(index: DataFrame, pages: DataFrame, lists: DataFrame, n: int = 1000) -> DataFrame:
    """The n pages of greatest rank of each category, with position and percent_of_first (0 for the first)."""
    by_rank = Window.partitionBy("category").orderBy(F.desc("rank"), "id")
    kept = category_pages(index, pages, lists).withColumn("position", F.row_number().over(by_rank)).where(F.col("position") <= n)
    first = F.first("rank").over(by_rank)
    return kept.withColumn("percent_of_first", F.when(F.col("position") == 1, 0.0).otherwise(F.try_divide(100 * F.col("rank"), first)))
