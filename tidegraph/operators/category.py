"""Ranking within a list of titles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import normalised_title
from tidegraph.operators.ordering import with_position
from tidegraph.operators.pagerank import BETA


@dataclass(frozen=True)
class CategoryOptions:
    """num_items and num_influencers of 0 and less: all items, no influencers."""

    num_influencers: int = -1
    num_items: int = -1
    include_aliases: bool = True
    include_release_year: bool = False
    case_sensitive: bool = True
    pretty: bool = True


def keys_of(pages: DataFrame, case_sensitive: bool) -> DataFrame:
    """id, key: title and aliases of each page."""
    names = F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in pages.columns else F.array("title")
    return pages.select("id", F.explode(names).alias("key")).select("id", normalised_title(F.col("key"), case_sensitive).alias("key")).distinct()


def members(pages: DataFrame, titles: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Pages whose title or any alias is in titles.title; each once. Spark broadcasts the list where its measured size allows."""
    listed = titles.select(normalised_title(F.col("title"), case_sensitive).alias("key")).distinct()
    return pages.join(keys_of(pages, case_sensitive).join(listed, "key", "left_semi").select("id").distinct(), "id", "left_semi")


def unmatched(pages: DataFrame, titles: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Titles of the list that are no title or alias."""
    listed = titles.select(normalised_title(F.col("title"), case_sensitive).alias("title")).distinct()
    return listed.join(keys_of(pages, case_sensitive).select(F.col("key").alias("title")).distinct(), "title", "left_anti")


def conditional_ranks(category: DataFrame, rank: str = "rank") -> DataFrame:
    """page_rank: the share of the category's sum, which all matches make up, and position by it."""
    total = category.agg(F.sum(rank).alias("__sum"))
    shares = category.crossJoin(F.broadcast(total)).withColumn("page_rank", F.col(rank) / F.col("__sum")).drop("__sum")
    return with_position(shares, [F.desc(rank), F.asc("id")])


def influences(category: DataFrame, edges: DataFrame, beta: float = BETA, normalise: bool = True) -> DataFrame:
    """src, dst, influence between members: beta * rank(src) / out-degree(src) / rank(dst); degrees count all edges. Without normalise
    the plain flow rank(src) / out-degree(src)."""
    ranks = category.select("id", "rank")
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    flows = edges.join(ranks.select(F.col("id").alias("src"), F.col("rank").alias("r_src")), "src").join(degree, "src").join(ranks.select(F.col("id").alias("dst"), F.col("rank").alias("r_dst")), "dst")
    flow = F.col("r_src") / F.col("degree")
    return flows.select("src", "dst", (beta * flow / F.col("r_dst") if normalise else flow).alias("influence"))


def top_influencers(influence: DataFrame, n: int) -> DataFrame:
    """dst, src, influence, place of the n greatest for each dst (ties by src)."""
    place = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("influence"), "src"))
    return influence.withColumn("place", place).where(F.col("place") <= n)


def category_table(pages: DataFrame, edges: DataFrame, titles: DataFrame, options: CategoryOptions = CategoryOptions()) -> DataFrame:
    """title, pageRank, position, and what options ask for: aliases, releaseYear, influencers."""
    inside = members(pages, titles, options.case_sensitive)
    out = conditional_ranks(inside)
    if options.num_influencers > 0:
        best = top_influencers(influences(inside, edges), options.num_influencers).join(inside.select(F.col("id").alias("src"), F.col("title").alias("name")), "src")
        lists = best.groupBy(F.col("dst").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "influence"))), lambda x: F.struct(x["name"].alias("title"), x["influence"].alias("influence"))).alias("influencers"))
        out = out.join(lists, "id", "left")
    columns = [F.col("title"), F.col("page_rank").alias("pageRank"), F.col("position")]
    columns += [F.col("aliases")] * options.include_aliases + [F.col("release_year").alias("releaseYear")] * options.include_release_year + [F.col("influencers")] * (options.num_influencers > 0)
    if options.num_items > 0:
        out = out.where(F.col("position") <= options.num_items)
    return out.select(*columns).orderBy("position")
