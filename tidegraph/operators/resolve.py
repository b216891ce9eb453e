"""From parsed pages to a graph: redirects, aliases, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.markup import without_section
from tidegraph.operators.storage import stored


def is_redirect():
    return F.length(F.coalesce(F.col("redirect_to"), F.lit(""))) > 0


def redirect_map(pages: DataFrame, transitive: bool = False, strip_section: bool = False, max_rounds: int = 64) -> DataFrame:
    """title, target of each redirect. By default one hop, targets as written; transitive follows chains to their end by pointer jumping.
    Titles of a cycle, or that lead to one, are dropped. Of redirects with equal titles the one with the largest id counts.

    A round doubles what each pointer has jumped, so it ends a chain as long as any is left: once a round ends none, only cycles are."""
    target = without_section(F.col("redirect_to")) if strip_section else F.col("redirect_to")
    hops = pages.where(is_redirect()).groupBy("title").agg(F.max_by(target, "id").alias("target"))
    if not transitive:
        return hops
    state, before, last = stored(hops, "redirects"), None, None
    for _ in range(max_rounds):
        after = state.select(F.col("title").alias("target"), F.col("target").alias("next"))
        last = stored(state.join(after, "target", "left").select("title", "target", "next"), "redirects", instead_of=last)
        left = last.where("next is not null").count()
        if left in (0, before):
            return last.where("next is null").select("title", "target")
        state, before = last.select("title", F.coalesce("next", "target").alias("target")), left
    raise RuntimeError(f"redirects do not settle within {max_rounds} rounds")


def repeated_ids(pages: DataFrame) -> DataFrame:
    """id, n of the ids that several pages have; a graph needs none."""
    return pages.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def title_ids(pages: DataFrame) -> DataFrame:
    """title, id of the articles; of equal titles the largest id counts."""
    return pages.where(~is_redirect()).groupBy("title").agg(F.max("id").alias("id"))


def resolve_links(links: DataFrame, redirects: DataFrame, titles: DataFrame) -> DataFrame:
    """links (src, title, count) with the target's id as dst; a redirect has priority over an article; what resolves to nothing is dropped."""
    hop = links.join(redirects, "title", "left").select("src", "count", F.coalesce("target", "title").alias("title"))
    return hop.join(titles.withColumnRenamed("id", "dst"), "title").select("src", "dst", "count")


def edges_of(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self-loops."""
    return resolved.where("src <> dst").select("src", "dst").distinct()


def counted_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, count) without self-loops, counts of equal pairs added."""
    return resolved.where("src <> dst").groupBy("src", "dst").agg(F.sum("count").alias("count"))


def page_links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """src, title, count of the articles' own links; with redirects (title, target) also the links that redirect pages have, as links of the
    article that they lead to."""
    if redirects is not None:
        every = pages.select("title", "id", is_redirect().alias("redirect"), F.explode("text_links").alias("l"))
        ids = title_ids(pages)
        led = every.where("redirect").join(redirects, "title").select(F.col("target").alias("title"), "l").join(ids, "title").select("id", "l")
        links = every.where(~F.col("redirect")).select("id", "l").union(led)
        return links.select(F.col("id").alias("src"), F.col("l.article_title").alias("title"), F.col("l.count").alias("count"))
    return pages.where(~is_redirect()).select(F.col("id").alias("src"), F.explode("text_links").alias("l")).select("src", F.col("l.article_title").alias("title"), F.col("l.count").alias("count"))


def build_graph(pages: DataFrame, transitive: bool = False, strip_section: bool = False, redirect_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) and distinct edges (src, dst) of parsed pages, whose article ids must differ; with redirect_links the links of
    redirect pages count as links of their targets."""
    if twice := [r.id for r in repeated_ids(pages.where(~is_redirect())).limit(5).collect()]:
        raise ValueError(f"several articles have the id {', '.join(map(str, twice))}")
    redirects = redirect_map(pages, transitive, strip_section)
    resolved = resolve_links(page_links(pages, redirects if redirect_links else None), redirects, title_ids(pages))
    return pages.where(~is_redirect()).select("id"), edges_of(resolved)


def unresolved_redirects(pages: DataFrame) -> DataFrame:
    """Redirects whose target is no article: title, target."""
    return redirect_map(pages).join(title_ids(pages).select(F.col("title").alias("target")), "target", "left_anti").select("title", "target")


def aliases_of(redirects: DataFrame) -> DataFrame:
    """title, aliases (sorted) for each target."""
    return redirects.groupBy(F.col("target").alias("title")).agg(F.sort_array(F.collect_list("title")).alias("aliases"))


def with_aliases(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    return pages.join(aliases_of(redirects), "title", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
