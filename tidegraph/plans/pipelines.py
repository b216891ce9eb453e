"""The two pipelines from dump to ranked pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import coords, markup
from tidegraph.operators.ordering import ordered
from tidegraph.operators.pagerank import pagerank
from tidegraph.operators.resolve import build_graph, is_redirect, redirect_map, with_aliases
from tidegraph.operators.storage import stored


def parse_pages(dump: DataFrame, infobox_first: bool = False, strip_comments: bool = True, raw_coordinates: bool = False) -> DataFrame:
    """Parsed pages of read_dump's rows. The infobox is computed once, before what follows from it. The legacy pipeline keeps comments
    and takes coordinates by patterns over the raw text, the infobox's first."""
    text = markup.without_comments(F.col("text")) if strip_comments else F.col("text")
    base = stored(dump.select("title", "id", "redirect_to", text.alias("text")).withColumn("infobox", markup.infobox(F.col("text"))), "pages")
    return base.select(
        "title", "id", "redirect_to", "infobox",
        (coords.coordinate_raw(F.col("text")) if raw_coordinates else coords.coordinate(F.col("text"), F.col("infobox.attributes"), infobox_first)).alias("coordinate"),
        markup.language_titles(F.col("text")).alias("language_titles"), markup.text_links(F.col("text")).alias("text_links"), markup.release_year(F.col("text")).alias("release_year"),
    )


def rank_pages(pages: DataFrame, transitive: bool = False, strip_section: bool = False, redirect_links: bool = False, single_precision: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ranked articles (page columns, aliases, rank, order, outbound_count) and their edges. transitive, strip_section and redirect_links: the
    legacy pipeline's redirects. With single_precision ranks are floats."""
    pages = stored(pages, "parsed")
    vertices, edges = build_graph(pages, transitive, strip_section, redirect_links)
    edges = stored(edges, "edges")
    ranks = pagerank(vertices, edges)
    if single_precision:
        ranks = ranks.withColumn("rank", F.col("rank").cast("float"))
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("outbound_count"))
    articles = with_aliases(pages.where(~is_redirect()), redirect_map(pages, transitive, strip_section))
    return ordered(articles.join(ranks, "id").join(degree, "id", "left").withColumn("outbound_count", F.coalesce("outbound_count", F.lit(0)))), edges
