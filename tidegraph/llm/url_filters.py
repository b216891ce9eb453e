"""URL filters: exact host/path rules, and a path-template tree for what no rule decides.

All work is relational. Variable segments (numbers, hexadecimal ids, long mixed ids) are generalised lexically, so that a host
with a third of all urls becomes a few rows per template in the map-side aggregation. Then, from the root down, each branch is
compared with its pooled siblings by a G-test over (blocked, allowed, unlabelled) x (leaf, inner); a branch that does not differ
significantly (a rare one cannot) is merged with them into the wildcard ``*``. A template is rejected when its smoothed
labelled purity (blocked + smoothing * prior) / (labelled + smoothing), prior being the share of blocked among all labelled urls,
reaches ``min_purity`` with ``min_labelled`` labelled urls at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls without one. rules: (verdict, "host/path"), a list as long as one writes by hand,
    since all of them become one expression."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found, verdict = F.when(fits, text).otherwise(found), F.when(fits, kind).otherwise(verdict)
    return found, verdict


def shape_of(path: Column) -> Column:
    """The path's segments with variable parts as {n} (digits), {x} (hexadecimal with a digit, 8 and more), {id} (20 and more
    letters and digits with a digit)."""
    s = F.regexp_replace(path, r"(?<=/)(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=[/.]|$)", "{x}")
    s = F.regexp_replace(s, r"(?<=/)(?=[A-Za-z_-]*[0-9])[0-9A-Za-z_-]{20,}(?=[/.]|$)", "{id}")
    return F.regexp_replace(s, r"(?<![{\w])[0-9]+|[0-9]+(?=[/.]|$)", "{n}")


def template_tree(counts: DataFrame, critical: float = 16.0) -> DataFrame:
    """counts (host, shape, n, n_block, n_allow), one row a pair, with the template of each shape: host, shape, template.

    critical: the G value (5 degrees of freedom) from which a branch differs from its siblings; 16 is about p = 0.007. Each round takes every
    group of shapes with one beginning to where its shapes part, however deep, so there are as many rounds as partings on a path.
    """
    kinds = [f"c{i}" for i in range(6)]
    key = lambda depth: F.array_join(F.slice("seg", F.lit(1), depth), "/")
    rows = counts.select("host", "shape", "n", "n_block", "n_allow", F.split("shape", "/").alias("seg"), F.lit(1).alias("depth"), F.lit(True).alias("open"))
    while True:
        rows = stored(rows, "url-level")  # a round's plan reads its rows several times
        if rows.where("open").isEmpty():
            break
        live = rows.where("open").withColumn("prefix", key(F.col("depth")))
        ends = live.groupBy("host", "prefix", "depth").agg(F.min("seg").alias("low"), F.max("seg").alias("high"))
        # shapes of a group agree up to where the least and the greatest part; 0: there is but one shape
        parting = F.array_position(F.zip_with("low", "high", lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
        at = live.join(ends.select("host", "prefix", "depth", parting.alias("parting")), ["host", "prefix", "depth"])
        at = at.select("host", "shape", "n", "n_block", "n_allow", "seg", (F.col("parting") - 1).alias("d"), ((F.col("parting") > 0) & (F.size("seg") >= F.col("parting"))).alias("open"))
        at = at.withColumn("prefix", F.when(F.col("open"), key(F.col("d")))).withColumn("branch", F.when(F.col("open"), F.get("seg", F.col("d"))))
        leaf = F.size("seg") <= F.col("d") + 1
        none = F.col("n") - F.col("n_block") - F.col("n_allow")
        sums = [F.sum(F.when(leaf == F.lit(k < 3), v).otherwise(F.lit(0))).alias(kinds[k]) for k, v in enumerate([F.col("n_block"), F.col("n_allow"), none] * 2)]
        branches = at.where("open").groupBy("host", "prefix", "d", "branch").agg(*sums)
        pools = branches.groupBy("host", "prefix", "d").agg(F.count(F.lit(1)).alias("n_branches"), *[F.sum(k).alias(f"p{k}") for k in kinds]).where("n_branches > 1")
        total, pool = sum(F.col(k) for k in kinds), sum(F.col(f"p{k}") for k in kinds)
        rest = pool - total

        def part(seen: Column, share: Column, both: Column, pool=pool) -> Column:
            """2 * observed * ln(observed / expected)."""
            return F.when((seen > 0) & (both > 0), 2 * seen * F.log(seen * pool / (share * both))).otherwise(F.lit(0.0))

        g = sum(part(F.col(k), total, F.col(f"p{k}")) + part(F.col(f"p{k}") - F.col(k), rest, F.col(f"p{k}")) for k in kinds)
        merged = branches.join(pools, ["host", "prefix", "d"]).where(g < critical).select("host", "prefix", "d", "branch", F.lit(True).alias("merge"))
        moved = at.where("open").join(merged, ["host", "prefix", "d", "branch"], "left")
        seg = F.when(F.col("merge"), F.concat(F.slice("seg", F.lit(1), F.col("d")), F.array(F.lit("*")), F.slice("seg", F.col("d") + 2, F.size("seg")))).otherwise(F.col("seg"))
        columns = ["host", "shape", "n", "n_block", "n_allow"]
        moved = moved.select(*columns, seg.alias("seg"), (F.col("d") + 1).alias("depth"), F.lit(True).alias("open"))
        done = at.where("not open").select(*columns, "seg", F.lit(0).alias("depth"), "open").union(rows.where("not open"))
        rows = moved.union(done)
    return rows.select("host", "shape", "n", "n_block", "n_allow", F.array_join("seg", "/").alias("template"))


def judge_urls(urls: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", critical: float = 16.0, min_labelled: int = 20, smoothing: float = 10.0, min_purity: float = 0.9) -> DataFrame:
    """One row for each row of urls: id, host, path, rule, verdict, template, purity.

    Rules decide first (the longest that fits) and label the urls that they decide; templates of the same host decide the rest.
    Null urls and urls without :// have empty host and path, fit no rule, and are allowed unless their empty template is rejected,
    which no label can bring about. Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parts = urls.select(F.col(id_col).cast("long").alias(id_col), host.alias("host"), path.alias("path"))
    rule, decided = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), decided.alias("decided"), shape_of(F.col("path")).alias("shape"))
    hit = lambda v: F.count(F.when(F.col("decided") == v, 1))
    counts = stored(parts.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), hit("block").alias("n_block"), hit("allow").alias("n_allow")), "url-shapes")
    prior = counts.agg(F.coalesce(F.try_divide(F.sum("n_block"), F.sum(F.col("n_block") + F.col("n_allow"))), F.lit(0.0))).first()[0]
    tree = stored(template_tree(counts, critical), "url-templates")
    pure = tree.groupBy("host", "template").agg(F.sum("n_block").alias("b"), F.sum(F.col("n_block") + F.col("n_allow")).alias("k")).select(
        "host", "template", ((F.col("b") + smoothing * prior) / (F.col("k") + smoothing)).alias("purity"), (F.col("k") >= min_labelled).alias("enough"))
    verdicts = tree.select("host", "shape", "template").join(pure, ["host", "template"])
    out = parts.join(verdicts, ["host", "shape"], "left")
    method = F.when(F.col("enough") & (F.col("purity") >= min_purity), "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "template", "purity")
