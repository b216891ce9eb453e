"""PageRank by power iteration, mass that leaks put back evenly."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidegraph.operators.storage import stored

BETA, EPSILON = 0.85, 1e-4
POWERS, AT_ONCE = 8, 16  # steps that keep powers, steps tried by one job where no edges are needed


def factors(k: int, back: list[float]) -> list[float]:
    """Of v_0 to v_k in the ranks after k steps; back: the mass put back by each step so far."""
    return [*reversed(back[:k]), 1.0]


def pagerank(vertices: DataFrame | None, edges: DataFrame, beta: float = BETA, epsilon: float = EPSILON, max_iter: int = 1000, repeated: bool = False) -> DataFrame:
    """id, rank. vertices: distinct id, or None for the ends of the edges; edges: src, dst between vertices, each row counting once, or, with
    repeated, each pair once: copies meet where edges are dealt by source, which they need anyway.

    r' = B r + c / n, where B r is the sum over in-edges of beta * r / out-degree and c = 1 - sum(B r); ends after the first step whose L1
    change is epsilon at most. c follows from the rank of vertices with out-edges in the step before, so that a step is one job: ranks, dealt by
    vertex, meet edges that stay where they were dealt and sorted by source, contributions are pre-aggregated per task, and the write of the
    step's table observes the change and the next sum. The table of the step before is then deleted. A lost executor costs its edges (from their
    table) and a step.

    Written out, r_k = (v_k + sum over j < k of c_(k-1-j) v_j) / n with v_j = B^j 1. The first steps keep v_j, which is 0 where no walk of j edges
    ends, and send along edges from other vertices only. Where v_j is 0 everywhere (no cycles) all later steps are sums of the kept columns by
    known factors: their changes are taken by one job for AT_ONCE steps, without edges. Otherwise the ranks themselves go on.
    """
    if not hasattr(edges, "_stored_at"):
        edges = stored(edges.select("src", "dst"), "edges")
    lanes = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.select("src", "dst").repartition(lanes, "src")
    dealt = (dealt.distinct() if repeated else dealt).sortWithinPartitions("src").persist()

    def received(state: DataFrame, rank: Column) -> DataFrame:
        flows = state.where(F.col("degree").isNotNull() & (rank > 0)).select(F.col("id").alias("src"), (beta * rank / F.col("degree")).alias("flow"))
        return dealt.join(flows, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("flow").alias("raw"))

    def observed(step: DataFrame, rank: str, moved: Column) -> tuple[DataFrame, Observation]:
        seen = Observation()
        out = F.coalesce(F.sum(F.when(F.col("degree").isNotNull(), F.col(rank))), F.lit(0.0))
        return step.observe(seen, F.sum(F.abs(moved)).alias("delta"), out.alias("kept"), F.count(F.when(F.col(rank) > 0, 1)).alias("reached")), seen

    try:
        degree = dealt.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        first = received(degree, F.lit(1.0)).withColumnRenamed("raw", "v1")
        if vertices is None:
            some = F.col("id").isNotNull()
            ends = degree.select("id", F.when(some, F.col("degree")).alias("degree"), F.lit(0.0).alias("v1"))
            ends = ends.union(first.select("id", F.lit(None).cast("long"), F.when(some, F.col("v1")).otherwise(0.0)))
            state = stored(ends.groupBy("id").agg(F.max("degree").alias("degree"), F.sum("v1").alias("v1")), "ranks")
        else:
            state = stored(vertices.select("id").join(degree, "id", "left").join(first, "id", "left").select("id", "degree", F.coalesce("v1", F.lit(0.0)).alias("v1")), "ranks")
        n, outs, held, reached = state.agg(F.count(F.lit(1)), F.count("degree"), F.coalesce(F.sum(F.when(F.col("degree").isNotNull(), F.col("v1"))), F.lit(0.0)), F.count(F.when(F.col("v1") > 0, 1))).first()
        if not n:
            return state.select("id", F.lit(0.0).alias("rank"))
        back, kept, k = [1 - beta * outs / n], [outs, held], 1

        def mixed(by: list[float]) -> Column:
            """The kept powers, each by its factor, over n."""
            return sum((F.lit(f / n) * F.col(f"v{j}") for j, f in enumerate(by[1 : len(kept)], 1)), F.lit(by[0] / n))

        def change(k: int) -> Column:
            return mixed([a - b for a, b in zip_longest(factors(k, back), factors(k - 1, back), fillvalue=0.0)])

        def kept_after(k: int) -> float:
            return sum(f * s for f, s in zip(factors(k, back), kept, strict=False)) / n

        if state.agg(F.sum(F.abs(change(1)))).first()[0] <= epsilon:
            return state.select("id", mixed(factors(1, back)).alias("rank"))
        while reached and k < min(POWERS, max_iter):
            back.append(1 - beta * kept_after(k))
            before, k = F.col(f"v{k}"), k + 1
            step = state.join(received(state, before), "id", "left").withColumn(f"v{k}", F.coalesce("raw", F.lit(0.0))).drop("raw")
            kept.append(0.0)  # for the column itself
            step, seen = observed(step, f"v{k}", change(k))
            state = stored(step, "ranks", instead_of=state)
            kept[k], reached = seen.get["kept"], seen.get["reached"]
            if seen.get["delta"] <= epsilon:
                return state.select("id", mixed(factors(k, back)).alias("rank"))
        while not reached and k < max_iter:
            ahead = range(k + 1, min(k + AT_ONCE, max_iter) + 1)
            for i in ahead:
                back.append(1 - beta * kept_after(i - 1))
            deltas = state.agg(*[F.sum(F.abs(change(i))) for i in ahead]).first()
            for i, delta in zip(ahead, deltas, strict=True):
                if delta <= epsilon:
                    return state.select("id", mixed(factors(i, back)).alias("rank"))
            k = ahead[-1]
        held, now = kept_after(k), state.select("id", "degree", mixed(factors(k, back)).alias("rank"))
        for _ in range(k, max_iter):
            new = F.coalesce("raw", F.lit(0.0)) + F.lit((1 - beta * held) / n)
            step = now.withColumnRenamed("rank", "before").join(received(now, F.col("rank")), "id", "left").select("id", "degree", "before", new.alias("rank"))
            step, seen = observed(step, "rank", F.col("rank") - F.col("before"))
            now = state = stored(step.drop("before"), "ranks", instead_of=state)
            held = seen.get["kept"]
            if seen.get["delta"] <= epsilon:
                return state.select("id", "rank")
    finally:
        dealt.unpersist()
    raise RuntimeError(f"no convergence within {max_iter} steps")
