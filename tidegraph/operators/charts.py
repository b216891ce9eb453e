"""Summaries for charts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_year(rows: DataFrame, year: str, rank: str, id_col: str) -> DataFrame:
    """year, best (the id of greatest rank, then smallest id), best_rank, mass; rows without a year (null or -1) do not count."""
    best = F.max(F.struct(F.col(rank).alias("r"), (-F.col(id_col)).alias("back")))
    return rows.where(F.col(year).isNotNull() & (F.col(year) != -1)).groupBy(F.col(year).alias("year")).agg(best.alias("b"), F.sum(rank).alias("mass")).select("year", (-F.col("b.back")).alias("best"), F.col("b.r").alias("best_rank"), "mass")


def latest_years(years: DataFrame, n: int = 100) -> DataFrame:
    """The n latest years without the newest."""
    newest = years.orderBy(F.desc("year")).limit(n + 1)
    return newest.join(F.broadcast(newest.agg(F.max("year").alias("year"))), "year", "left_anti")


def label_years(years: DataFrame, every: int = 4) -> DataFrame:
    """Years at a distance of a multiple of every from the first."""
    first = years.agg(F.min("year").alias("first"))
    return years.crossJoin(F.broadcast(first)).where((F.col("year") - F.col("first")) % every == 0).drop("first")


def log_histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """bucket (of ln(value), that wide), n, frequency."""
    counts = rows.where(F.col(value) > 0).groupBy(F.floor(F.log(value) / width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("bucket", "n", (F.col("n") / F.col("total")).alias("frequency"))


def extent(rows: DataFrame, value: str) -> DataFrame:
    """One row: total, least, greatest."""
    return rows.agg(F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def tick_step(low: float, high: float, ticks: int) -> float:
    """The step of 1, 2 or 5 times a power of ten that cuts a range into about that many."""
    step = 10.0 ** math.floor(math.log10((high - low) / ticks))
    short = ticks / (high - low) * step
    return step * (10 if short <= 0.15 else 5 if short <= 0.35 else 2 if short <= 0.75 else 1)


def rounded_histogram(rows: DataFrame, value: str, ticks: int = 50, round_to: int = 10) -> DataFrame:
    """bucket, lower, upper, n, frequency of ln(value), empty buckets included: the domain is widened to whole steps of a scale of round_to
    ticks and cut at the steps of one of that many ticks. Values of 0 and less do not count; equal values make one bucket."""
    logs = rows.where(F.col(value) > 0).select(F.log(value).alias("x"))
    low, high, total = logs.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not total:
        return logs.select(F.lit(0).cast("long").alias("bucket"), F.col("x").alias("lower"), F.col("x").alias("upper"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("frequency"))
    if low < high:
        wide = tick_step(low, high, round_to)
        low, high = math.floor(low / wide) * wide, math.ceil(high / wide) * wide
        step = tick_step(low, high, ticks)
    else:
        step = 1.0
    first, last = math.ceil(round(low / step, 9)), max(math.floor(round(high / step, 9)), math.ceil(round(low / step, 9)) + 1)
    bucket = F.least(F.greatest(F.floor(F.col("x") / step).cast("long") - first, F.lit(0)), F.lit(last - first - 1)).alias("bucket")
    counts = logs.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(last - first).select(F.col("id").alias("bucket")).join(counts, "bucket", "left")
    lower = (F.col("bucket") + first) * step
    return every.select("bucket", lower.alias("lower"), (lower + step).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / total).alias("frequency"))
