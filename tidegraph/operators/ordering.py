"""Order, slices, shares and top-k over ranked rows. A total order over all rows needs positions: rows are range-partitioned and sorted,
numbered as they are written, and the position is the row's number plus the counts of the partitions before, so that rows move once and no
task holds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.storage import stored


def with_position(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """df with its 1-based position (long) in the order of keys, which must be total."""
    at, part, place = "__at", "__part", "__place"
    # the id's upper bits are the partition's number, the lower 33 bits the row's in it
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "ordered")
    parts = rows.groupBy(F.shiftright(at, 33).alias(part)).count()  # a row a partition
    before = parts.select(part, F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(place))
    numbered = rows.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(before), part)
    return numbered.withColumn(name, F.col(place) + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(at, part, place)


def leading(df: DataFrame, end: int, keys: list[Column], name: str = "position", start: int = 0) -> DataFrame:
    """The rows that with_position numbers start + 1 to end, by a top-k of end rows: for slices near the first row."""
    first = df.orderBy(*keys).limit(end)
    return first.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long")).where(F.col(name) > start)


def ordered(ranked: DataFrame, rank: str = "rank", id_col: str = "id") -> DataFrame:
    """Rows with order, 1 for the greatest rank; equal ranks by id."""
    return with_position(ranked, [F.desc(rank), F.asc(id_col)], "order")


def top(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def order_range(rows: DataFrame, start: int, end: int, order: str = "order") -> DataFrame:
    """Rows start (0-based) up to end, exclusive; an end beyond the last row is clipped."""
    return rows.where((F.col(order) > start) & (F.col(order) <= end))


def neighbourhood(rows: DataFrame, at: int, order: str = "order", before: int = 5, width: int = 10) -> DataFrame:
    """width rows around the 0-based place at, from before rows before it."""
    start = max(0, at - before)
    return order_range(rows, start, start + width, order)


def with_shares(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """relative_rank (to the greatest), share (of the sum) and percent_of_first (0 for the greatest) by one global aggregate."""
    total = rows.agg(F.max(rank).alias("__first"), F.sum(rank).alias("__sum"))
    r = F.col(rank)
    return rows.crossJoin(F.broadcast(total)).withColumns({"relative_rank": r / F.col("__first"), "share": r / F.col("__sum"), "percent_of_first": F.when(r == F.col("__first"), 0.0).otherwise(100 * r / F.col("__first"))}).drop("__first", "__sum")
