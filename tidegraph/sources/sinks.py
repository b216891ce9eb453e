"""Sinks: Parquet, JSON, text, one JSON document, printed lines."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def json_document(df: DataFrame, pretty: bool = True) -> str:
    """One JSON array of the rows in their order, keys sorted, tabs as indent; for results with a limit, since the driver holds it."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()]
    return json.dumps(rows, sort_keys=True, ensure_ascii=False, indent="\t" if pretty else None, separators=None if pretty else (",", ":"))


def write_document(df: DataFrame, path: str, pretty: bool = True) -> None:
    Path(path).write_text(json_document(df, pretty), encoding="utf-8")


def rank_lines(ranked: DataFrame, digits: int = 6) -> DataFrame:
    """line: "title: rank" with that many decimals."""
    return ranked.select(F.format_string(f"%s: %.{digits}f", "title", "rank").alias("line"))
