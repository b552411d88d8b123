"""Datasets of a research run as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object for each row, with its keys in order and nulls kept."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("line")).write.text(path)


def count_lines(rows: DataFrame, name: str) -> DataFrame:
    """(dataset, rows) of a written dataset, read back."""
    return rows.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"))
