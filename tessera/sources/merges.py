"""Merges of dimension rows that name a key more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_seen(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Distinct keys and the least position of each, as first_seen."""
    return rows.groupBy(*keys).agg(F.min(position).alias("first_seen"))
