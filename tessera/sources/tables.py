"""Cluster tables as CSV: facts, layers and curvature, read with checked headers and written in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.stats import cluster_side

# Names under which files have the area, the first that is there wins.
AREA_NAMES = ("area_angstrom2", "patch_area_A2", "area")


def read_csv(spark: SparkSession, path: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """All columns as text, names trimmed; raises where a needed one is missing."""
    raw = spark.read.csv(path, header=True)
    named = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
    if missing := [c for c in needed if c not in named.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(named.columns)}")
    return named


def _area(columns: list[str]) -> Column | None:
    return next((F.col(c).try_cast("double") for c in AREA_NAMES if c in columns), None)


def cluster_rows(spark: SparkSession, path: str) -> DataFrame:
    """frame, side and area (null where it can't be read) of a cluster file; rows without a frame are left out, 3.7 counts as frame 3."""
    return parse_clusters(read_csv(spark, path, ("frame",)))


def parse_clusters(rows: DataFrame) -> DataFrame:
    """As cluster_rows, of a file's columns as text."""
    area = _area(rows.columns)
    label = F.col("cluster") if "cluster" in rows.columns else F.lit("")
    frame = F.col("frame").try_cast("double")
    return rows.select(F.when(F.abs(frame) < 9e15, frame).cast("long").alias("frame"), cluster_side(F.coalesce(label, F.lit(""))).alias("side"), (F.lit(None).cast("double") if area is None else area).alias("area")).where("frame IS NOT NULL")


def cluster_areas(spark: SparkSession, path: str) -> DataFrame:
    """area of a cluster file's rows; a file without an area column raises."""
    rows = read_csv(spark, path)
    area = _area(rows.columns)
    if area is None:
        raise ValueError(f"{path} has none of the columns {', '.join(AREA_NAMES)}")
    return rows.select(area.alias("area"))


def region_areas(spark: SparkSession, path: str, regions: tuple[str, ...] = ("monolayer", "bilayer")) -> DataFrame:
    """region_type and area of a layers file's rows in the given regions."""
    return parse_regions(read_csv(spark, path, ("area_angstrom2", "region_type")), regions)


def parse_regions(rows: DataFrame, regions: tuple[str, ...] = ("monolayer", "bilayer")) -> DataFrame:
    """As region_areas, of a file's columns as text."""
    region = F.lower(F.trim("region_type"))
    return rows.select(region.alias("region_type"), F.col("area_angstrom2").try_cast("double").alias("area")).where(F.col("region_type").isin(*regions) & F.col("area").isNotNull())


def curvature_rows(spark: SparkSession, path: str) -> DataFrame:
    """area and h of a curvature file's rows."""
    return parse_curvature(read_csv(spark, path, ("area_angstrom2", "H")))


def parse_curvature(rows: DataFrame) -> DataFrame:
    """As curvature_rows, of a file's columns as text."""
    return rows.select(F.col("area_angstrom2").try_cast("double").alias("area"), F.col("H").try_cast("double").alias("h")).where("area IS NOT NULL AND h IS NOT NULL")


def _ordered(clusters: DataFrame, extra: list[Column]) -> DataFrame:
    rank = F.when(F.col("side") == "upper", 0).otherwise(1)
    label = F.concat_ws(":", "side", F.col("cluster").cast("string"))
    return clusters.orderBy("frame", rank, "cluster").select("frame", label.alias("cluster"), F.format_string("%.6f", "area").alias("area_angstrom2"), *extra)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """frame, cluster (`side:index`) and area of clusters, by frame, upper before lower, index."""
    _ordered(clusters, []).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_layers(clusters: DataFrame, path: str) -> None:
    """As write_clusters, with region_type before the area's fraction of paired triangles."""
    rows = _ordered(clusters, [F.col("region_type"), F.format_string("%.4f", "paired_fraction").alias("paired_fraction")])
    rows.select("frame", "cluster", "region_type", "area_angstrom2", "paired_fraction").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_curvature(clusters: DataFrame, path: str) -> None:
    """As write_clusters, with the clusters' mean curvature."""
    _ordered(clusters, [F.format_string("%.6f", "h").alias("H")]).coalesce(1).write.mode("overwrite").csv(path, header=True)
