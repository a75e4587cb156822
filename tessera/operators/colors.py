"""Colours of meshes' vertices and meshes of a part of the triangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import KEYS

# Colours of tail and neutral defects, and the multiplier that spreads cluster numbers over colours.
TAIL, NEUTRAL = "#f218bc", "#0f0f0f"
SPREAD = 2654435761


def rgb(code: str) -> tuple[float, float, float]:
    """Red, green and blue of `#RRGGBB`, each from 0 to 1."""
    value = int(code.removeprefix("#"), 16)
    return value // 65536 / 255, value // 256 % 256 / 255, value % 256 / 255


def cluster_rgb(cluster: Column) -> list[Column]:
    """A colour for a cluster's number: the low three bytes of its product with SPREAD."""
    mixed = cluster.cast("long") * F.lit(SPREAD)
    return [F.shiftright(mixed, s).bitwiseAND(F.lit(255)) / 255 for s in (0, 8, 16)]


def _mean(triangles: DataFrame, colors: list[Column]) -> DataFrame:
    """frame, side, vid, red, green, blue: the mean over the triangles that a vertex is a corner of."""
    named = [c.alias(n) for c, n in zip(colors, ("red", "green", "blue"), strict=True)]
    corners = triangles.select(*KEYS, *named, F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    return corners.groupBy(*KEYS, "vid").agg(*[F.avg(c).alias(c) for c in ("red", "green", "blue")])


def by_cluster(triangles: DataFrame, members: DataFrame) -> DataFrame:
    """Vertex colours by the clusters (members: frame, side, tri_id, cluster) of their triangles; those of none add nothing."""
    return _mean(triangles.join(members.select(*KEYS, "tri_id", "cluster"), [*KEYS, "tri_id"]), cluster_rgb(F.col("cluster")))


def by_type(triangles: DataFrame) -> DataFrame:
    """Vertex colours by the triangles' defect_type: 1 is neutral, all else tail."""
    pairs = zip(rgb(NEUTRAL), rgb(TAIL), strict=True)
    return _mean(triangles, [F.when(F.col("defect_type") == 1, n).otherwise(t) for n, t in pairs])


def remap(triangles: DataFrame) -> DataFrame:
    """frame, side, tri_id and corners v0, v1, v2 numbered from 0 by the order of the vertices that are left."""
    corners = triangles.select(*KEYS, "tri_id", F.posexplode(F.array("v0", "v1", "v2")).alias("at", "vid"))
    number = corners.select(*KEYS, "vid").distinct().withColumn("to", F.row_number().over(Window.partitionBy(*KEYS).orderBy("vid")) - 1)
    back = corners.join(number, [*KEYS, "vid"]).groupBy(*KEYS, "tri_id")
    return back.agg(*[F.max(F.when(F.col("at") == i, F.col("to"))).cast("long").alias(f"v{i}") for i in range(3)])
