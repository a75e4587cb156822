"""Clusters: areas and centroids, greedy periodic de-duplication, layers, curvature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import wrap
from tessera.operators.graph import KEYS
from tessera.operators.spatial import nearest_within
from tessera.sources.folders import written


def cluster_facts(members: DataFrame, triangles: DataFrame) -> DataFrame:
    """frame, side, cluster, n, area and area-weighted centroid cx, cy, cz of clusters (frame, side, cluster, tri_id); without area the first triangle's centroid."""
    joined = members.select(*KEYS, "cluster", "tri_id").join(triangles.select(*KEYS, "tri_id", "area", "cx", "cy", "cz"), [*KEYS, "tri_id"])
    total = F.sum("area")
    mean = lambda c: F.when(total > 1e-30, F.try_divide(F.sum(F.col("area") * F.col(c)), total)).otherwise(F.min_by(c, "tri_id")).alias(c)
    return joined.groupBy(*KEYS, "cluster").agg(F.count("*").alias("n"), total.alias("area"), mean("cx"), mean("cy"), mean("cz"))


def centers(triangles: DataFrame, center_x: float | None = None, center_y: float | None = None) -> DataFrame:
    """frame, side, center_x, center_y: the given values, or the middle of the centroids' bounds."""
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    return triangles.groupBy(*KEYS).agg(F.coalesce(F.lit(center_x).cast("double"), mid("cx")).alias("center_x"), F.coalesce(F.lit(center_y).cast("double"), mid("cy")).alias("center_y"))


def deduplicate(clusters: DataFrame, box: DataFrame, middle: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """clusters (frame, side, cluster, n, area, cx, cy) that stay: by falling area (then n, then the smaller cluster), those whose wrapped centroid is tolerance or more from all that stay.

    Rounds give what one walk in that order would: the first of a square stays if none of the squares within reach has one
    before it, as nobody can remove it then; all that are nearer to it than tolerance go. A square is so small that it keeps one
    at most, so what is compared are firsts and survivors, never all pairs. The first of all stays in each round, so
    rounds end. Distances are plain, also across the cell's faces; clusters without a finite place don't stay. Adds wx and wy.
    """
    placed = clusters.join(box.select("frame", "lx", "ly"), "frame").join(middle, [*KEYS])
    placed = placed.select(*KEYS, "cluster", "n", "area", wrap(F.col("cx"), F.col("center_x"), F.col("lx")).alias("wx"), wrap(F.col("cy"), F.col("center_y"), F.col("ly")).alias("wy"))
    placed = placed.where((F.abs("wx") < float("inf")) & (F.abs("wy") < float("inf")))
    if tolerance <= 0:
        return placed
    cols, square = placed.columns, [*KEYS, "square_x", "square_y"]
    order = F.struct((-F.col("area")).alias("a"), (-F.col("n")).alias("n"), F.col("cluster").alias("c"))
    reach = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in range(-2, 3) for j in range(-2, 3)]))
    spread = lambda rows: rows.withColumn("_o", reach).withColumns({f"square_{c}": F.col(f"square_{c}") + F.col(f"_o.{c}") for c in "xy"}).drop("_o")
    left = written(placed.withColumns({f"square_{c}": F.floor(F.col(f"w{c}") / (0.7 * tolerance)).cast("long") for c in "xy"}), "dedup-left")
    stay = []
    while not left.isEmpty():
        firsts = left.groupBy(square).agg(F.min_by(F.struct("wx", "wy"), order).alias("at"), F.min(order).alias("own"))
        best = spread(firsts).groupBy(square).agg(F.min("own").alias("best"))
        won = firsts.join(best, square).where("own = best").select(*square, "own", F.col("at.wx").alias("sx"), F.col("at.wy").alias("sy"))
        near = left.join(spread(won), square).where((F.col("wx") - F.col("sx")) * (F.col("wx") - F.col("sx")) + (F.col("wy") - F.col("sy")) * (F.col("wy") - F.col("sy")) < tolerance * tolerance)
        gone = near.groupBy(*KEYS, "cluster").agg(F.max(order == F.col("own")).alias("stays"))
        state = written(left.join(gone, [*KEYS, "cluster"], "left").where("stays OR stays IS NULL").select(left["*"], "stays"), "dedup-round")
        stay.append(state.where("stays").select(cols))
        left = state.where("stays IS NULL").drop("stays")
    return reduce(DataFrame.unionByName, stay) if stay else placed.where("false")


def apposition(triangles: DataFrame, max_distance: float = 40.0) -> DataFrame:
    """frame, side, tri_id, opposite and thickness of each triangle: the nearest centroid of the other leaflet within max_distance, and the length of the way to it along the unit normal; nulls without one.

    triangles: frame, side, tri_id, cx, cy, cz, nx, ny, nz.
    """
    own = triangles.select("frame", F.col("tri_id").alias("tri"), "side", F.struct("frame", "side").alias("k"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "nx", "ny", "nz")
    flip = F.when(F.col("side") == "upper", "lower").otherwise("upper")
    near = nearest_within(own.withColumn("k", F.concat_ws(":", "frame", "side")), own.select(F.concat_ws(":", F.col("frame"), flip).alias("k"), F.col("tri").alias("opposite"), "x", "y", "z"), max_distance, "tri", "opposite", "k")
    along = F.abs(F.col("dx") * F.col("nx") + F.col("dy") * F.col("ny") + F.col("dz") * F.col("nz"))
    return near.select("frame", "side", F.col("tri").alias("tri_id"), "opposite", along.alias("thickness"))


def layers(members: DataFrame, paired: DataFrame, thickness: float | None = None, tolerance: float = 8.0, bilayer_fraction: float = 0.5) -> DataFrame:
    """frame, side, cluster, paired_fraction and region_type: triangles whose thickness lies within tolerance of the leaflet's median (or of a given value) are paired; a cluster with enough of them is bilayer.

    A leaflet without any thickness is monolayer with 0.
    """
    middle = paired.groupBy(*KEYS).agg(F.median("thickness").alias("median"))
    level = F.coalesce(F.lit(thickness).cast("double"), F.col("median"))
    hit = F.coalesce(F.abs(F.col("thickness") - level) <= tolerance, F.lit(False))
    joined = members.select(*KEYS, "cluster", "tri_id").join(paired.select(*KEYS, "tri_id", "thickness"), [*KEYS, "tri_id"], "left").join(middle, [*KEYS], "left")
    share = joined.groupBy(*KEYS, "cluster").agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("paired_fraction"))
    return share.withColumn("region_type", F.when(F.col("paired_fraction") >= bilayer_fraction, "bilayer").otherwise("monolayer"))


def triangle_curvature(triangles: DataFrame, vertex_h: DataFrame) -> DataFrame:
    """frame, side, tri_id, h: the mean of the three corners' curvature."""
    corners = triangles.select(*KEYS, "tri_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    return corners.join(vertex_h.select(*KEYS, "vid", "h"), [*KEYS, "vid"]).groupBy(*KEYS, "tri_id").agg(F.avg("h").alias("h"))


def cluster_curvature(members: DataFrame, triangles: DataFrame, tri_h: DataFrame) -> DataFrame:
    """frame, side, cluster, area and area-weighted mean h; the plain mean without area."""
    joined = members.select(*KEYS, "cluster", "tri_id").join(triangles.select(*KEYS, "tri_id", "area"), [*KEYS, "tri_id"]).join(tri_h, [*KEYS, "tri_id"])
    weighed = F.try_divide(F.sum(F.col("h") * F.col("area")), F.sum("area"))
    return joined.groupBy(*KEYS, "cluster").agg(F.sum("area").alias("area"), F.coalesce(F.when(F.sum("area") > 0, weighed), F.avg("h")).alias("h"))


def curvature_ramp(vertex_h: DataFrame) -> DataFrame:
    """lo and hi of the finite curvatures, 0 and 0 without any."""
    real = vertex_h.where(~F.isnan("h") & (F.abs(F.col("h")) < float("inf")))
    return real.agg(F.coalesce(F.min("h"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("h"), F.lit(0.0)).alias("hi"))
