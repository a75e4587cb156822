"""Boxes, periodic copies and the central cut of frames; area statistics of meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def boxes(atoms: DataFrame) -> DataFrame:
    """frame, lx, ly, lz: bounds of the atoms whose three coordinates are there."""
    whole = atoms.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    return whole.groupBy("frame").agg(*[(F.max(c) - F.min(c)).alias(f"l{c}") for c in "xyz"])


def fallback_box(atoms: DataFrame) -> DataFrame:
    """Bounds with 2 on each side, for frames without a box of their own."""
    return boxes(atoms).select("frame", *[(F.col(f"l{c}") + 4).alias(f"l{c}") for c in "xyz"])


def tile(atoms: DataFrame, box: DataFrame, nx: int = 3, ny: int = 3) -> DataFrame:
    """nx by ny copies of each frame around its own (i = j = 0), shifted by its box; coordinates at three decimals as a PDB file has them."""
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-(nx // 2), nx - nx // 2) for j in range(-(ny // 2), ny - ny // 2)])
    copies = atoms.join(box.select("frame", "lx", "ly"), "frame").withColumn("_s", F.explode(shifts)).select("*", "_s.i", "_s.j").drop("_s")
    moved = {"x": F.round(F.col("x") + F.col("i") * F.col("lx"), 3), "y": F.round(F.col("y") + F.col("j") * F.col("ly"), 3), "z": F.round("z", 3)}
    own = (F.col("i") == 0) & (F.col("j") == 0)
    raw = {f"_{c}": F.when(own, F.col(c)) for c in "xy"}  # the frame's middle is that of its places as given
    return copies.withColumns(moved | raw).drop("lx", "ly")


def cut(tiled: DataFrame, box: DataFrame, scale: float = 1.5, copies: int = 3) -> DataFrame:
    """The copies inside a window of scale boxes (more than 0, at most the copies' extent) around the middle of the frame itself, both ends included."""
    if not scale > 0:
        raise ValueError("the window must be larger than nothing")
    if scale > copies:
        raise ValueError(f"a window of {scale} boxes doesn't fit in {copies} copies")
    return _cut(tiled, box, scale).drop("_x", "_y")


def _cut(tiled: DataFrame, box: DataFrame, scale: float) -> DataFrame:
    mid = lambda c: ((F.min(f"_{c}") + F.max(f"_{c}")) / 2).alias(f"m{c}")
    middle = tiled.groupBy("frame").agg(mid("x"), mid("y"))
    window = box.join(middle, "frame").select("frame", *[(F.col(f"m{c}") + s * scale / 2 * F.col(f"l{c}")).alias(f"{n}{c}") for c in "xy" for s, n in ((-1, "lo"), (1, "hi"))])
    joined = tiled.join(window, "frame")
    return joined.where(F.col("x").between(F.col("lox"), F.col("hix")) & F.col("y").between(F.col("loy"), F.col("hiy"))).drop("lox", "hix", "loy", "hiy")


def renumber(atoms: DataFrame, order: list[str]) -> DataFrame:
    """serial from 1 in the given order within each frame, starting over after 99999."""
    row = F.row_number().over(Window.partitionBy("frame").orderBy(*order))
    return atoms.withColumn("serial", (row - 1) % 99999 + 1)


def area_stats(triangles: DataFrame) -> DataFrame:
    """frame, side, n, mean, std (of the population), cv, least and most of the areas."""
    mean, std = F.avg("area"), F.stddev_pop("area")
    return triangles.groupBy("frame", "side").agg(F.count("*").alias("n"), mean.alias("mean"), std.alias("std"), F.try_divide(std, mean).alias("cv"), F.min("area").alias("least"), F.max("area").alias("most"))
