"""Triangle graphs: shared edges, components, bridges, pruned clusters, boundaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("frame", "side")


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """frame, side, tri_id, e0 < e1: the three edges of each triangle."""
    pairs = [F.struct(F.least(a, b).alias("e0"), F.greatest(a, b).alias("e1")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))]
    return triangles.select(*KEYS, "tri_id", F.explode(F.array(*pairs)).alias("e")).select(*KEYS, "tri_id", "e.e0", "e.e1")


def adjacency(triangles: DataFrame) -> DataFrame:
    """frame, side, a < b: triangles that share an edge, however many share it."""
    edges = triangle_edges(triangles)
    other = edges.select(*KEYS, "e0", "e1", F.col("tri_id").alias("b"))
    return edges.withColumnRenamed("tri_id", "a").join(other, [*KEYS, "e0", "e1"]).where("a < b").select(*KEYS, "a", "b").distinct()


def manifold_adjacency(triangles: DataFrame) -> DataFrame:
    """frame, side, a < b, e0, e1 over edges of exactly two triangles: one shuffle, no self-join."""
    users = triangle_edges(triangles).groupBy(*KEYS, "e0", "e1").agg(F.count("*").alias("n"), F.min("tri_id").alias("a"), F.max("tri_id").alias("b"))
    return users.where("n = 2 AND a < b").select(*KEYS, "a", "b", "e0", "e1")


def edge_metrics(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """manifold_adjacency with edge_len, neck_width, area_ratio (smaller to larger) and centroid_dist.

    triangles carry area and centroid columns (cx, cy, cz).
    """
    edges = manifold_adjacency(triangles)
    end = lambda k: vertices.select(*KEYS, F.col("vid").alias(f"e{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
    tri = lambda k: triangles.select(*KEYS, F.col("tri_id").alias(k), F.col("area").alias(f"area_{k}"), *[F.col(f"c{c}").alias(f"c{c}_{k}") for c in "xyz"])
    wide = edges.join(end(0), [*KEYS, "e0"]).join(end(1), [*KEYS, "e1"]).join(tri("a"), [*KEYS, "a"]).join(tri("b"), [*KEYS, "b"])
    length = F.sqrt(sum(((F.col(f"{c}0") - F.col(f"{c}1")) ** 2 for c in "xyz"), F.lit(0.0)))
    apart = F.sqrt(sum(((F.col(f"c{c}_a") - F.col(f"c{c}_b")) ** 2 for c in "xyz"), F.lit(0.0)))
    ratio = F.coalesce(F.try_divide(F.least("area_a", "area_b"), F.greatest("area_a", "area_b")), F.lit(0.0))
    return wide.select(*KEYS, "a", "b", length.alias("edge_len"), length.alias("neck_width"), ratio.alias("area_ratio"), apart.alias("centroid_dist"))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by whole-array label spreading with shortcuts."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _edges_of(tri: pd.DataFrame, exactly_two: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a leaflet's triangles that share an edge."""
    v = tri[["v0", "v1", "v2"]].to_numpy()
    e = np.concatenate([v[:, [0, 1]], v[:, [1, 2]], v[:, [2, 0]]])
    e.sort(axis=1)
    row = np.tile(np.arange(len(tri)), 3)
    order = np.lexsort((row, e[:, 1], e[:, 0]))
    e, row = e[order], row[order]
    same = (e[1:] == e[:-1]).all(axis=1)
    if exactly_two:
        run = np.concatenate([[0], np.cumsum(~same)])
        size = np.bincount(run, minlength=1)[run]
        same &= (size[:-1] == 2)
    return row[:-1][same], row[1:][same]


def components(triangles: DataFrame, min_size: int = 1) -> DataFrame:
    """frame, side, tri_id, component (its smallest tri_id), size and cluster (from 0, larger first, ties to the smaller component).

    A leaflet's triangles fit in one task, so each (frame, side) is labelled by one; leaflets run in parallel.
    """
    def label(tri: pd.DataFrame) -> pd.DataFrame:
        tri = tri.sort_values("tri_id").reset_index(drop=True)
        ids = tri["tri_id"].to_numpy()
        return tri[[*KEYS, "tri_id"]].assign(component=ids[_labels(len(tri), *_edges_of(tri, False))])

    cols = triangles.select(*KEYS, "tri_id", "v0", "v1", "v2")
    kinds = dict(cols.dtypes)
    out = cols.groupBy(*KEYS).applyInPandas(label, f"frame {kinds['frame']}, side {kinds['side']}, tri_id {kinds['tri_id']}, component {kinds['tri_id']}")
    return ranked(out, min_size)


def ranked(labelled: DataFrame, min_size: int) -> DataFrame:
    """Adds size and cluster to labelled triangles; components below min_size go."""
    sizes = labelled.groupBy(*KEYS, "component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("size"), "component")) - 1
    return labelled.join(sizes.withColumn("cluster", rank), [*KEYS, "component"]).select(*KEYS, "tri_id", "component", "size", "cluster")


def bridges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) lie on no cycle: a walk without recursion, low links by order of discovery."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        near[x].append((y, k))
        near[y].append((x, k))
    seen, low, cut, clock = [-1] * n, [0] * n, np.zeros(len(a), bool), 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        path = [(root, -1, iter(near[root]))]
        while path:
            x, by, rest = path[-1]
            for y, k in rest:
                if k == by:
                    continue
                if seen[y] < 0:
                    seen[y] = low[y] = clock
                    clock += 1
                    path.append((y, k, iter(near[y])))
                    break
                low[x] = min(low[x], seen[y])
            else:
                path.pop()
                if path:
                    above = path[-1][0]
                    low[above] = min(low[above], low[x])
                    cut[by] = low[x] > seen[above]
    return cut


def pruned_components(triangles: DataFrame, min_size: int = 2) -> DataFrame:
    """As components, after all bridges of the graph over edges of exactly two triangles are gone."""
    def label(tri: pd.DataFrame) -> pd.DataFrame:
        tri = tri.sort_values("tri_id").reset_index(drop=True)
        a, b = _edges_of(tri, True)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
        keep = ~bridges(len(tri), a, b)
        ids = tri["tri_id"].to_numpy()
        return tri[[*KEYS, "tri_id"]].assign(component=ids[_labels(len(tri), a[keep], b[keep])])

    cols = triangles.select(*KEYS, "tri_id", "v0", "v1", "v2")
    kinds = dict(cols.dtypes)
    out = cols.groupBy(*KEYS).applyInPandas(label, f"frame {kinds['frame']}, side {kinds['side']}, tri_id {kinds['tri_id']}, component {kinds['tri_id']}")
    return ranked(out, min_size)


def bridge_edges(triangles: DataFrame) -> DataFrame:
    """frame, side, a < b: the bridges that pruned_components removes."""
    def find(tri: pd.DataFrame) -> pd.DataFrame:
        tri = tri.sort_values("tri_id").reset_index(drop=True)
        a, b = _edges_of(tri, True)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        cut = bridges(len(tri), pairs[:, 0], pairs[:, 1])
        ids = tri["tri_id"].to_numpy()
        x = pairs[cut]
        return pd.DataFrame({"frame": tri["frame"].iloc[0], "side": tri["side"].iloc[0], "a": ids[x[:, 0]], "b": ids[x[:, 1]]})

    cols = triangles.select(*KEYS, "tri_id", "v0", "v1", "v2")
    kinds = dict(cols.dtypes)
    return cols.groupBy(*KEYS).applyInPandas(find, f"frame {kinds['frame']}, side {kinds['side']}, a {kinds['tri_id']}, b {kinds['tri_id']}")


def boundary_triangles(triangles: DataFrame, rings: int = 0) -> DataFrame:
    """frame, side, tri_id of triangles with an edge that no other uses, and of so many rings of neighbours around them."""
    edges = triangle_edges(triangles)
    lone = edges.groupBy(*KEYS, "e0", "e1").agg(F.count("*").alias("n"), F.min("tri_id").alias("tri_id")).where("n = 1")
    found = lone.select(*KEYS, "tri_id").distinct()
    if rings:
        near = adjacency(triangles)
        near = near.unionByName(near.select(*KEYS, F.col("b").alias("a"), F.col("a").alias("b")))
        for _ in range(rings):
            step = found.withColumnRenamed("tri_id", "a").join(near, [*KEYS, "a"]).select(*KEYS, F.col("b").alias("tri_id"))
            found = found.unionByName(step).distinct()
    return found
