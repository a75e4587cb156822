"""Mesh kernels, one task per (frame, side): surfaces from beads, subdivision, clean-up, curvature.

The surface is a height field: a smoothed height over a regular grid in the beads' hull. It is not vertex for vertex
what implicit-surface libraries give; areas, normals and curvature of planes and spheres are what tests hold it to.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MESH = "frame long, side string, tri_id long, v0 long, v1 long, v2 long, ax double, ay double, az double, bx double, by_ double, bz double, cx_ double, cy_ double, cz_ double"


def convex_hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def inside_hull(xy: np.ndarray, hull: np.ndarray, slack: float = 1e-9) -> np.ndarray:
    """Whether points lie in a convex polygon."""
    a, b = hull, np.roll(hull, -1, axis=0)
    side = (b[:, 0] - a[:, 0])[None] * (xy[:, 1:2] - a[:, 1][None]) - (b[:, 1] - a[:, 1])[None] * (xy[:, 0:1] - a[:, 0][None])
    return (side >= -slack * np.maximum(np.hypot(*(b - a).T), 1)[None]).all(axis=1)


def height_field(points: np.ndarray, target_area: float, smooth: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a leaflet: heights smoothed by a Gaussian over a grid whose triangles have about the target area."""
    step = np.sqrt(2 * target_area)
    lo, hi = points[:, :2].min(axis=0), points[:, :2].max(axis=0)
    nx, ny = (np.maximum(np.round((hi - lo) / step).astype(int), 1) + 1).tolist()
    gx, gy = np.linspace(lo[0], hi[0], nx), np.linspace(lo[1], hi[1], ny)
    # separable weights: one matrix product for each row of the grid's cells
    wx = np.exp(-((gx[:, None] - points[None, :, 0]) ** 2) / (2 * smooth**2))
    wy = np.exp(-((gy[:, None] - points[None, :, 1]) ** 2) / (2 * smooth**2))
    total = wx @ wy.T
    z = (wx * points[None, :, 2]) @ wy.T / np.maximum(total, 1e-300)
    verts = np.stack([np.repeat(gx, ny), np.tile(gy, nx), z.ravel()], axis=1)
    i, j = np.meshgrid(np.arange(nx - 1), np.arange(ny - 1), indexing="ij")
    k = (i * ny + j).ravel()
    tris = np.concatenate([np.stack([k, k + ny, k + 1], axis=1), np.stack([k + ny, k + ny + 1, k + 1], axis=1)])
    hull = convex_hull(points[:, :2])
    if len(hull) >= 3:
        tris = tris[inside_hull(verts[tris].mean(axis=1)[:, :2], hull)]
    used, back = np.unique(tris, return_inverse=True)
    return verts[used], back.reshape(-1, 3)


def areas(verts: np.ndarray, tris: np.ndarray) -> np.ndarray:
    """Triangles' areas."""
    a, b, c = (verts[tris[:, k]] for k in range(3))
    return np.linalg.norm(np.cross(b - a, c - a), axis=1) / 2


def _edges(tris: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.sort(np.concatenate([tris[:, [0, 1]], tris[:, [1, 2]], tris[:, [2, 0]]]), axis=1)
    unique, back = np.unique(e, axis=0, return_inverse=True)
    return unique, back.reshape(3, -1).T


def subdivide(verts: np.ndarray, tris: np.ndarray, times: int = 1, loop: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each triangle split in four at its edges' middles; with loop, vertices move by Loop's weights (borders by the cubic rule)."""
    for _ in range(times):
        edges, of = _edges(tris)
        n = len(verts)
        mid = verts[edges].mean(axis=1)
        if loop:
            uses = np.bincount(of.ravel(), minlength=len(edges))
            opposite = np.zeros_like(mid)
            for k in range(3):
                np.add.at(opposite, of[:, k], verts[tris[:, (k + 2) % 3]])
            inner = uses == 2
            mid[inner] = 0.75 * mid[inner] + opposite[inner] / 8
            total, degree = np.zeros_like(verts), np.zeros(n)
            rim_total, rim = np.zeros_like(verts), np.zeros(n)
            for a, b in ((0, 1), (1, 0)):
                np.add.at(total, edges[:, a], verts[edges[:, b]])
                np.add.at(degree, edges[:, a], 1)
                np.add.at(rim_total, edges[~inner, a], verts[edges[~inner, b]])
                np.add.at(rim, edges[~inner, a], 1)
            d = np.maximum(degree, 1)
            beta = (5 / 8 - (3 / 8 + np.cos(2 * np.pi / d) / 4) ** 2) / d
            moved = (1 - d * beta)[:, None] * verts + beta[:, None] * total
            verts = np.where((rim == 2)[:, None], 0.75 * verts + rim_total / 8, np.where((rim > 0)[:, None], verts, moved))
        m = of + n
        tris = np.concatenate([np.stack(t, axis=1) for t in ((tris[:, 0], m[:, 0], m[:, 2]), (m[:, 0], tris[:, 1], m[:, 1]), (m[:, 2], m[:, 1], tris[:, 2]), (m[:, 0], m[:, 1], m[:, 2]))])
        verts = np.concatenate([verts, mid])
    return verts, tris


def largest_part(tris: np.ndarray) -> np.ndarray:
    """The triangles of the largest part connected by edges of exactly two triangles, without edges of more."""
    from tessera.operators.graph import _edges_of, _labels

    edges, of = _edges(tris)
    uses = np.bincount(of.ravel(), minlength=len(edges))
    tris = tris[(uses[of] <= 2).all(axis=1)]
    if not len(tris):
        return tris
    frame = pd.DataFrame(tris, columns=["v0", "v1", "v2"])
    label = _labels(len(tris), *_edges_of(frame, True))
    return tris[label == np.bincount(label).argmax()]


def vertex_curvature(verts: np.ndarray, tris: np.ndarray, rings: int = 2) -> np.ndarray:
    """Mean curvature at each vertex by a least-squares quadric over its rings of neighbours, along the vertex normal; NaN without enough of them.

    The sign follows the triangles' orientation: a sphere of radius R with outward normals has -1 / R.
    """
    normal = np.zeros_like(verts)
    face = np.cross(verts[tris[:, 1]] - verts[tris[:, 0]], verts[tris[:, 2]] - verts[tris[:, 0]])
    for k in range(3):
        np.add.at(normal, tris[:, k], face)
    normal /= np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
    edges, _ = _edges(tris)
    near: list[set[int]] = [set() for _ in range(len(verts))]
    for a, b in edges.tolist():
        near[a].add(b)
        near[b].add(a)
    out = np.full(len(verts), np.nan)
    for v in range(len(verts)):
        ring = {v}
        for _ in range(rings):
            ring = ring | set().union(*(near[x] for x in ring))
        ring.discard(v)
        if len(ring) < 5:
            continue
        n = normal[v]
        u = np.cross(n, [1.0, 0, 0] if abs(n[0]) < 0.9 else [0, 1.0, 0])
        u /= np.linalg.norm(u)
        w = np.cross(n, u)
        d = verts[sorted(ring)] - verts[v]
        x, y, z = d @ u, d @ w, d @ n
        fit, *_ = np.linalg.lstsq(np.stack([x * x, x * y, y * y, x, y], axis=1), z, rcond=None)
        a, b, c, p, q = fit
        out[v] = ((1 + q * q) * 2 * a - 2 * p * q * b + (1 + p * p) * 2 * c) / (2 * (1 + p * p + q * q) ** 1.5)
    return out


def surfaces(beads: DataFrame, target_area: float = 1.0, smooth: float = 8.0) -> DataFrame:
    """Triangles (MESH) of each leaflet (frame, side, x, y, z), upper normals up and lower normals down."""

    def build(x: pd.DataFrame) -> pd.DataFrame:
        verts, tris = height_field(x.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy(float), target_area, smooth)
        tris = largest_part(tris)
        if x["side"].iloc[0] == "lower":
            tris = tris[:, ::-1]
        corner = verts[tris].reshape(len(tris), 9)
        out = pd.DataFrame(corner, columns=["ax", "ay", "az", "bx", "by_", "bz", "cx_", "cy_", "cz_"])
        for k in range(3):
            out[f"v{k}"] = tris[:, k]
        return out.assign(frame=x["frame"].iloc[0], side=x["side"].iloc[0], tri_id=np.arange(len(tris)))[[c.split()[0] for c in MESH.split(", ")]]

    return beads.select("frame", "side", "x", "y", "z").groupBy("frame", "side").applyInPandas(build, MESH)


def curvatures(mesh: DataFrame, rings: int = 2) -> DataFrame:
    """frame, side, vid, h of each leaflet's vertices; those without enough neighbours are left out."""

    def bend(x: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(x[["v0", "v1", "v2"]].to_numpy())
        at = np.searchsorted(ids, x[["v0", "v1", "v2"]].to_numpy())
        verts = np.zeros((len(ids), 3))
        for k, names in enumerate((("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx_", "cy_", "cz_"))):
            verts[at[:, k]] = x[list(names)].to_numpy()
        h = vertex_curvature(verts, at, rings)
        ok = np.isfinite(h)
        return pd.DataFrame({"frame": x["frame"].iloc[0], "side": x["side"].iloc[0], "vid": ids[ok], "h": h[ok]})

    return mesh.groupBy("frame", "side").applyInPandas(bend, "frame long, side string, vid long, h double")
