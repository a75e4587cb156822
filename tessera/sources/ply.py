"""Triangle meshes as PLY text, with colours and a quality per vertex."""

from __future__ import annotations

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.colors import remap

KEYS = ["frame", "side"]
#: Colours of the lowest, middle and highest curvature.
BLUE, WHITE, RED = (0.23, 0.30, 0.75), (0.87, 0.87, 0.87), (0.71, 0.02, 0.15)


def ply_text(verts: np.ndarray, tris: np.ndarray, colors: np.ndarray | None = None, quality: np.ndarray | None = None) -> str:
    """An ASCII PLY file; vertices that no triangle uses are left out."""
    used, back = np.unique(tris, return_inverse=True)
    tris = back.reshape(-1, 3)
    head = ["ply", "format ascii 1.0", f"element vertex {len(used)}", "property float x", "property float y", "property float z"]
    cols = [[f"{v:.6g}" for v in verts[used, k]] for k in range(3)]
    if colors is not None:
        head += [f"property uchar {c}" for c in ("red", "green", "blue")]
        cols += [[str(int(v)) for v in np.clip(np.round(colors[used, k] * 255), 0, 255)] for k in range(3)]
    if quality is not None:
        head.append("property float quality")
        cols.append([f"{v:.6g}" for v in quality[used]])
    head += [f"element face {len(tris)}", "property list uchar int vertex_indices", "end_header"]
    rows = [" ".join(r) for r in zip(*cols, strict=True)]
    return "\n".join([*head, *rows, *[f"3 {a} {b} {c}" for a, b, c in tris.tolist()]]) + "\n"


def read_ply(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of an ASCII PLY text."""
    head, _, body = text.partition("end_header\n")
    n = int(head.split("element vertex ")[1].split()[0])
    lines = body.splitlines()
    return np.array([list(map(float, r.split()[:3])) for r in lines[:n]]).reshape(-1, 3), np.array([list(map(int, r.split()[1:4])) for r in lines[n:] if r]).reshape(-1, 3)


def write_ply(path: str, text: str) -> None:
    """Writes a PLY text to a URI."""
    files, place = fs.FileSystem.from_uri(path)
    files.create_dir(place.rpartition("/")[0], recursive=True)
    with files.open_output_stream(place) as out:
        out.write(text.encode())


def ramp(h: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Blue to white to red over lo .. hi."""
    t = np.clip((h - lo) / (hi - lo) if hi > lo else np.full(len(h), 0.5), 0, 1)[:, None]
    blue, white, red = map(np.array, (BLUE, WHITE, RED))
    return np.where(t < 0.5, blue + (white - blue) * 2 * t, white + (red - white) * (2 * t - 1))


def ramp_colors(vertex_h: DataFrame, bounds: DataFrame) -> DataFrame:
    """frame, side, vid, red, green, blue and quality (h) of vertices' curvatures over the one row lo, hi of bounds; those without a finite one are white."""
    h, lo, hi = F.col("h"), F.col("lo"), F.col("hi")
    known = ~F.isnan("h") & (F.abs(h) < float("inf")) & (hi > lo)
    t = F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(h - lo, hi - lo)))).otherwise(0.5)
    part = lambda i: F.when(t < 0.5, BLUE[i] + (WHITE[i] - BLUE[i]) * 2 * t).otherwise(WHITE[i] + (RED[i] - WHITE[i]) * (2 * t - 1))
    rows = vertex_h.withColumn("one", F.lit(1)).join(bounds.withColumn("one", F.lit(1)), "one")
    return rows.select(*KEYS, "vid", *[part(i).alias(c) for i, c in enumerate(("red", "green", "blue"))], F.when(known, h).otherwise(0.0).alias("quality"))


def ply_lines(triangles: DataFrame, colors: DataFrame) -> DataFrame:
    """frame, side, part (0 head, 1 vertices, 2 faces), ord and line of a PLY text for each leaflet.

    triangles: frame, side, tri_id, v0, v1, v2 and corners ax .. cz_; colors: frame, side, vid, red, green, blue (0 to 1)
    and perhaps quality. Vertices that no triangle uses are left out, those without a colour are black.
    """
    corners = F.array(*[F.struct(F.col(f"v{i}").alias("vid"), *[F.col(c).cast("double").alias(a) for c, a in zip(cs, "xyz", strict=True)]) for i, cs in enumerate((("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx_", "cy_", "cz_")))])
    used = triangles.select(*KEYS, F.explode(corners).alias("c")).groupBy(*KEYS, "c.vid").agg(F.min("c").alias("c"))
    shades = ["red", "green", "blue"]
    extra = ["quality"] if "quality" in colors.columns else []
    named = used.join(colors.select(*KEYS, "vid", *shades, *extra), [*KEYS, "vid"], "left")
    number = lambda c: F.format_string("%.6g", c)
    cells = [number(F.col(f"c.{a}")) for a in "xyz"] + [F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0)))) * 255).cast("int").cast("string") for c in shades]
    cells += [number(F.coalesce(F.col(c), F.lit(0.0))) for c in extra]
    vertices = named.select(*KEYS, F.lit(1).alias("part"), F.col("vid").cast("long").alias("ord"), F.concat_ws(" ", *cells).alias("line"))
    faces = remap(triangles).select(*KEYS, F.lit(2).alias("part"), F.col("tri_id").cast("long").alias("ord"), F.concat_ws(" ", F.lit("3"), *[F.col(f"v{i}").cast("string") for i in range(3)]).alias("line"))
    counts = used.groupBy(*KEYS).agg(F.count("*").alias("nv")).join(triangles.groupBy(*KEYS).agg(F.count("*").alias("nf")), KEYS)
    head = [F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), F.col("nv").cast("string")), *[F.lit(f"property float {a}") for a in "xyz"], *[F.lit(f"property uchar {c}") for c in shades]]
    head += [F.lit(f"property float {c}") for c in extra] + [F.concat(F.lit("element face "), F.col("nf").cast("string")), F.lit("property list uchar int vertex_indices"), F.lit("end_header")]
    heads = counts.select(*KEYS, F.lit(0).alias("part"), F.posexplode(F.array(*head)).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))
    return heads.unionByName(vertices).unionByName(faces)


def write_meshes(triangles: DataFrame, colors: DataFrame, folder: str) -> None:
    """One PLY text for each leaflet under folder/frame=F/side=S; Spark's writer commits whole files, so a repeated task leaves no second one."""
    lines = ply_lines(triangles, colors)
    lines.repartition(*KEYS).sortWithinPartitions(*KEYS, "part", "ord").select(*KEYS, "line").write.mode("overwrite").partitionBy(*KEYS).text(folder)
