"""The whole program: a settings file in; tables, meshes, statistics and a report out.

    python -m tessera.plans.program SETTINGS OUTPUT [--tables FOLDER]

All paths are URIs that Spark reads and writes, so they may be remote. Tables of the steps are kept under FOLDER (usually
OUTPUT/tables) and only completed by a rerun; what is published is replaced as a whole.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import clusters as cl
from tessera.operators import colors, stats
from tessera.plans.membrane import STEPS, Analysis
from tessera.sources import logs, ply, tables
from tessera.sources.config import Settings

log = logging.getLogger(__name__)
NAMES = {1: "boxes", 2: "tiling", 3: "surfaces", 4: "coverage", 5: "clusters", 6: "pruning", 7: "statistics"}
_BOUNDED = {"fit": (), "layer_fit": ("region_type",), "curvature_fit": ("segment",)}


def read_settings(spark: SparkSession, path: str) -> Settings:
    """The settings of a file; an empty one gives the usual values."""
    return Settings.parse("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def report(summary: dict[str, DataFrame], took: dict[str, float]) -> str:
    """Fits (of all clusters, of regions, of segments: a few rows each), means over all frames, and seconds of each step."""
    texts = []
    for name, by in _BOUNDED.items():
        for row in summary[name].orderBy(*by, "bins").collect() if name in summary else []:
            texts.append(f"{' '.join([name, *[str(row[c]) for c in by]])}\n{stats.fit_summary(row)}")
    for name in ("counts", "coverage", "sizes", "types"):
        for row in summary[name].where("frame IS NULL").collect() if name in summary else []:
            texts.append("\n".join([f"{name}, all frames", *[f"{k} = {v}" for k, v in row.asDict().items() if k != "frame"]]))
    seconds: dict[int, float] = {}
    for name, s in took.items():
        seconds[STEPS[name]] = seconds.get(STEPS[name], 0.0) + s
    return logs.sections([*texts, logs.timings(seconds, NAMES)])


def publish(run: Analysis, output: str) -> list[str]:
    """Writes what a run gives under output, computing what is missing; the folders written."""
    spark, s = run.spark, run.settings
    base = f"{output.rstrip('/')}/{s.output_name_prefix}"
    wrote = []

    def put(name: str, write) -> None:
        write(f"{base}{name}")
        wrote.append(f"{base}{name}")
        log.info("wrote %s", wrote[-1])

    put("boxes.csv", lambda p: logs.write_boxes(run.table("boxes"), p))
    put("atoms.csv", lambda p: logs.write_atom_table(run.atom_table(), p))
    put("clusters.csv", lambda p: tables.write_clusters(run.table("facts"), p))
    mesh, members, left = run.table("mesh"), run.table("pruned"), run.pruned_triangles()
    picked = mesh.join(members.select("frame", "side", "tri_id"), ["frame", "side", "tri_id"], "left_semi")
    put("defects_ply", lambda p: ply.write_meshes(picked, colors.by_type(left), p))
    put("clusters_ply", lambda p: ply.write_meshes(picked, colors.by_cluster(picked, members), p))
    if s.layer_analysis:
        put("layers.csv", lambda p: tables.write_layers(run.table("layers"), p))
    if s.curvature_analysis:
        put("curvature.csv", lambda p: tables.write_curvature(run.table("bent"), p))
        h = run.table("vertex_h")
        bent = mesh.join(h.select("frame", "side").distinct(), ["frame", "side"], "left_semi")
        put("curvature_ply", lambda p: ply.write_meshes(bent, ply.ramp_colors(h, cl.curvature_ramp(h)), p))
    summary = run.summary()
    for name, rows in summary.items():
        put(f"summary/{name}", lambda p, rows=rows: rows.write.mode("overwrite").parquet(p))
    done = {name: spark.read.parquet(f"{base}summary/{name}") for name in summary}
    text = report(done, run.took)
    put("report", lambda p: spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(p))
    return wrote


def run(spark: SparkSession, settings: str, output: str, folder: str | None = None, **options) -> list[str]:
    """Reads a settings file and publishes its run."""
    s = read_settings(spark, settings)
    log.info("read %s: trajectory %s, from step %s", settings, s.input, s.resume_from)
    return publish(Analysis(spark, s, folder or f"{output.rstrip('/')}/tables", **options), output)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("settings")
    args.add_argument("output")
    args.add_argument("--tables")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("membrane").getOrCreate()
    try:
        run(spark, given.settings, given.output, given.tables)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
