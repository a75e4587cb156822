"""Reports the packing defects of a run: sizes, constants, counts and coverage.

    python jobs/defect_report.py CLUSTERS BEADS OUTPUT [--config FILE]

CLUSTERS and BEADS are Parquet tables; the config's expressions say which of their columns are frame, side, cluster, area,
region_type and curvature of a defect cluster, and frame and place of a bead. OUTPUT becomes a Parquet table (grp, at,
name, value) with a partition for each section, which a later run replaces as a whole; the same input gives the same rows.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import REPORT, command_line, log, long, picked, read_report  # noqa: E402
from tessera.operators import stats, tiling  # noqa: E402

FIT = ["bins", "slope", "intercept", "r2", "rmse", "pi"]


def sections(clusters: DataFrame, beads: DataFrame, settings: dict) -> dict[str, DataFrame]:
    """The report's sections: per frame counts, covered share of the box and mean sizes; the size histogram; constants of all clusters, of regions and of curvature segments."""
    window = (settings["low"], settings["high"], settings["min_probability"])
    frame = F.col("frame").cast("double")
    both = ["upper", "lower", "total"]
    bent = stats.curvature_segments(clusters, settings["segments"])
    fit = lambda rows, by=(): stats.fit(stats.histogram(rows, by=by), *window, by)
    hist = stats.histogram(clusters)
    return {
        "counts": long(stats.clusters_per_frame(clusters), "counts", both, at=frame),
        "coverage": long(stats.coverage(clusters, tiling.boxes(beads)).where("frame IS NOT NULL"), "coverage", both, at=frame),
        "sizes": long(stats.mean_sizes(clusters).where("frame IS NOT NULL"), "sizes", both, at=frame),
        "histogram": long(hist.where("n > 0"), "histogram", ["n", "p"], at=F.col("mid")),
        "fit": long(fit(clusters), "fit", FIT),
        "fit_region": long(fit(clusters, ("region_type",)), "fit_region", FIT, F.col("region_type")),
        "fit_segment": long(fit(bent, ("segment",)), "fit_segment", FIT, F.col("segment")),
    }


def run(spark: SparkSession, clusters: str, beads: str, output: str, settings: dict) -> dict[str, int]:
    """Reads both tables, writes the report; rows of each section."""
    # read once: the sections are small, the tables needn't be
    facts = picked(spark.read.parquet(clusters), settings["clusters"]).persist()
    try:
        log.info("read %d clusters from %s", facts.count(), clusters)
        made = sections(facts, picked(spark.read.parquet(beads), settings["beads"]), settings)
        report = None
        for part in made.values():
            report = part if report is None else report.unionByName(part)
        report.repartition("section").sortWithinPartitions("section", "grp", "at", "name").write.mode("overwrite").partitionBy("section").parquet(output)
    finally:
        facts.unpersist()
    wrote = {r.section: r["count"] for r in read_report(spark, output).groupBy("section").count().collect()}  # one row a section
    log.info("wrote %s to %s (%s)", wrote, output, REPORT)
    return wrote


def main() -> None:
    given, spark, settings = command_line(__doc__, __file__, {"clusters": "Parquet table of clusters", "beads": "Parquet table of beads", "output": "folder of the report"})
    try:
        run(spark, given.clusters, given.beads, given.output, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
