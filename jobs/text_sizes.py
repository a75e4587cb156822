"""Keeps the size statistics of a growing text table: how the lengths of lines fall off, for each source.

    python jobs/text_sizes.py DOCUMENTS OUTPUT CHECKPOINT [--config FILE]

The histogram and the log-linear fit are those of the defects; a line's size is its number of words. DOCUMENTS is a folder (or
file) of Parquet that grows by new files. Each run takes the files that the checkpoint doesn't know, and adds their counts
to OUTPUT/counts in a partition for each batch; a batch that is run again replaces its own. OUTPUT/report (grp, at, name,
value, with a partition for each section) is then made of all counts, so no text is ever read twice.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import command_line, log, long, picked, read_report  # noqa: E402
from tessera.operators import stats  # noqa: E402

COUNTS = "grp string, k long, edge boolean, n long, top double, total double, batch long"
WORD = "[^\\x20\\x09-\\x0D]+"


def lines(texts: DataFrame) -> DataFrame:
    """grp and words of each line of texts (grp, text); null texts have none."""
    return texts.select("grp", F.explode(F.split("text", "\n")).alias("line")).select("grp", F.size(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("words"))


def take_new(spark: SparkSession, documents: str, counts: str, checkpoint: str, settings: dict) -> int:
    """Counts the lines of new files, batch by batch; the number of rows read."""

    def add(batch: DataFrame, number: int) -> None:
        sizes = stats.size_counts(lines(picked(batch, settings["columns"])), "words", settings["width"], ("grp",))
        sizes.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(counts)

    schema = spark.read.parquet(documents).schema
    above, _, name = documents.rstrip("/").rpartition("/")
    # a stream takes a file, and not only a folder, where its path is a pattern
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["max_files"]).parquet(f"{above}/{{{name}}}")
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def report(counts: DataFrame, settings: dict) -> DataFrame:
    """Lines and words, histogram and fit of each group and of all."""
    both = counts.unionByName(counts.withColumn("grp", F.lit("(all)"))).groupBy("grp", "k", "edge").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.sum("total").alias("total"))
    hist = stats.bins(both, settings["width"], ("grp",))
    fit = stats.fit(hist, settings["low"], settings["high"], settings["min_probability"], ("grp",))
    sums = both.groupBy("grp").agg(F.sum("n").alias("lines"), F.sum("total").alias("words"), F.max("top").alias("longest"))
    group = F.col("grp")
    return (
        long(sums, "totals", ["lines", "words", "longest"], group)
        .unionByName(long(hist.where("n > 0"), "histogram", ["n", "p"], group, F.col("mid")))
        .unionByName(long(fit, "fit", ["bins", "slope", "intercept", "r2", "rmse", "pi"], group))
    )


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict) -> int:
    """Takes what is new, writes the report of all that has come; the number of rows read."""
    read = take_new(spark, documents, f"{output}/counts", checkpoint, settings)
    log.info("read %d new rows from %s", read, documents)
    counts = spark.read.schema(COUNTS).parquet(f"{output}/counts")
    made = report(counts, settings)
    made.repartition("section").sortWithinPartitions("section", "grp", "at", "name").write.mode("overwrite").partitionBy("section").parquet(f"{output}/report")
    log.info("wrote %d rows to %s/report", read_report(spark, f"{output}/report").count(), output)
    return read


def main() -> None:
    given, spark, settings = command_line(__doc__, __file__, {"documents": "Parquet table of texts", "output": "folder of counts and report", "checkpoint": "folder of the stream's checkpoint"})
    try:
        run(spark, given.documents, given.output, given.checkpoint, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
