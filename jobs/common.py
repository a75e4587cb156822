"""What the jobs share: their command line, long tables and logs."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")
#: Columns of a report; section is its partition.
REPORT = "grp string, at double, name string, value double, section string"


def config(path: str | None, beside: str) -> dict:
    """A config file's settings over those of the file beside the job."""
    out = json.loads(Path(beside).with_suffix(".json").read_text())
    return out | (json.loads(Path(path).read_text()) if path else {})


def picked(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns that a config names by SQL expressions."""
    return table.selectExpr(*[f"{text} AS {name}" for name, text in columns.items()])


def long(df: DataFrame, section: str, values: list[str], group: Column | None = None, at: Column | None = None) -> DataFrame:
    """A report's rows: one for each row and value column of df."""
    wide = df.select((F.lit("all") if group is None else group).cast("string").alias("grp"), (F.lit(None) if at is None else at).cast("double").alias("at"), *[F.col(v).cast("double").alias(v) for v in values])
    return wide.unpivot(["grp", "at"], values, "name", "value").withColumn("value", F.round("value", 6)).withColumn("section", F.lit(section))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report with its partitions as text."""
    return spark.read.schema(REPORT).parquet(path)


def command_line(doc: str, job: str, paths: dict[str, str]) -> tuple[argparse.Namespace, SparkSession, dict]:
    """Path arguments, a session and the settings; logs go to the console."""
    args = argparse.ArgumentParser(description=doc.splitlines()[0])
    for name, text in paths.items():
        args.add_argument(name, help=text)
    args.add_argument("--config", help="a JSON file whose settings go before those beside the job")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return given, SparkSession.builder.appName(Path(job).stem).getOrCreate(), config(given.config, job)
