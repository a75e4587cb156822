"""What the operators share: input tables, shared folder, materialised steps, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.ship import ship

#: White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"

#: Set where spark.checkpoint.dir is unset and all runs on one machine, as in tests.
OWN_CHECKPOINTS = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; set only if the cluster names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        # the setting can't be changed once a session runs, so the folder is held by the context
        made = spark.sparkContext.getCheckpointDir()
        if not made:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(OWN_CHECKPOINTS)
            made = spark.sparkContext.getCheckpointDir()
        found = made
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's setting by which a finished query's shuffle files go at once rather than when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, frees the shuffles behind it, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[id(out)] = (out, path)
    return out


#: Materialised tables and their folders.
_folders: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Removes materialised tables that nothing reads any more."""
    for t in tables:
        if found := _folders.pop(id(t), None):
            _remove(t.sparkSession, found[1])


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def word_count(text: Column) -> Column:
    """Number of words, without building them one by one in a lambda."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPLIT))).cast("long")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python in batches of at most so many rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
