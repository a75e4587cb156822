"""Work that is left: anti-joins against finished keys, and trajectories that grow as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of wanted that done lacks."""
    return wanted.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def fingerprint(*parts: str) -> str:
    """A name for outputs that depends on configuration and input, so that a changed one is not taken for finished work."""
    import hashlib

    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


def grow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], step: Callable[[DataFrame], DataFrame]) -> int:
    """Runs step over the parquet files that came since the last call, and appends rows of keys that target lacks; returns rows of target.

    A stream with the availableNow trigger remembers files in checkpoint; a batch that is run again after a failure
    adds nothing twice, as its keys are there already.
    """
    def append(batch: DataFrame, epoch: int) -> None:
        made = step(batch)
        try:
            there = batch.sparkSession.read.parquet(target)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            there = None
        fresh = made if there is None else made.join(there.select(*keys).distinct(), keys, "left_anti")
        fresh.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).agg(F.count("*").alias("n")).first().n
