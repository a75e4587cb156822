"""New folders under the one that a cluster shares, and when tables in them go."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Taken where spark.checkpoint.dir is unset and all runs on one machine, as in tests.
OWN_FOLDER = "/tmp/checkpoints"
#: Of a step by small pieces: what a task reads of files and of coalesced shuffles.
PIECES = {"spark.sql.files.maxPartitionBytes": "4m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}
#: Most rows that are broadcast where rows grow with the input.
BROADCAST_ROWS = 50_000
#: Spark's setting by which a finished query's shuffle files go at once rather than when the driver collects garbage.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Written tables and their folders, and the tables that were written in the innermost scratch().
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_made: ContextVar[list[DataFrame] | None] = ContextVar("_made", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that isn't there yet, in spark.checkpoint.dir; what is in it stays unless discard() or scratch() removes it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = OWN_FOLDER
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings, which are restored."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df, name: str):
    """df as a table in a new folder, read back: cuts its lineage, frees the shuffles behind it, and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, name)
    with _set(df.sparkSession, CLEANUP):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def dealt(df, name: str):
    """As written(), by small pieces (PIECES), so that no task holds a share of a large table."""
    with _set(df.sparkSession, PIECES):
        return written(df, name)


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more; others are left alone."""
    for t in tables:
        if path := _folders.pop(t, None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written within are removed at the end, but those that are given to what it yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    outer = _made.get()
    token = _made.set(made)

    def keep(table: DataFrame) -> DataFrame:
        if table not in _folders:
            raise ValueError("only a written table can be kept")
        kept.append(table)
        return table

    try:
        yield keep
        if outer is not None:
            outer.extend(kept)
    except BaseException:
        kept.clear()
        raise
    finally:
        _made.reset(token)
        discard(*[t for t in made if not any(t is k for k in kept)])


def merged(side):
    """side for joins that are merges: the size of files, by which Spark would broadcast it, says little of its rows' (a leaflet's ids compress to a byte or two)."""
    return side.hint("merge")


def bounded(side):
    """side for joins that broadcast it, if it has few rows, or else are merges."""
    return side.hint("broadcast") if side.count() <= BROADCAST_ROWS else merged(side)
