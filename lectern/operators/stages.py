"""Stages that are written once, and which side of a join is small enough to be sent to every task.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, so a
lost executor costs a re-read, never a recomputation from the start, and later
stages can prune columns. The setting is read from the session; only where it
is unset and Spark is one local process (tests, a laptop) is a private folder made for it.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

@dataclass
class Progress:
    """What each written stage did: (number, stage, began and ended in epoch seconds, rows, rows with an error)."""

    events: list[tuple[int, str, float, float, int, int]] = field(default_factory=list)
    on_stage: Callable[[str, int, int], None] | None = None

    def tell(self, stage: str, began: float, ended: float, rows: int, failed: int) -> None:
        self.events.append((len(self.events), stage, began, ended, rows, failed))
        if self.on_stage:
            self.on_stage(stage, rows, failed)

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (no, stage, ts, ended, rows, failed), one for each stage so far."""
        found = spark.createDataFrame(self.events, "no int, stage string, began double, ended double, rows bigint, failed bigint")
        return found.select("no", "stage", F.timestamp_seconds("began").alias("ts"), F.timestamp_seconds("ended").alias("ended"), "rows", "failed")


#: Rows up to which a table of a few 8-byte columns is small enough to broadcast (16 MB at 32 bytes).
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch within ``small_batches``; of texts that is some MB.
BATCH_ROWS = 1000
#: What ``scratch`` blocks that are open hold.
_OPEN: list[list[str]] = []
#: The progress of ``watched`` blocks that are open.
_WATCHING: list[Progress] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    return replaceable(df, name)[0]


def replaceable(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialize``, with the path for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    seen, began = (Observation(), time.time()) if _WATCHING else (None, 0.0)
    if seen is None:
        df.write.parquet(path)
    else:
        # counted in the write itself, by its tasks; no job of its own
        failed = F.count_if(F.col("error").isNotNull() if "error" in df.columns else F.lit(False))
        df.observe(seen, F.count(F.lit(1)).alias("rows"), failed.alias("failed")).write.parquet(path)
        told = seen.get
        for watch in _WATCHING:
            watch.tell(name, began, time.time(), told["rows"] or 0, told["failed"] or 0)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is a counted, small table; ``df`` as it is otherwise.

    ``df`` should be materialized or cheap: it is counted. Beyond ``limit`` rows the join
    is left to a shuffle.
    """
    return F.broadcast(df) if df.count() <= limit else df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that are written within the block at its end; a path taken off the list stays."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN[:] = [held for held in _OPEN if held is not paths]
        for path in paths:
            discard(spark, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is run within the block sends at most ``rows`` rows to Python at once; then the session's setting is as before.

    An executor holds a batch several times over beside its heap, and a Python worker keeps some of what a large one took.
    Frames that are only returned from the block are run later, with batches of any size.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if not 0 < int(was) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


@contextmanager
def watched(on_stage: Callable[[str, int, int], None] | None = None) -> Iterator[Progress]:
    """Gather what the stages that are written within the block do; ``on_stage`` is told each one's name, rows and failed rows when it ends."""
    progress = Progress(on_stage=on_stage)
    _WATCHING.append(progress)
    try:
        yield progress
    finally:
        _WATCHING[:] = [held for held in _WATCHING if held is not progress]
