"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library assumes (UTC, AQE, skew join on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a private one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="millrace-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written table or a stream."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


WRITTEN: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it back.

    Computed once, survives the loss of any executor, cuts the lineage, and
    gives later joins a known size. The table stays until ``clear_scratch``, or
    until its owner frees it (``Scratch``).
    """
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "table")
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every table this process has written on the way; frames that read them end here."""
    for path in list(WRITTEN):
        remove_path(spark, path)


class Scratch:
    """The tables one job writes on its way. ``free`` removes those that later tables have replaced; leaving
    a ``with`` block removes all of them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame) -> DataFrame:
        saved = materialize(df)
        self._paths[id(saved)] = (saved, WRITTEN[-1])
        return saved

    def free(self, *frames: DataFrame, shuffles: bool = True) -> None:
        """Remove the tables, and let Spark's cleaner drop the shuffle files that led to later ones (which takes a second, and can be left
        to a later call where they are small)."""
        for frame in frames:
            _, path = self._paths.pop(id(frame))
            remove_path(self.spark, path)
        if not shuffles:
            return
        for _ in range(2):  # the first pass lets go of the plans, the second of the shuffles they held
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.free(*[frame for frame, _ in self._paths.values()])


def spread(saved: DataFrame, key: str) -> DataFrame:
    """Use every core on a small written table, whose few files would leave most idle.

    A table of at least 32 MB per core already has enough splits and is left alone.
    """
    cores = saved.sparkSession.sparkContext.defaultParallelism
    size = int(saved._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return saved.repartition(cores, key) if size < cores * 32 * 1024 * 1024 else saved


def materialize_even(df: DataFrame) -> DataFrame:
    """``materialize``, for a table that many jobs scan: rows of a few small files are written once more, dealt evenly over all cores."""
    saved, path = _written(df)
    cores = saved.sparkSession.sparkContext.defaultParallelism
    size = int(saved._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * 32 * 1024 * 1024 or len(saved.inputFiles()) >= cores:
        return saved
    even = materialize(saved.repartition(cores))
    remove_path(saved.sparkSession, path)
    return even


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The written table and its row count (read from the file footers)."""
    saved = materialize(df)
    return saved, saved.count()


def in_parallel(task: Callable[[Any], Any], items: Iterable[Any], threads: int) -> list[Any]:
    """Submit independent Spark jobs from a few driver threads."""
    with ThreadPool(max(1, threads)) as pool:
        return pool.map(inheritable_thread_target(task), list(items))
