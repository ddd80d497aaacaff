"""Intermediate results in reliable storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stage_folder(spark: SparkSession) -> str:
    """The folder for intermediate results: the shared one the session names, or
    one of its own for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="recon-stage-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in this block delete their shuffle files as they end.

    Else these stay until the driver collects garbage, which a driver with little to
    do may not do at all before a run ends."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is staged in this block is deleted at its end: for steps that leave their
    result elsewhere and return no frame that reads what they staged."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame) -> DataFrame:
    """Write a frame once and go on from the written table.

    Lost executors then cost no recomputation, all later readers see the same
    rows, and they read only the columns they need."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/recon-{uuid.uuid4()}"
    paths = _passing.get()
    if paths is not None:
        paths.append(path)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
