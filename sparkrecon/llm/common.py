"""Helpers of the operators: tables, shared storage, sizes, ranges of ids."""

from __future__ import annotations

import math
import os
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row of an input that does not know its size.
ROW_BYTES = 1000


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. A cluster
    without that folder gets the package by ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    places = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in places:
        known = [root, *filter(None, places)]
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(known)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The storage all executors share, ``spark.checkpoint.dir``. Only a local session
    may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="llm-stage-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below :func:`shared_root`."""
    return f"{shared_root(spark)}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, partition_by: str | None = None, path: str | None = None) -> DataFrame:
    """The frame, written once as Parquet and read again: lost executors then cost
    no recomputation, and all readers see the same rows. With ``path``, a new folder
    of :func:`shared_folder`, the caller can drop it later."""
    spark, path = df.sparkSession, path or shared_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`shared_folder` that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def input_bytes(df: DataFrame) -> int:
    """Size of the plan's inputs as their files tell it, without a job. (The plan's own
    estimate shrinks with each column left out, whatever the column holds.) Inputs
    that don't know their size, as rows of the driver, are counted instead."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=0) >= 1 << 60:
        return df.count() * ROW_BYTES
    return sum(sizes)


def parts_for(df: DataFrame, each: int = 8 << 20, least: int = 1) -> int:
    """Number of parts of about ``each`` bytes of the (compressed) input."""
    return max(least, math.ceil(input_bytes(df) / each))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are (``lower`` changes others
    as well, and ``translate`` looks up each character in a map of strings)."""
    for letter in string.ascii_uppercase:
        text = F.replace(text, F.lit(letter), F.lit(letter.lower()))
    return text


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def semi_join_rows(docs: DataFrame, id_col: str, mark: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs``, with all columns, for each ``(doc_id, mark)`` row of ``kept``:
    ids match null-safely, marks by value. Repeated rows of one id and mark meet in
    the task that joins them, so they need no further shuffle."""
    null_id = F.lit(-(2**63))
    id_name, mark_name = free_name(docs, "join_id"), free_name(docs, "join_mark")
    left = docs.withColumns(
        {id_name: F.coalesce(F.col(id_col).cast("long"), null_id), mark_name: mark}
    )
    right = kept.select(
        F.coalesce(F.col("doc_id").cast("long"), null_id).alias(id_name),
        F.col("mark").alias(mark_name),
    )
    joined = left.join(right, [id_name, mark_name], "left_semi")
    return joined.dropDuplicates([id_name, mark_name]).select(docs.columns)


def id_ranges(df: DataFrame, id_col: str, parts: int) -> list:
    """Ascending inner bounds that cut the ids into about equal ranges; a null id
    belongs to the first range. Cuts only place rows, so quantiles may be rough."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    cuts = df.select(F.col(id_col).cast("double").alias("id")).na.drop()
    error = min(0.01, 0.25 / parts)
    return sorted({math.ceil(c) for c in cuts.approxQuantile("id", shares, error)})


def range_of(value: Column, bounds: list) -> Column:
    """Number of the range (from 0) that holds ``value``; nulls are in range 0."""
    if not bounds:
        return F.lit(0)
    literal = F.from_json(F.lit(str(bounds)), "array<bigint>")
    place = F.size(F.filter(literal, lambda b: b <= value))
    return F.when(value.isNull(), F.lit(0)).otherwise(place)
