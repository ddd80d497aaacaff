"""Matching rows of two frames by key or by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.functions.rows import META_COLUMNS, row_hash
from sparkrecon.operators.skew import find_hot, join_one, union_all
from sparkrecon.options import ReconOptions


def with_row_hash(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    names = [c for c in df.columns if c not in ignore]
    return df.withColumn("row_hash", row_hash(names))


def match_rows(
    df1: DataFrame,
    df2: DataFrame,
    row_id: str,
    primary_key: str | None = None,
    options: ReconOptions = ReconOptions(),
) -> DataFrame:
    """``(row_id, matched_row_id)``: each row of ``df1`` with its first partner.

    With a key both sides have, partners have the same key; a null key has none.
    Without one they have the same content (``row_id`` aside). The first partner
    is the one with the smallest ``row_id``."""
    shared = primary_key in df1.columns and primary_key in df2.columns
    if primary_key and shared:
        def side(df: DataFrame) -> DataFrame:
            held = df.where(F.col(f"`{primary_key}`").isNotNull())
            return held.select(F.col(f"`{primary_key}`").alias("m"), F.col(row_id).alias("i"))
    else:
        def side(df: DataFrame) -> DataFrame:
            hashed = with_row_hash(df.drop(*META_COLUMNS), (row_id,))
            return hashed.select(F.col("row_hash").alias("m"), F.col(row_id).alias("i"))

    first = side(df2).groupBy("m").agg(F.min("i").alias("matched_row_id"))
    rows = side(df1)
    parts = join_one(rows, first, ["m"], "inner", find_hot(rows, ["m"], options))
    return union_all(parts).select(F.col("i").alias("row_id"), "matched_row_id")
