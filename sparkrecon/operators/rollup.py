"""Counts over reconciled tables, and the listings of detail rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrecon.functions.text import match_percentage, status_text
from sparkrecon.operators.keys import display_key_of
from sparkrecon.operators.skew import lookup_join
from sparkrecon.options import DETAIL_CAP

# Groups are first ranked in this many pieces, so that no task sees more than
# this many times the limit of one group.
PIECES = 64


def overall(summary: DataFrame) -> DataFrame:
    """One row over all tables: totals, success and share of matching rows."""
    totals = summary.agg(
        F.count("*").alias("total_tables"),
        F.coalesce(F.sum("rows_in_source"), F.lit(0)).alias("total_rows_source"),
        F.coalesce(F.sum("rows_in_destination"), F.lit(0)).alias("total_rows_destination"),
        F.coalesce(F.sum("matching_rows"), F.lit(0)).alias("total_matching_rows"),
        F.coalesce(F.sum("different_rows"), F.lit(0)).alias("total_different_rows"),
        F.coalesce(F.sum("missing_rows"), F.lit(0)).alias("total_missing_rows"),
        F.coalesce(F.sum("extra_rows"), F.lit(0)).alias("total_extra_rows"),
        F.coalesce(F.bool_and(~F.col("has_differences")), F.lit(True)).alias("all_matched"),
    )
    share = match_percentage(F.col("total_matching_rows"), F.col("total_rows_source"))
    return totals.withColumn("match_percentage", share)


def with_match_percentage(summary: DataFrame) -> DataFrame:
    share = match_percentage(F.col("matching_rows"), F.col("rows_in_source"))
    return summary.withColumn("match_percentage", share)


def result_listing(summary: DataFrame) -> DataFrame:
    """Per table what a result page shows."""
    match = ~F.col("has_differences")
    return summary.select(
        F.col("table").alias("table_name"),
        F.col("rows_in_source").alias("source_count"),
        F.col("rows_in_destination").alias("destination_count"),
        match.alias("match"),
        "matching_rows",
        "different_rows",
        "missing_rows",
        "extra_rows",
        status_text(match, F.col("different_rows"), F.col("missing_rows")).alias("status_text"),
    )


def row_counts(rows: DataFrame) -> DataFrame:
    """Rows per schema and table."""
    return rows.groupBy("schema", "table").agg(F.count("*").alias("row_count"))


def cap_rows(
    df: DataFrame, groups: Sequence[str], order_by: Sequence[str], limit: int
) -> DataFrame:
    """The first ``limit`` rows of each group, in the order given.

    Both windows filter on the rank, so each task forwards at most ``limit``
    rows per group and piece instead of shuffling the group."""
    piece = F.pmod(F.xxhash64(*order_by), F.lit(PIECES))
    split = df.withColumn("_piece", piece)
    inner = Window.partitionBy(*groups, "_piece").orderBy(*order_by)
    outer = Window.partitionBy(*groups).orderBy(*order_by)
    return (
        split.withColumn("_rank", F.row_number().over(inner))
        .where(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(outer))
        .where(F.col("_rank") <= limit)
        .drop("_rank", "_piece")
    )


def cap_details(details: DataFrame, limit: int = DETAIL_CAP) -> DataFrame:
    """At most ``limit`` detail rows per table and class, by key."""
    groups = ["table", "status"] if "table" in details.columns else ["status"]
    sides = [F.map_entries("source_row"), F.map_entries("destination_row")]
    marked = details.withColumn("_h", F.xxhash64(*sides))
    return cap_rows(marked, groups, ["key", "_h"], limit).drop("_h")


def diff_listing(details: DataFrame, id_field: str | None = None) -> DataFrame:
    """One row per differing field: ``(table, row_id, field, source, destination)``.

    The row id is ``id_field``, by default the record's own ``*_id`` field (or
    the first field) of the first different row of the table; ``N/A`` if a row
    lacks it."""
    different = details.where(F.col("status") == "different")
    groups = ["table"] if "table" in details.columns else []
    if id_field is not None:
        named = different.withColumn("id_field", F.lit(id_field))
    elif not groups:
        # A typed table: all rows have the same fields.
        named = different.withColumn("id_field", display_key_of(F.map_keys("source_row")))
    else:
        order = F.struct("key", F.to_json("source_row"))
        heads = different.groupBy("table").agg(
            F.min_by(display_key_of(F.map_keys("source_row")), order).alias("id_field")
        )
        named = lookup_join(different, heads, ["table"], "inner", ["key"])
    held = F.map_contains_key("source_row", F.col("id_field"))
    row_id = F.when(held, F.try_element_at("source_row", F.col("id_field"))).otherwise("N/A")
    return named.select(
        *groups, row_id.alias("row_id"), F.explode("differences").alias("field", "v")
    ).select(
        *groups,
        "row_id",
        "field",
        F.col("v.source").alias("source_value"),
        F.col("v.destination").alias("destination_value"),
    )


def missing_listing(details: DataFrame) -> DataFrame:
    """Missing rows field by field: ``(table, key, field, value)`` under the
    fields of the first missing row of the table; an absent field is ``N/A``."""
    missing = details.where(F.col("status") == "missing")
    order = F.struct("key", F.to_json("source_row"))
    heads = missing.groupBy("table").agg(
        F.min_by(F.map_keys("source_row"), order).alias("fields")
    )
    wide = lookup_join(missing.select("table", "key", "source_row"), heads, ["table"], "inner", ["key"])
    value = F.when(
        F.map_contains_key("source_row", F.col("field")),
        F.try_element_at("source_row", F.col("field")),
    ).otherwise(F.lit("N/A"))
    return wide.withColumn("field", F.explode("fields")).select(
        "table", "key", "field", value.alias("value")
    )
