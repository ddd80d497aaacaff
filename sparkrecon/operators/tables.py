"""From parsed rows to tables: one long frame for all tables, or typed frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.functions.rows import META_COLUMNS, row_fields, row_map
from sparkrecon.operators.skew import first_of_few, lookup_join


def table_columns(inserts: DataFrame) -> DataFrame:
    """``(schema, table, columns)``: the longest column list of each table, the
    first one among equals."""
    rank = F.struct((-F.size("columns")).alias("n"), "ord")
    held = inserts.select("schema", "table", "columns", "ord")
    return first_of_few(held, ["schema", "table"], "columns", rank)


def conform_columns(inserts: DataFrame) -> DataFrame:
    """Give all rows of a table its column list: values keep their position,
    short rows are filled with null and long rows cut."""
    lists = table_columns(inserts)
    wide = lookup_join(
        inserts.drop("columns"), lists, ["schema", "table"], "inner", ["ord"]
    )
    place = F.sequence(F.lit(0), F.size("columns") - 1)
    return wide.withColumn("values", F.transform(place, lambda i: F.get("values", i)))


def to_rows(inserts: DataFrame, fields: bool = False) -> DataFrame:
    """Long form ``(schema, table, ord, row)`` with each row as a map, on request with
    its ``fields`` beside it, for readers that need nothing else of a row."""
    named = [row_fields(F.col("columns")).alias("fields")] if fields else []
    row = row_map(F.col("columns"), F.col("values")).alias("row")
    return inserts.select("schema", "table", "ord", row, *named)


def long_form(
    df: DataFrame, table: str, order_by: Sequence[str], schema: str = "default"
) -> DataFrame:
    """Long form of a typed table. The order must identify a row and be text or
    whole numbers; it is kept as an array of sortable texts."""

    def sortable(name: str):
        value = F.col(f"`{name}`")
        if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint"):
            # Offset and padded, so the order of the texts is that of the numbers.
            shifted = value.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
            return F.lpad(shifted.cast("decimal(20,0)").cast("string"), 20, "0")
        return value.cast("string")

    entries = []
    for name in df.columns:
        if name not in META_COLUMNS:
            entries += [F.lit(name), F.col(f"`{name}`").cast("string")]
    return df.select(
        F.lit(schema).alias("schema"),
        F.lit(table).alias("table"),
        F.array(*[sortable(c) for c in order_by]).alias("ord"),
        F.create_map(*entries).alias("row"),
    )


def where_table(rows: DataFrame, table: str) -> DataFrame:
    """Rows of one table; the schema is not looked at."""
    return rows.where(F.col("table") == table)


def to_table(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Typed frame of one table out of the long form, all columns text."""
    return rows.select(*[F.try_element_at("row", F.lit(c)).alias(c) for c in columns])


def with_meta(df: DataFrame, schema: str, table: str) -> DataFrame:
    return df.withColumns({META_COLUMNS[0]: F.lit(schema), META_COLUMNS[1]: F.lit(table)})


def without_meta(df: DataFrame) -> DataFrame:
    return df.drop(*META_COLUMNS)


def tables_by_schema(inserts: DataFrame) -> Mapping[str, Mapping[str, DataFrame]]:
    """``{schema: {table: lazy frame}}``. Only the column lists reach the driver."""
    conformed = to_rows(conform_columns(inserts))
    catalog: dict[str, dict[str, DataFrame]] = {}
    for schema, table, columns in table_columns(inserts).toLocalIterator():
        part = conformed.where((F.col("schema") == schema) & (F.col("table") == table))
        catalog.setdefault(schema, {})[table] = to_table(part, list(dict.fromkeys(columns)))
    return catalog
