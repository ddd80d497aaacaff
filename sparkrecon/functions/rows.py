"""Expressions over whole rows, for the map form and the typed form."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrecon.functions.text import strip_text, strip_value, text_or_token

META_COLUMNS = ("__schema__", "__table__")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. (An expression named twice, or inside
    a lambda, may be computed anew each time.)"""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_map(columns: Column, values: Column) -> Column:
    """Map of two parallel arrays; of a repeated column the last value wins.

    The duplicates are removed here, so the result does not depend on the
    session's map key policy."""
    pairs = F.arrays_zip(columns.alias("c"), values.alias("v"))
    last = F.filter(
        pairs,
        lambda p, i: ~F.array_contains(
            F.slice(columns, i + 2, F.size(columns)), p["c"]
        ),
    )
    plain = F.map_from_arrays(columns, values)
    deduped = F.map_from_arrays(
        F.transform(last, lambda p: p["c"]), F.transform(last, lambda p: p["v"])
    )
    distinct = F.size(F.array_distinct(columns)) == F.size(columns)
    return F.when(distinct, plain).otherwise(deduped)


def row_fields(columns: Column) -> Column:
    """The fields of :func:`row_map` in order, without the map."""
    last = F.filter(
        columns, lambda c, i: ~F.array_contains(F.slice(columns, i + 2, F.size(columns)), c)
    )
    return F.when(F.size(F.array_distinct(columns)) == F.size(columns), columns).otherwise(last)


def map_text(row: Column, null_token: str | None = None, strip: bool = True) -> Column:
    """Clean all values of a map the way they are compared."""

    def clean(_key: Column, value: Column) -> Column:
        text = strip_value(value) if strip else value.cast("string")
        return text if null_token is None else F.coalesce(text, F.lit(null_token))

    return F.transform_values(row, clean)


def without_fields(row: Column, names: Sequence[str]) -> Column:
    if not names:
        return row
    return F.map_filter(row, lambda k, _v: ~k.isin(*names))


def field_diff(
    source: Column,
    destination: Column,
    exclude: Sequence[str] = (),
    common_only: bool = False,
) -> Column:
    """``{field: {source, destination}}`` of the fields that differ.

    Over the union of the fields an absent field equals null; with
    ``common_only`` fields of one side only are not looked at."""
    left, right = without_fields(source, exclude), without_fields(destination, exclude)
    if common_only:
        left, right = (
            F.map_filter(left, lambda k, _v: F.map_contains_key(right, k)),
            F.map_filter(right, lambda k, _v: F.map_contains_key(left, k)),
        )
    zipped = F.map_zip_with(
        left,
        right,
        lambda _k, a, b: F.when(
            ~a.eqNullSafe(b), F.struct(a.alias("source"), b.alias("destination"))
        ),
    )
    return F.map_filter(zipped, lambda _k, v: v.isNotNull())


def typed_row_map(
    schema: T.StructType,
    prefix: str,
    exclude: Sequence[str] = (),
    null_token: str | None = None,
    strip: bool = True,
) -> Column:
    """Display map of a struct column ``prefix`` with the given fields."""
    entries: list[Column] = []
    for f in schema.fields:
        if f.name in exclude:
            continue
        value = F.col(f"{prefix}.`{f.name}`")
        text = strip_text(value) if strip else value.cast("string")
        if null_token is not None:
            text = F.coalesce(text, F.lit(null_token))
        entries += [F.lit(f.name), text]
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*entries)


def row_hash(columns: Sequence[str]) -> Column:
    """MD5 of the JSON of a row with its columns sorted by name, nulls kept.

    The order of the columns therefore does not matter; cells are not trimmed."""
    names = sorted(c for c in columns if c not in META_COLUMNS)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    return F.md5(F.to_json(row, {"ignoreNullFields": "false"}))


__all__ = [
    "META_COLUMNS",
    "field_diff",
    "map_text",
    "row_fields",
    "row_hash",
    "row_map",
    "text_or_token",
    "typed_row_map",
    "without_fields",
]
