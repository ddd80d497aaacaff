"""Reconciliation of two sides of a table, or of many tables in one job.

Two front ends share one core. The *typed* form takes two DataFrames and
compares column by column inside code generation; the *long* form takes rows of
any number of tables as maps and compares field by field. Both bring a side into
the frame ``(keys..., r)`` or ``(keys..., o, r)`` - key columns, order and row.

One side has a winner per key, which every row of the other side meets:

``indexed``      the last source row of a key; destination rows meet it
``first_match``  the first destination row of a key; source rows meet it

Both sides go through one exchange, by key, and are sorted once: a key's winner stands
first, the other rows of its side after it, then the rows that meet it. So one pass
classifies the rows of both sides, extras and missing rows included, and counts them.

Two kinds of rows take another way, by joins with winners from partial aggregation.
Winners of keys with very many rows are shipped to the rows, which do not move. And
``indexed`` on two DataFrames needs no more than one join, which stays inside code
generation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkrecon.functions.rows import (
    META_COLUMNS,
    field_diff,
    map_text,
    typed_row_map,
    without_fields,
)
from sparkrecon.functions.text import norm_key, strip_text, text_or_token
from sparkrecon.operators.rollup import cap_rows
from sparkrecon.operators.skew import (
    HOT_LIMIT,
    find_hot,
    join_one,
    key_signature,
    lookup_join,
    repeat_rows,
    union_all,
)
from sparkrecon.operators.stage import staged
from sparkrecon.options import INDEXED, ReconOptions

STATUSES = ("match", "different", "missing", "extra")
COUNTS = (
    "rows_in_source",
    "rows_in_destination",
    "matching_rows",
    "different_rows",
    "missing_rows",
    "extra_rows",
)
KINDS = {name: (kind,) for name, kind in zip(COUNTS, ("source", "destination", *STATUSES))}


# --------------------------------------------------------------------------- sides


@dataclass(frozen=True)
class Pair:
    """Two sides in core form, and how their rows are compared and shown.

    ``loose`` holds both sides with the rows that lack a key (``keyed`` is false there):
    they are counted, but take no part."""

    source: DataFrame
    destination: DataFrame
    keys: tuple[str, ...]
    ordered: bool
    equal: Column
    present: Callable[[DataFrame], DataFrame]
    options: ReconOptions
    groups: tuple[str, ...] = ()
    loose: tuple[DataFrame, DataFrame] | None = None


def _check_columns(src: DataFrame, dst: DataFrame, key: str) -> None:
    for side, df in (("source", src), ("destination", dst)):
        if key not in df.columns:
            raise ValueError(f"key column {key!r} is missing on the {side}")
        folded = [c.lower() for c in df.columns]
        if len(set(folded)) != len(folded):
            raise ValueError(f"columns of the {side} differ only by case")
    names = {c.lower(): c for c in src.columns}
    for c in dst.columns:
        if names.get(c.lower(), c) != c:
            raise ValueError(f"column {c!r} differs from the source only by case")


def _is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _typed_keys(src: DataFrame, dst: DataFrame, key: str, options: ReconOptions):
    """Key expressions of both sides, equal exactly where the keys are equal.

    Keys of one non-text type stay in that type, with a flag for null instead
    of a null-safe join, so that the reduction and the join share a shuffle."""
    a, b = src.schema[key].dataType, dst.schema[key].dataType
    col = F.col(f"`{key}`")
    if a == b and isinstance(a, (T.IntegralType, T.DateType)):
        zero = F.lit(0).cast(a) if isinstance(a, T.IntegralType) else F.to_date(F.lit("1970-01-01"))
        return {"k": F.coalesce(col, zero), "k_null": col.isNull()}
    if options.mode == INDEXED:
        return {"k": norm_key(col, options.null_token)}
    return {"k": text_or_token(col, options.null_token)}


def _comparable(
    src: DataFrame, dst: DataFrame, name: str, options: ReconOptions
) -> tuple[Column, Column]:
    """Both values of a field in the form in which they are compared."""
    kinds = [df.schema[name].dataType if name in df.columns else None for df in (src, dst)]
    sides = ["s", "d"]
    if None in kinds:
        values = [
            F.col(f"{p}.`{name}`").cast("string") if k is not None else F.lit(None).cast("string")
            for p, k in zip(sides, kinds)
        ]
        kind: T.DataType = T.StringType()
    elif kinds[0] != kinds[1]:
        values = [F.col(f"{p}.`{name}`").cast("string") for p in sides]
        kind = T.StringType()
    else:
        values = [F.col(f"{p}.`{name}`") for p in sides]
        kind = kinds[0]
    if not _is_text(kind):
        return values[0], values[1]
    if options.mode == INDEXED:
        return strip_text(values[0]), strip_text(values[1])
    token = options.null_token
    return text_or_token(values[0], token), text_or_token(values[1], token)


def _compared_fields(src: DataFrame, dst: DataFrame, options: ReconOptions) -> list[str]:
    """Union of the columns without the excluded ones, or the common columns."""
    if options.mode == INDEXED:
        union = src.columns + [c for c in dst.columns if c not in src.columns]
        return [c for c in union if c not in options.exclude_fields and c not in META_COLUMNS]
    return [c for c in src.columns if c in dst.columns and c not in META_COLUMNS]


def typed_pair(
    src: DataFrame,
    dst: DataFrame,
    key: str | None = None,
    order_by: Sequence[str] | None = None,
    options: ReconOptions = ReconOptions(),
) -> Pair:
    """Two DataFrames of one table. Without ``order_by`` the rows of a key are
    ordered by all their columns; ties are broken by them in any case."""
    src, dst = src.drop(*META_COLUMNS), dst.drop(*META_COLUMNS)
    key = key or src.columns[0]
    _check_columns(src, dst, key)
    keys = _typed_keys(src, dst, key, options)
    fields = _compared_fields(src, dst, options)

    def core(df: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r")
        cols = [v.alias(n) for n, v in keys.items()]
        if order_by:
            cols.append(F.struct(*[F.col(f"`{c}`") for c in order_by]).alias("o"))
        return df.select(*cols, row)

    pairs = [_comparable(src, dst, c, options) for c in fields]
    equal = F.lit(True)
    for c, (a, b) in zip(fields, pairs):
        same = a.eqNullSafe(b)
        if c in src.columns and c in dst.columns and src.schema[c].dataType == dst.schema[c].dataType:
            # Values that are equal as they stand need no cleaning.
            same = F.col(f"s.`{c}`").eqNullSafe(F.col(f"d.`{c}`")) | same
        equal = equal & same

    strip = options.mode == INDEXED
    token = None if strip else options.null_token
    hidden = options.exclude_fields if strip else ()

    def present(df: DataFrame) -> DataFrame:
        def shown(value: Column) -> Column:
            text = value.cast("string")
            return text if token is None else F.coalesce(text, F.lit(token))

        entries = [
            F.when(
                ~a.eqNullSafe(b),
                F.struct(
                    F.lit(c).alias("key"),
                    F.struct(shown(a).alias("source"), shown(b).alias("destination")).alias("value"),
                ),
            )
            for c, (a, b) in zip(fields, pairs)
        ]
        diff = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
        held = F.coalesce(*[F.col(f"{p}.`{key}`").cast("string") for p in ("s", "d")])
        clean = norm_key if strip else text_or_token
        return _present(
            df,
            key_text=clean(held, options.null_token),
            source=typed_row_map(src.schema, "s", (), token, strip),
            plain=typed_row_map(src.schema, "s", hidden, token, strip),
            destination=typed_row_map(dst.schema, "d", (), token, strip),
            differences=diff,
        )

    orderable = all(_orderable(f.dataType) for f in [*src.schema.fields, *dst.schema.fields])
    if not orderable and not order_by:
        raise ValueError("rows with map columns need order_by")
    return Pair(core(src), core(dst), tuple(keys), not orderable, equal, present, options)


def long_pair(
    source: DataFrame,
    destination: DataFrame,
    options: ReconOptions = ReconOptions(),
) -> Pair:
    """Rows ``(table, key_column, ord, row)`` of many tables on both sides.

    Rows that lack the key field of their table take no part."""
    strip = options.mode == INDEXED

    def core(df: DataFrame) -> DataFrame:
        value = F.try_element_at("row", F.col("key_column"))
        key = norm_key(value, options.null_token) if strip else text_or_token(value, options.null_token)
        has_key = F.map_contains_key(F.col("row"), F.col("key_column"))
        # Rows without a key are dealt evenly.
        spread = F.xxhash64("ord").cast("string")
        return df.select(
            F.col("table"), F.when(has_key, key).otherwise(spread).alias("k"),
            F.col("ord").alias("o"), F.when(has_key, F.col("row")).alias("r"),
            has_key.alias("keyed"),
        )

    token = None if strip else options.null_token
    s, d = map_text(F.col("s"), token, strip), map_text(F.col("d"), token, strip)
    exclude = options.exclude_fields if strip else ()
    diff = field_diff(s, d, exclude, common_only=not strip)
    # Rows that are equal as they stand need no cleaning.
    same = F.map_entries("s").eqNullSafe(F.map_entries("d"))

    def present(df: DataFrame) -> DataFrame:
        return _present(
            df,
            key_text=F.col("k"),
            source=s,
            plain=without_fields(s, exclude),
            destination=d,
            differences=diff,
        )

    loose = core(source), core(destination)
    return Pair(
        *[side.where("keyed").drop("keyed") for side in loose], ("table", "k"), True,
        same | (F.size(diff) == 0), present, options, ("table",), loose,
    )


def _present(df, key_text, source, plain, destination, differences) -> DataFrame:
    """Detail rows: matching rows without the excluded fields, both sides and
    the differences of different rows, one side of missing and extra rows."""
    status = F.col("status")
    groups = [c for c in ("table", "from_source") if c in df.columns]
    return df.select(
        *groups,
        status,
        key_text.alias("key"),
        F.when(status == "match", plain)
        .when(status.isin("different", "missing"), source)
        .alias("source_row"),
        F.when(status.isin("different", "extra"), destination).alias("destination_row"),
        F.when(status == "different", differences).alias("differences"),
    )


# --------------------------------------------------------------------------- core


def _winner(side: DataFrame, pair: Pair, last: bool, name: str) -> DataFrame:
    """One row per key, combined before the shuffle.

    The order is followed by the whole row where it can be compared, so equal
    orders do not make the result depend on the run."""
    keys = list(pair.keys)
    has_order = "o" in side.columns
    if pair.ordered:
        pick = F.max_by("r", "o") if last else F.min_by("r", "o")
        return side.groupBy(*keys).agg(pick.alias(name))
    whole = F.struct("o", "r") if has_order else F.struct("r")
    best = F.max(whole) if last else F.min(whole)
    return side.groupBy(*keys).agg(best.alias("w")).select(*keys, F.col("w.r").alias(name))


def _rows(side: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return side.select(*keys, F.col("r").alias(name))


def _indexed_parts(pair: Pair) -> list[DataFrame]:
    """``(keys, s, d)`` with every destination row and every source key."""
    index = _winner(pair.source, pair, True, "s")
    rows = _rows(pair.destination, pair.keys, "d")
    hot = find_hot(rows, pair.keys, pair.options)
    return join_one(rows, index, pair.keys, "full", hot)


def _first_match_parts(pair: Pair) -> list[DataFrame]:
    """``(keys, s, d)`` with every source row and its first destination row."""
    first = _winner(pair.destination, pair, False, "d")
    rows = _rows(pair.source, pair.keys, "s")
    hot = find_hot(rows, pair.keys, pair.options)
    return join_one(rows, first, pair.keys, "left", hot)


def _classify(df: DataFrame, pair: Pair) -> DataFrame:
    status = (
        F.when(F.col("s").isNull(), "extra")
        .when(F.col("d").isNull(), "missing")
        .when(pair.equal, "match")
        .otherwise("different")
    )
    return df.withColumn("status", status)


def _first_match_extras(pair: Pair) -> DataFrame:
    """Destination rows that no source row was matched with: all rows of keys
    unknown to the source, and all but the first row of the other keys."""
    keys = list(pair.keys)
    dst = pair.destination
    order = ["o"] if pair.ordered else (["o", "r"] if "o" in dst.columns else ["r"])
    place = F.struct(*order)
    first = dst.groupBy(*keys).agg(F.min(place).alias("f"))
    known = pair.source.groupBy(*keys).agg(F.lit(True).alias("known"))
    info = first.join(known, keys, "left")
    hot = find_hot(dst.select(*keys), keys, pair.options)
    parts = join_one(dst.withColumn("p", place), info, keys, "inner", hot)
    # No row comes before the first one, so "not after" means equal; as a range
    # condition it leaves both joins below on the same keys and shuffles.
    is_first = F.coalesce(F.col("known"), F.lit(False)) & (F.col("p") <= F.col("f"))
    extras = [p.where(~is_first).select(*keys, F.col("r").alias("d")) for p in parts]
    if not pair.ordered:
        # Exact copies of the first row: one of them was matched, the rest is extra.
        for p in parts:
            again = (
                p.where(is_first)
                .groupBy(*keys)
                .agg((F.count("*") - 1).alias("n"), F.first("r").alias("d"))
            )
            extras.append(repeat_rows(again, "n"))
    return union_all(extras)


def capped(frame: DataFrame, pair: Pair, limit: int | None) -> DataFrame:
    """At most ``limit`` rows per table and class, the first by key, cut before
    the detail maps are built."""
    if limit is None:
        return frame
    held = frame.schema["s"].dataType
    sides = [F.map_entries(c) if isinstance(held, T.MapType) else F.col(c) for c in ("s", "d")]
    names = [f"_k{i}" for i, _ in enumerate(pair.keys)]
    texts = {n: F.col(k).cast("string") for n, k in zip(names, pair.keys)}
    if all(_hashable(frame.schema[c].dataType) for c in ("s", "d")):
        texts["_h"] = F.xxhash64(*sides)
    cut = cap_rows(frame.withColumns(texts), [*pair.groups, "status"], list(texts), limit)
    return cut.drop(*texts)


def _hashable(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType) or _orderable(kind)


def _together(pair: Pair) -> DataFrame:
    """``(keys, from_source, s, d, status)``, a row for each row of both sides in one
    exchange and one sort. Rows without a class of their own have no status: winners that
    were met and the rows behind a winner, but for those of ``first_match``, which are
    extra."""
    indexed, keys = pair.options.mode == INDEXED, [*pair.keys, "keyed"]
    sides = pair.loose or [side.withColumn("keyed", F.lit(True)) for side in (pair.source, pair.destination)]
    types = [side.schema["r"].dataType for side in sides]
    order = sides[0 if indexed else 1]

    def side(which: int) -> DataFrame:
        rows, meets = sides[which], which == (1 if indexed else 0)
        held = [F.lit(None).cast(types[0]).alias("s"), F.lit(None).cast(types[1]).alias("d")]
        held[which] = F.col("r").alias("sd"[which])
        place = []
        if "o" in order.columns:
            kind = order.schema["o"].dataType
            place = [(F.lit(None).cast(kind) if meets else F.col("o")).alias("o")]
        return rows.select(*keys, F.lit(which == 0).alias("from_source"), F.lit(meets).alias("meets"), *place, *held)

    ties = [c for c in ("o",) if c in order.columns]
    ties += [] if pair.ordered else ["s" if indexed else "d"]
    by = [F.col(c).desc() if indexed else F.col(c).asc() for c in ties]
    rows = Window.partitionBy(*keys).orderBy(F.col("meets"), *by)
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mine, other = ("s", "d") if indexed else ("d", "s")
    found = side(0).unionByName(side(1)).select(
        "*",
        F.first(F.when(~F.col("meets"), F.col(mine))).over(so_far).alias("winner"),
        (F.row_number().over(rows) == 1).alias("wins"),
        F.last("meets").over(whole).alias("is_met"),
    )
    met = F.when(F.col("meets"), F.col("winner")).otherwise(F.col(mine))
    found = found.withColumn(mine, met)
    unmet = F.col("s").isNull() | F.col("d").isNull()
    if indexed:
        lone = F.when(F.col("wins") & ~F.col("is_met"), "missing")
    else:
        lone = F.when(~(F.col("wins") & F.col("is_met")), "extra")
    status = F.when(
        F.col("meets"),
        F.when(unmet, "extra" if indexed else "missing").when(pair.equal, "match").otherwise("different"),
    ).otherwise(lone)
    return found.select(*keys, "from_source", "s", "d", F.when(F.col("keyed"), status).alias("status"))


def _parted(pair: Pair) -> tuple[Pair | None, Pair | None]:
    """The pair of the rows that go through one exchange, and the pair of those that
    are joined: rows of hot keys, or all, if there may be more hot keys than are known
    or one join is all it takes."""
    if pair.options.mode == INDEXED and not pair.loose:
        return None, pair
    keys = list(pair.keys)
    both = pair.source.select(*keys).unionByName(pair.destination.select(*keys))
    hot = find_hot(both, keys, pair.options)
    if not hot:
        return pair, None
    if len(hot) >= HOT_LIMIT:
        return None, pair
    is_hot = F.coalesce(key_signature(keys).isin(*hot), F.lit(False))

    def only(condition: Column, loose: bool) -> Pair:
        held = pair.loose and tuple(side.where(~F.col("keyed") | condition) for side in pair.loose)
        source, destination = (side.where(condition) for side in (pair.source, pair.destination))
        return replace(pair, source=source, destination=destination, loose=held if loose else None)

    return only(~is_hot, True), only(is_hot, False)


def _joined(pair: Pair) -> DataFrame:
    """``(keys, s, d, status)`` by joins, for hot keys."""
    if pair.options.mode == INDEXED:
        return _classify(union_all(_indexed_parts(pair)), pair)
    matched = _classify(union_all(_first_match_parts(pair)), pair)
    extras = _first_match_extras(pair)
    none = F.lit(None).cast(matched.schema["s"].dataType)
    return matched.unionByName(
        extras.withColumn("s", none).withColumn("status", F.lit("extra"))
    )


def classified(pair: Pair) -> DataFrame:
    """``(keys, s, d, status)``, one row per classified row."""
    cold, hot = _parted(pair)
    parts = []
    if cold is not None:
        rows = _together(cold).where(F.col("status").isNotNull())
        parts.append(rows.select(*pair.keys, "s", "d", "status"))
    if hot is not None:
        parts.append(_joined(hot).select(*pair.keys, "s", "d", "status"))
    return union_all(parts)


# --------------------------------------------------------------------------- counts


def _rows_of(df: DataFrame, groups: Sequence[str], kind: str) -> DataFrame:
    """``(groups, kind, n)`` to be summed, one row per row of a side."""
    return df.selectExpr(*groups, f"'{kind}' AS kind", "1L AS n")


def _indexed_counts(pair: Pair) -> list[DataFrame]:
    return [
        _classify(part, pair).selectExpr(*pair.groups, "status AS kind", "1L AS n")
        for part in _indexed_parts(pair)
    ]


def _first_match_counts(pair: Pair) -> list[DataFrame]:
    """Each key met takes one destination row; all others are extra, so the extra
    rows are counted as the destination's rows less the keys met. The counts per
    key need no further shuffle: the join has just placed them by key."""
    groups, keys = list(pair.groups), list(pair.keys)
    parts = []
    for part in _first_match_parts(pair):
        per_key = _classify(part, pair).groupBy(*keys).agg(
            F.expr("count_if(status = 'match') AS n_match"),
            F.expr("count_if(status = 'different') AS n_different"),
            F.expr("count_if(status = 'missing') AS n_missing"),
            F.expr("cast(bool_or(d IS NOT NULL) AS bigint) AS n_met"),
        )
        totals = per_key.groupBy(*groups).agg(
            F.expr(
                "array(named_struct('kind', 'match', 'n', sum(n_match)),"
                " named_struct('kind', 'different', 'n', sum(n_different)),"
                " named_struct('kind', 'missing', 'n', sum(n_missing)),"
                " named_struct('kind', 'extra', 'n', -sum(n_met))) AS counts"
            )
        )
        parts.append(totals.select(*groups, F.inline("counts")))
    return parts


def _counted(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``(groups, kind, n)``: the rows of :func:`_together` by side and by status."""
    counts = rows.groupBy(*groups, "from_source", "status").agg(F.count("*").alias("n"))
    side = F.when(F.col("from_source"), "source").otherwise("destination")
    kinds = F.array(
        F.struct(side.alias("kind"), F.col("n")), F.struct(F.col("status").alias("kind"), F.col("n"))
    )
    return counts.select(*groups, F.inline(kinds)).where(F.col("kind").isNotNull())


def count_pair(pair: Pair) -> DataFrame:
    """Counts of a pair, one row per group, from the rows as they are classified: each
    side is read once, and its rows without a key are counted on the way."""
    groups = list(pair.groups)
    cold, hot = _parted(pair)
    parts = []
    if cold is not None:
        parts.append(_counted(_together(cold), groups))
    indexed = pair.options.mode == INDEXED
    kinds = dict(KINDS)
    if hot is not None:
        raw = dict(zip(COUNTS, hot.loose or (hot.source, hot.destination)))
        if cold is None and not pair.loose:
            # All rows of the side that meets the winners have a class.
            del raw[COUNTS[1 if indexed else 0]]
            kinds[COUNTS[1 if indexed else 0]] = ["match", "different", "extra" if indexed else "missing"]
        parts += [_rows_of(side, groups, *kinds[name]) for name, side in raw.items()]
        if indexed:
            parts += _indexed_counts(hot)
        else:
            # All destination rows but those that were met, which are counted as less.
            parts += [*_first_match_counts(hot), _rows_of(hot.destination, groups, "extra")]

    return _totals(parts, pair, kinds)


def _totals(parts: Sequence[DataFrame], pair: Pair, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """The counts of each group from parts ``(groups, kind, n)``."""
    groups = list(pair.groups)

    def total(name: str) -> Column:
        held = ", ".join(f"'{kind}'" for kind in kinds[name])
        return F.expr(f"coalesce(sum(n) FILTER (WHERE kind IN ({held})), 0L) AS {name}")

    counts = union_all(parts).groupBy(*groups).agg(*[total(name) for name in COUNTS])
    if pair.options.compat_empty_side:
        both = "rows_in_source > 0 AND rows_in_destination > 0"
        counts = counts.selectExpr(
            *groups, *COUNTS[:2], *[f"if({both}, {c}, 0L) AS {c}" for c in COUNTS[2:]]
        )
    return counts


def with_flags(counts: DataFrame) -> DataFrame:
    bad = "different_rows > 0 OR missing_rows > 0 OR extra_rows > 0"
    return counts.selectExpr("*", f"{bad} AS has_differences", f"NOT ({bad}) AS success")


def _digest_pair(
    src: DataFrame, dst: DataFrame, key: str | None, order_by, options: ReconOptions
) -> Pair:
    """A pair whose rows are a wide hash over the compared values.

    Only for counts: the shuffles carry key, order and hash instead of rows."""
    key = key or src.columns[0]
    _check_columns(src, dst, key)
    fields = sorted(_compared_fields(src, dst, options))
    full = typed_pair(src, dst, key, order_by, options)

    def digest(df: DataFrame, which: int) -> DataFrame:
        values: list[Column] = []
        for name in fields:
            value = _comparable(src, dst, name, options)[which]
            # A null leaves a hash unchanged, so it is hashed as a flag of its own.
            values += [value, value.isNull()]
        row = df.withColumnRenamed("r", "sd"[which])
        return row.withColumn("r", _wide_hash(values)).drop("s", "d")

    # An order of one number or day and a numeric digest are combined by hashing.
    kind = src.schema[order_by[0]].dataType
    numeric = isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType))
    flat = len(order_by) == 1 and numeric

    def order(df: DataFrame) -> DataFrame:
        return df.withColumn("o", F.col(f"o.`{order_by[0]}`")) if flat else df

    return replace(
        full,
        source=order(digest(full.source, 0)),
        destination=order(digest(full.destination, 1)),
        ordered=flat,
        equal=F.col("s").eqNullSafe(F.col("d")),
    )


def _wide_hash(values: Sequence[Column]) -> Column:
    """126 bits of two independent hashes as one decimal number."""
    def half(*columns: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*columns), 1).cast("decimal(19,0)")

    high = half(*values) * F.lit(str(1 << 63)).cast("decimal(19,0)")
    return (high + half(F.lit("second"), *values)).cast("decimal(38,0)")


# --------------------------------------------------------------------------- public


def reconcile(
    src: DataFrame,
    dst: DataFrame,
    key: str | None = None,
    order_by: Sequence[str] | None = None,
    options: ReconOptions = ReconOptions(),
    limit: int | None = None,
) -> DataFrame:
    """Detail rows ``(status, key, source_row, destination_row, differences)``
    of one typed table; the key defaults to the first source column. ``limit``
    keeps the first rows of each class only."""
    if options.compat_empty_side and (src.isEmpty() or dst.isEmpty()):
        # Left unclassified, as the counts have it.
        src, dst = src.where("false"), dst.where("false")
    pair = typed_pair(src, dst, key, order_by, options)
    return pair.present(capped(classified(pair), pair, limit))


def reconcile_summary(
    src: DataFrame,
    dst: DataFrame,
    table: str,
    key: str | None = None,
    order_by: Sequence[str] | None = None,
    options: ReconOptions = ReconOptions(),
    compare: str = "exact",
) -> DataFrame:
    """One summary row of a typed table.

    ``compare='digest'`` shuffles a 126-bit hash per row instead of the row; it
    needs an ``order_by`` that decides between different rows of a key."""
    if compare not in ("exact", "digest"):
        raise ValueError(f"unknown comparison {compare!r}")
    if compare == "digest" and not order_by:
        raise ValueError("compare='digest' needs order_by")
    if compare == "digest":
        pair = _digest_pair(src, dst, key, order_by, options)
    else:
        pair = typed_pair(src, dst, key, order_by, options)
    return with_flags(count_pair(pair)).select(F.lit(table).alias("table"), "*")


def reconcile_tables(
    tables: Mapping[str, tuple[DataFrame, DataFrame]],
    keys: Mapping[str, str] | None = None,
    order_by: Mapping[str, Sequence[str]] | None = None,
    options: ReconOptions = ReconOptions(),
) -> DataFrame:
    """Summary rows of several typed tables, as one lazy plan."""
    keys, order_by = keys or {}, order_by or {}
    return union_all(
        [
            reconcile_summary(s, d, name, keys.get(name), order_by.get(name), options)
            for name, (s, d) in sorted(tables.items())
        ]
    )


def reconcile_rows(
    source: DataFrame,
    destination: DataFrame,
    options: ReconOptions = ReconOptions(),
    limit: int | None = None,
) -> DataFrame:
    """Detail rows of all tables of two long frames in one job, on request the
    first ``limit`` rows of each table and class only."""
    pair = long_pair(source, destination, options)
    details = pair.present(capped(classified(pair), pair, limit))
    if options.compat_empty_side:
        names = source.select("table").distinct()
        other = destination.select("table").distinct()
        both = names.join(other, "table", "left_semi")
        details = lookup_join(details, both, ["table"], "left_semi", ["key"])
    return details


def reconcile_rows_summary(
    source: DataFrame, destination: DataFrame, options: ReconOptions = ReconOptions()
) -> DataFrame:
    """Summary rows of all tables of two long frames in one job."""
    return with_flags(count_pair(long_pair(source, destination, options)))


def reconcile_rows_once(
    source: DataFrame, destination: DataFrame, options: ReconOptions = ReconOptions()
) -> tuple[DataFrame, DataFrame]:
    """``(summary, details)`` of all tables of two long frames from one comparison.

    The rows are classified once and written to the folder for intermediate results,
    those without a class as a mere mark of their side; counts and details read them
    from there. The rows of hot keys are counted by class, their sides by one scan."""
    pair = long_pair(source, destination, options)
    groups = list(pair.groups)
    cold, hot = _parted(pair)
    parts, shown = [], []
    if cold is not None:
        rows = staged(pair.present(_together(cold)))
        parts.append(_counted(rows, groups))
        shown.append(rows.where("status IS NOT NULL").drop("from_source"))
    if hot is not None:
        rows = staged(pair.present(_joined(hot)))
        parts.append(rows.groupBy(*groups, F.col("status").alias("kind")).agg(F.count("*").alias("n")))
        sides = hot.loose or (hot.source, hot.destination)
        parts += [_rows_of(side, groups, kind) for side, kind in zip(sides, ("source", "destination"))]
        shown.append(rows)
    summary = with_flags(_totals(parts, pair, KINDS))
    details = union_all(shown)
    if options.compat_empty_side:
        both = summary.where("rows_in_source > 0 AND rows_in_destination > 0").select("table")
        details = lookup_join(details, both, ["table"], "left_semi", ["key"])
    return summary, details
