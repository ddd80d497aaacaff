"""Joins and look-ups that hold when one key owns a large share of the rows.

A reconciliation joins a side that keeps its duplicates ("many") with a side
that was reduced to one row per key ("one"). A hot key puts its many-side rows
into a single task. Here the hot keys are found with a constant-size sketch;
their rows never shuffle: they meet the at most ``HOT_LIMIT`` one-side rows of
the hot keys in a broadcast join, and all other rows take the shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.options import ReconOptions

HOT_LIMIT = 64
SKETCH_ITEMS = 10_000
# Metadata of tables (names, column lists, chosen keys) is broadcast up to so
# many rows and bytes; beyond either the look-up is salted.
LOOKUP_LIMIT = 50_000
LOOKUP_BYTES = 16 << 20
SALTS = 64


def estimated_bytes(df: DataFrame) -> int:
    """Size of what a frame reads, very large for inputs of unknown size.

    The inputs are added up, since the estimate of a join multiplies its sides."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(
        int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())
    )


def key_signature(keys: Sequence[str]) -> Column:
    """One text per key tuple; the lengths keep different tuples apart."""
    parts: list[Column] = []
    for k in keys[:-1]:
        text = F.col(k).cast("string")
        parts += [F.length(text).cast("string"), F.lit(":"), text]
    parts.append(F.col(keys[-1]).cast("string"))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int) -> list[str]:
    """Signatures of the keys with at least ``min_rows`` rows of ``df``, most first.

    One pass over the key columns with a bounded sketch and no shuffle of rows;
    the driver receives at most ``HOT_LIMIT`` texts. Only keys that do occur are
    reported. The list steers placement alone: any list gives the same result.
    """
    top = df.select(key_signature(keys).alias("sig")).agg(
        F.count("*").alias("n"),
        F.expr(f"approx_top_k(sig, {HOT_LIMIT}, {SKETCH_ITEMS})").alias("top"),
    )
    row = top.first()
    if row is None or not row["n"]:
        return []
    return [t["item"] for t in row["top"] if t["item"] is not None and t["count"] >= min_rows]


def find_hot(df: DataFrame, keys: Sequence[str], options: ReconOptions) -> list[str]:
    """Hot keys if the options ask for them and ``df`` is large enough to care."""
    if options.skew == "never":
        return []
    if options.skew == "auto" and estimated_bytes(df) < options.skew_min_bytes:
        return []
    return hot_keys(df, keys, options.skew_min_rows)


def join_one(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str,
    hot: Sequence[str],
) -> list[DataFrame]:
    """Join ``many`` with ``one`` (unique on ``keys``); the parts form the result.

    ``how`` is ``inner``, ``left`` or ``full``, seen from ``many``. Every hot key
    occurs in ``many``, so its part needs no unmatched rows of ``one``. If the list
    of hot keys is full there may be more of them: the other rows then take joins
    whose skewed tasks Spark can split, which a full outer join does not allow."""
    keys = list(keys)
    if not hot:
        return [many.join(one, keys, how)]
    is_hot = F.coalesce(key_signature(keys).isin(*hot), F.lit(False))
    few = F.broadcast(one.where(is_hot))
    warm = many.where(is_hot).join(few, keys, "left" if how == "full" else how)
    rest, others = many.where(~is_hot), one.where(~is_hot)
    if how != "full" or len(hot) < HOT_LIMIT:
        return [rest.join(others, keys, how), warm]
    unmatched = others.join(rest.select(*keys).distinct(), keys, "left_anti")
    own = [F.lit(None).cast(f.dataType).alias(f.name) for f in many.schema if f.name not in keys]
    theirs = [c for c in one.columns if c not in keys]
    return [rest.join(others, keys, "left"), unmatched.select(*keys, *own, *theirs), warm]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def small_table(df: DataFrame) -> DataFrame:
    """A metadata table computed once, if it is small; else the frame itself.

    Up to ``LOOKUP_LIMIT`` rows are fetched and, if they take ``LOOKUP_BYTES`` at
    most, kept as a local relation."""
    if _is_local(df):
        return df
    rows = df.limit(LOOKUP_LIMIT + 1).toArrow()
    if rows.num_rows > LOOKUP_LIMIT or rows.nbytes > LOOKUP_BYTES:
        return df
    return df.sparkSession.createDataFrame(rows, df.schema)


def _is_local(df: DataFrame) -> bool:
    """Whether the rows of a frame are already on the driver."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.getClass().getSimpleName() == "LocalRelation"


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str,
    salt_by: Sequence[str],
) -> DataFrame:
    """Join with a metadata table that is unique on ``on`` and usually small.

    If :func:`small_table` holds it, it is shipped to the tasks, so ``big`` does not
    shuffle. Else both sides are salted, so a value of ``on`` that owns a
    third of ``big`` still spreads over many tasks."""
    held = small_table(small)
    if _is_local(held):
        return big.join(F.broadcast(held), list(on), how)
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = big.withColumn("_salt", salt)
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def ordered_lookup(
    big: DataFrame, small: DataFrame, on: Sequence[str], groups: Sequence[str], order: str,
    how: str = "inner",
) -> DataFrame:
    """:func:`lookup_join` for a reader that needs the rows of each of ``groups`` in one
    task, in ``order``. ``big`` has them so, and a small table leaves them so; only
    after a salted look-up they are brought together again."""
    held = small_table(small)
    if _is_local(held):
        return big.join(F.broadcast(held), list(on), how)
    joined = lookup_join(big, held, on, how, [order])
    return joined.repartition(*groups).sortWithinPartitions(*groups, order)


def repeat_rows(df: DataFrame, times: str, block: int = 10_000) -> DataFrame:
    """Each row ``times`` times, for counts of any size.

    The copies are cut into blocks that are dealt evenly over the tasks before
    they are written out, so neither a row with billions of copies nor many rows
    with few are one task's work."""
    blocks = df.where(F.col(times) > 0).withColumn(
        "_block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / block))),
    )
    spread = blocks.hint("rebalance")
    left = F.least(F.lit(block).cast("long"), F.col(times) - F.col("_block") * block)
    return spread.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), left))
    ).drop("_block", "_copy", times)


def first_of_few(
    df: DataFrame, groups: Sequence[str], value: str, rank: Column
) -> DataFrame:
    """``(groups, value)`` with the value of the row of smallest ``rank``, for a
    value that has few variants per group, such as a column list.

    Reducing to the variants needs no sort and mostly decides already; only the
    groups with several variants are ranked row by row."""
    groups = list(groups)
    ranked = df.groupBy(*groups).agg(F.min_by(value, rank).alias(value))
    variants = small_table(df.select(*groups, value).distinct())
    if not _is_local(variants):
        return ranked
    counted = variants.groupBy(*groups).agg(
        F.count("*").alias("_n"), F.any_value(value).alias(value)
    )
    sure = counted.where("_n = 1").drop("_n")
    open_groups = small_table(counted.where("_n > 1").select(*groups))
    if open_groups.isEmpty():
        return small_table(sure)
    rest = df.join(F.broadcast(open_groups), groups, "left_semi")
    found = rest.groupBy(*groups).agg(F.min_by(value, rank).alias(value))
    return sure.unionByName(found)
