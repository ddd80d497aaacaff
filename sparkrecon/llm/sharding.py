"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to a shard. At each level
every child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the
child's name; the smallest draw wins, so a child gets its weight's share. A draw
depends on nothing but key, child and weight: if weights change, only rows that
move into or out of the changed subtrees move at all."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecon.llm.common import staged

#: Shards of a tree before it grows, shards of a rack, racks of a region.
BASE, RACK, REGION = 40, 4, 2
#: Rows of one block when slots are numbered.
BLOCK_ROWS = 200_000


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree_of(shards: int, base: int = BASE) -> list[Leaf]:
    """The tree of a number of shards. The first ``base`` fill regions of two racks
    of four; each later one is a region of its own, so that the weights of all
    earlier subtrees stay and it takes rows only into itself."""
    leaves = []
    for n in range(min(shards, base)):
        leaves.append(Leaf(f"r{n // (RACK * REGION)}", f"k{n // RACK}", n))
    for n in range(base, shards):
        leaves.append(Leaf(f"x{n}", f"x{n}", n))
    return leaves


def _levels(leaves: Sequence[Leaf]) -> list[list]:
    """Children of each node, node 0 the root: ``[name, next node or shard, weight]``."""
    if not leaves or any(leaf.weight <= 0 for leaf in leaves):
        raise ValueError("a tree needs shards, and each a positive weight")
    nodes: list[list] = [[]]
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in leaves:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    for region, racks in regions.items():
        weight = sum(leaf.weight for rack in racks.values() for leaf in rack)
        nodes[0].append([f"{region}", len(nodes), weight])
        at = len(nodes)
        nodes.append([])
        for rack, shards in racks.items():
            nodes[at].append([f"{region}/{rack}", len(nodes), sum(s.weight for s in shards)])
            nodes.append([[f"{region}/{rack}/{s.shard}", s.shard, s.weight] for s in shards])
    return nodes


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of a key. All null keys share one shard."""
    nodes = [
        [{"name": name, "next": after, "weight": weight} for name, after, weight in children]
        for children in _levels(leaves)
    ]
    kind = "array<array<struct<name:string,next:int,weight:double>>>"
    literal = F.from_json(F.lit(json.dumps(nodes)), kind)

    def winner(node: Column) -> Column:
        def draw(child: Column) -> Column:
            # 53 bits of the hash as a number in (0, 1).
            bits = F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11)
            unit = (bits.cast("double") + 0.5) / float(1 << 53)
            return F.struct(
                (-F.ln(unit) / child["weight"]).alias("draw"), child["next"].alias("next")
            )

        return F.array_min(F.transform(F.get(literal, node), draw))["next"]

    return winner(winner(winner(F.lit(0))))


def assign(
    docs: DataFrame,
    leaves: Sequence[Leaf],
    grown: Sequence[Leaf],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, grown_shard)`` per row. ``size`` is the
    UTF-8 bytes of the text (null: none) plus 16. Rows of one id share a shard."""
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(key, leaves).alias("shard"),
        shard_of(key, grown).alias("grown_shard"),
    )


def with_slots(rows: DataFrame, total: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps (column ``slot``).

    A shard's rows are numbered in blocks of about ``BLOCK_ROWS`` rows of the whole
    table, dealt at random so that copies of one id spread as well; a block starts
    at the number of rows in the shard's blocks before it. Repeated rows get a slot
    each. ``total`` is the number of rows."""
    blocks = max(1, total // BLOCK_ROWS)
    rows = staged(rows.withColumn("_block", F.floor(F.rand(7) * blocks)))
    counts = rows.groupBy("shard", "_block").agg(F.count("*").alias("_rows"))
    before = (
        Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        "shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    order = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_place", F.row_number().over(order))
    return (
        numbered.join(starts, ["shard", "_block"])
        .withColumn("slot", F.col("_start") + F.col("_place") - 1)
        .drop("_start", "_place", "_block")
    )
