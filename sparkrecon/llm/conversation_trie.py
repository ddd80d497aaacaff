"""A prefix trie of conversations, built as a burst trie.

Conversations are rows of blocks of turn ids; equal blocks under one head are one
*suffix* with the numbers of its members. A container holds all suffixes under a trie
head, at first under the root. While a container holds too many turns it is burst: the
turns that all its suffixes share become a chain, and the next turn id leads each suffix
to a container of its own. What is left is sorted within shards and swept into nodes, a
suffix at a time. Sums of the containers then go up the heads, the last ones first.

A conversation of more than ``BLOCK`` turns goes on in a further layer of suffixes whose
heads are its first blocks; layers are built from the last to the first."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkrecon.llm.common import parts_for, staged
from sparkrecon.operators.skew import lookup_join

#: Turns of a block.
BLOCK = 1024
#: Turns above which a container of several suffixes is burst.
MOST_TURNS = 1 << 17
#: Bytes of a turn's id.
ID = 16
#: Turns of the shared beginning: less than this.
HEADS = 9
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
#: What a sweep gives: nodes, and for each container its top. Of a top ``n_children``,
#: ``n_leaves`` and ``saved_tokens`` tell what lies below it.
SWEPT = NODE + ", top boolean, container binary, parent binary, level int, size bigint"


# ------------------------------------------------------------------- conversations


def numbered(turns: DataFrame) -> DataFrame:
    """``(conv, place, id, size)``: turns in order, from 1, with the id of role and text.

    A conversation may fill many tasks: ids are dealt by ranges of conversation and
    turn, numbered in their task, and moved by the numbers of the tasks before."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    ids = staged(turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.substring(F.sha2(name.cast("binary"), 256), 1, 2 * ID).alias("id"),
        F.octet_length(text).cast("bigint").alias("size"),
    ))
    # Copies of one turn may stand in any order, so that they spread as well.
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("id"), F.col("copy")]
    dealt = ids.withColumn("copy", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts_for(turns, least=8), *order).sortWithinPartitions(*order)
    placed = staged(dealt.select(
        "conv", "id", "size", F.spark_partition_id().alias("task"),
        F.monotonically_increasing_id().alias("at"),
    ))
    starts = placed.groupBy("conv", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    joined = placed.join(starts, ["conv", "task"])
    place = F.col("at") - F.col("first") + F.col("before") + 1
    return joined.select("conv", place.alias("place"), "id", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, depth, id, size)`` of the rebuilt conversations, and ``(conv, length)``."""
    own = staged(numbered(turns))
    lengths = own.groupBy("conv").agg(F.count("*").alias("n"))
    base = F.col("conv") - F.col("conv") % 5
    convs = lengths.withColumn("base", base).withColumn(
        "h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    )
    bases = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = staged(convs.join(bases, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest"),
    ))
    # At most the first 8 turns of a conversation, for the 9 numbers that may have it as base.
    heads = own.where((F.col("conv") % 5 == 0) & (F.col("place") < HEADS))
    heads = heads.withColumnRenamed("conv", "base").join(convs, "base").where("place <= taken")
    tails = own.join(convs, "conv").where("place > h")
    rows = heads.select("conv", F.col("place").alias("depth"), "id", "size").unionByName(
        tails.select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "id", "size")
    )
    return rows, convs.select("conv", (F.col("taken") + F.col("rest")).alias("length"))


# ---------------------------------------------------------------------- suffixes


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``(key, conv)`` in order, the digest of each key's ids, as they pass."""
    key, sha = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for k, conv in zip(batch["key"].to_pylist(), batch["conv"].to_pylist(), strict=True):
            if k != key:
                if sha:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(str(conv).encode())
            else:
                sha.update(f",{conv}".encode())
        yield _columns(done, "key binary, digest string")
    if sha:
        yield _columns([(key, sha.hexdigest())], "key binary, digest string")


_KINDS = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(),
}


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.strip().split(" ") for f in schema.split(",")), strict=True)
    held = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    arrays = [pa.array(v, _KINDS[k]) for v, k in zip(held, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def _ends_of(entries: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``(key, ends)``: the digest of the members that end with a suffix. Ids of several
    members go in order past one task for each suffix, which keeps none of them: a digest
    can't be put together from parts."""
    several = suffixes.where("ended > 1").select("key")
    ids = entries.where("ends").join(several, "key", "left_semi").select("key", "conv")
    digests = ids.repartition("key").sortWithinPartitions("key", "conv").mapInArrow(
        _digests, "key binary, digest string"
    )
    return suffixes.join(digests, "key", "left").withColumn(
        "ends",
        F.when(F.col("ended") == 0, F.lit(EMPTY_SHA256))
        .when(F.col("ended") == 1, F.sha2(F.col("last").cast("string").cast("binary"), 256))
        .otherwise(F.col("digest")),
    ).drop("digest", "last", "ended")


def layer_of(rows: DataFrame, alive: DataFrame, layer: int) -> tuple[DataFrame, DataFrame]:
    """The entries ``(head, key, conv, ends)`` of a layer, a row for each conversation in
    ``alive`` (conv, length, head, over), and its suffixes, a row for each different one
    under its head. ``key`` digests the suffix with all before it."""
    inside = F.col("depth").between(layer * BLOCK + 1, (layer + 1) * BLOCK)
    held = rows.where(inside)
    if layer:
        held = held.join(alive.select("conv"), "conv", "left_semi")
    turns = F.array_sort(F.collect_list(F.struct("depth", "id", "size")))
    held = held.groupBy("conv").agg(turns.alias("turns")).select(
        "conv", F.unhex(F.array_join("turns.id", "")).alias("path"), F.col("turns.size").alias("sizes")
    )
    path = F.coalesce("path", F.unhex(F.lit("")))
    entries = staged(alive.join(held, "conv", "left").select(
        "head", F.unhex(F.sha2(F.concat("head", path), 256)).alias("key"), "conv", "over",
        (F.col("length") <= (layer + 1) * BLOCK).alias("ends"), path.alias("path"),
        F.coalesce("sizes", F.array().cast("array<bigint>")).alias("sizes"),
    ))
    suffixes = entries.groupBy("head", "key").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.min("over").alias("over"),
        F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes"),
        F.count_if("ends").alias("ended"), F.count_if(~F.col("ends")).alias("going"),
        F.min(F.when(F.col("ends"), F.col("conv"))).alias("last"),
    )
    return entries, staged(_ends_of(entries, staged(suffixes)))


# ---------------------------------------------------------------- bursting, sweeping


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of ids that the least and the greatest tail of a container, and so all its
    tails, begin with."""
    for batch in batches:
        found = []
        for key, a, b in zip(*(batch[c].to_pylist() for c in ("container", "least", "most")), strict=True):
            same = next((i for i in range(0, len(a), ID) if a[i : i + ID] != b[i : i + ID]), len(a))
            found.append((key, same // ID))
        yield _columns(found, "container binary, shared int")


def _tail() -> Column:
    return F.substring("path", F.col("skip") * ID + 1, F.lit(1 << 30))


def burst(suffixes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Suffixes in containers small enough to sweep, and the bursts of each level.

    A burst ``(container, parent, skip, shared, sizes, over)`` is a chain of ``shared``
    turns below the top; a suffix that ends with the chain is kept as a container
    without next turn (``whole``)."""
    current = suffixes.withColumns({
        "container": F.col("head"), "parent": F.lit(None).cast("binary"),
        "skip": F.lit(0), "whole": F.lit(False),
    })
    swept, levels = [], []
    length = (F.octet_length("path") / ID).cast("int")
    while True:
        weights = current.groupBy("container").agg(
            F.sum(length - F.col("skip") + 1).alias("weight"), F.count("*").alias("members")
        )
        large = weights.where((F.col("weight") > MOST_TURNS) & (F.col("members") > 1))
        large = staged(large.select("container"))
        level = F.lit(len(levels)).alias("level")
        if large.isEmpty():
            swept.append(current.withColumn("level", level))
            return reduce(DataFrame.unionByName, swept), levels
        marked = lookup_join(
            current, large.withColumn("large", F.lit(True)), ["container"], "left", ["key"]
        )
        swept.append(marked.where("large IS NULL").drop("large").withColumn("level", level))
        crowded = staged(marked.where("large").drop("large"))
        ends = crowded.groupBy("container").agg(
            F.min(_tail()).alias("least"), F.max(_tail()).alias("most"),
            F.min(F.struct("key", "parent", "skip", "sizes", "over", "head")).alias("one"),
        )
        ends = staged(ends)
        shared = ends.select("container", "least", "most").mapInArrow(
            _shared, "container binary, shared int"
        )
        bursts = staged(ends.join(shared, "container").select(
            "container", "one.parent", "one.skip", "shared", "one.over",
            F.slice("one.sizes", F.col("one.skip") + 1, F.col("shared")).alias("sizes"),
            F.when(F.col("one.skip") > 0, F.element_at("one.sizes", F.col("one.skip")))
            .otherwise(0).alias("size"),
        ))
        levels.append(bursts)
        moved = lookup_join(crowded, bursts.select("container", "shared"), ["container"], "inner", ["key"])
        at = F.col("skip") + F.col("shared")
        step = F.substring("path", at * ID + 1, F.lit(ID))
        moved = moved.select(
            *[c for c in current.columns if c not in ("container", "parent", "skip", "whole")],
            F.unhex(F.sha2(F.concat("container", step), 256)).alias("container"),
            F.col("container").alias("parent"),
            F.when(length > at, at + 1).otherwise(at).alias("skip"),
            (length == at).alias("whole"),
        )
        current = staged(moved)


@dataclass
class _Open:
    """A node whose suffixes are still coming."""

    depth: int
    size: int
    conv: int
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str = EMPTY_SHA256
    below: list[tuple] = field(default_factory=list)

    def close(self, over: int) -> list[tuple]:
        """The children's rows: only now the smallest member of their parent is known."""
        return [(*row[:2], over, *row[2:]) for row in self.below]

    def into(self, parent: _Open) -> list[tuple]:
        leaves, saved = self.leaves or 1, self.saved + (self.n - 1) * self.size
        parent.n += self.n
        parent.conv = min(parent.conv, self.conv)
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        parent.below.append(
            (self.conv, self.depth, self.n, self.children, leaves, saved, self.ends)
        )
        return self.close(self.conv)


def _sweeper(first_depth: int) -> Callable:
    """Sweep suffixes that come sorted by container and tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[_Open] = []
        held: dict | None = None
        before = b""

        def close_to(depth: int) -> None:
            while len(stack) > depth + 1:
                node = stack.pop()
                out.extend((*r, False, None, None, None, None) for r in node.into(stack[-1]))

        def finish() -> None:
            close_to(0)
            top = stack.pop()
            over = held["over"] if held["parent"] is None else top.conv
            out.extend((*r, False, None, None, None, None) for r in top.close(over))
            out.append((
                top.conv, top.depth, None, top.n, top.children, top.leaves, top.saved, top.ends,
                True, held["container"], held["parent"], held["level"], top.size,
            ))

        for batch in batches:
            for row in batch.to_pylist():
                path, sizes, skip = row["path"], row["sizes"], row["skip"]
                tail = path[skip * ID :]
                if held is None or row["container"] != held["container"]:
                    if held is not None:
                        finish()
                    size = sizes[skip - 1] if skip else 0
                    stack.append(_Open(first_depth + skip, size, row["conv"]))
                    held, before = row, b""
                top = min(len(before), len(tail))
                same = next(
                    (i for i in range(0, top, ID) if tail[i : i + ID] != before[i : i + ID]), top
                )
                close_to(same // ID)
                for d in range(same // ID, len(tail) // ID):
                    size = sizes[skip + d]
                    stack.append(_Open(first_depth + skip + d + 1, size, row["conv"]))
                last, before = stack[-1], tail
                last.n += row["n"]
                last.conv = min(last.conv, row["conv"])
                last.ends = row["ends"]
                last.children += row["b_children"]
                last.leaves += row["b_leaves"]
                last.saved += row["b_saved"]
            if out:
                yield _columns(out, SWEPT)
                out.clear()
        if held is not None:
            finish()
            yield _columns(out, SWEPT)

    return run


def _rolled(bursts: DataFrame, tops: DataFrame, first_depth: int) -> tuple[DataFrame, DataFrame]:
    """The nodes right below a level's bursts and on their chains, and the bursts' tops."""
    own = (F.col("n_convs") - 1) * F.col("size")
    whole = F.col("whole")
    sums = tops.groupBy("parent").agg(
        F.min("conv_id").alias("conv"), F.sum("n_convs").alias("n"),
        F.sum(F.when(whole, F.col("n_children")).otherwise(1)).alias("children"),
        F.sum(F.when(whole, F.col("n_leaves")).otherwise(F.greatest("n_leaves", F.lit(1)))).alias("leaves"),
        F.sum(F.col("saved_tokens") + F.when(whole, 0).otherwise(own)).alias("saved"),
        F.max(F.when(whole, F.col("ends_sha256"))).alias("ends"),
    )
    held = bursts.withColumnRenamed("parent", "above").join(
        sums.withColumnRenamed("parent", "container"), "container"
    )
    over = F.when(F.col("above").isNull(), F.col("over")).otherwise(F.col("conv"))
    held = staged(held.withColumn("over", over))
    ends = F.coalesce("ends", F.lit(EMPTY_SHA256))
    branch = F.when(F.col("shared") > 0, F.col("conv")).otherwise(F.col("over"))
    parents = held.select(F.col("container").alias("parent"), branch.alias("parent_conv_id"))
    children = tops.where(~whole).join(parents, "parent").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
        (F.col("saved_tokens") + own).alias("saved_tokens"), "ends_sha256",
    )

    def saved(place: Column) -> Column:
        """Of the chain from its turn ``place`` on."""
        rest = F.slice("sizes", place, F.col("shared") - place + 1)
        return F.col("saved") + (F.col("n") - 1) * F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, x: a + x)

    chain = held.where("shared > 0").withColumn("place", F.explode(F.sequence(F.lit(1), F.col("shared"))))
    end = F.col("place") == F.col("shared")
    chain = chain.select(
        F.col("conv").alias("conv_id"),
        (F.col("skip") + F.col("place") + first_depth).cast("bigint").alias("depth"),
        F.when(F.col("place") == 1, F.col("over")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(end, F.col("children")).otherwise(1).cast("bigint").alias("n_children"),
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), saved(F.col("place")).alias("saved_tokens"),
        F.when(end, ends).otherwise(EMPTY_SHA256).alias("ends_sha256"),
    )
    chained = F.col("shared") > 0
    up = held.select(
        F.col("conv").alias("conv_id"), (F.col("skip") + first_depth).cast("bigint").alias("depth"),
        F.col("n").alias("n_convs"),
        F.when(chained, 1).otherwise(F.col("children")).cast("bigint").alias("n_children"),
        F.when(chained, F.greatest("leaves", F.lit(1))).otherwise(F.col("leaves")).alias("n_leaves"),
        F.when(chained, saved(F.lit(1))).otherwise(F.col("saved")).alias("saved_tokens"),
        F.when(chained, EMPTY_SHA256).otherwise(ends).alias("ends_sha256"),
        "container", F.col("above").alias("parent"), "size", F.lit(False).alias("whole"),
    )
    return children.unionByName(chain), up


def sweep_layer(suffixes: DataFrame, layer: int) -> tuple[list[DataFrame], DataFrame]:
    """All nodes below the heads of a layer, and the heads themselves as tops."""
    first_depth = layer * BLOCK
    held, levels = burst(suffixes)
    ordered = held.repartition("container").sortWithinPartitions("container", "path")
    columns = [
        "container", "parent", "level", "skip", "whole", "over", "path", "sizes", "conv", "n", "ends",
        "b_children", "b_leaves", "b_saved",
    ]
    # A suffix that ends with a burst's chain is a container of its own, without turns.
    swept = staged(ordered.select(columns).mapInArrow(_sweeper(first_depth), SWEPT))
    names = [f.strip().split(" ")[0] for f in NODE.split(",")]
    nodes = [swept.where("NOT top").select(names)]
    tops = swept.where("top").drop("top", "parent_conv_id")
    wholes = held.where("whole").select("container", F.lit(True).alias("whole")).distinct()
    tops = staged(tops.join(wholes, "container", "left").withColumn("whole", F.coalesce("whole", F.lit(False))))
    up = None
    for level in range(len(levels) - 1, -1, -1):
        below = tops.where(F.col("level") == level + 1).drop("level")
        found, up = _rolled(levels[level], below if up is None else below.unionByName(up), first_depth)
        nodes.append(found)
    heads = tops.where("level = 0").drop("level")
    return nodes, heads if up is None else heads.unionByName(up)


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    A conversation's turns stand in order of ``turn``, null first; turns of one number
    (and repeated rows, which are turns of their own) in order of a digest of role and
    text. Null roles and texts are empty texts. Rows without ``conv_id`` belong to no
    conversation. Ids below zero take their base towards zero. Without conversations
    there are no nodes, else at least the root; further columns are not read. The ids of
    all members that end in one node pass through one task, in order, since their digest
    can't be put together from parts."""
    rows, lengths = map(staged, rebuilt(turns))
    root = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    least = lengths.agg(F.min("conv")).first()[0]
    alive = lengths.select("conv", "length", root.alias("head"), F.lit(least).cast("bigint").alias("over"))
    layers, lone = [], []
    while True:
        entries, suffixes = layer_of(rows, alive, len(layers))
        layers.append(suffixes)
        going = entries.where("NOT ends").select("key", "conv").join(
            suffixes.where("going > 0").select("key", F.col("conv").alias("over"), "going"), "key"
        )
        going = staged(going)
        lone.append(going.where("going = 1").select(
            "conv", "over", F.lit(len(layers) * BLOCK).cast("bigint").alias("from")
        ))
        alive = going.where("going > 1").join(lengths, "conv")
        alive = alive.select("conv", "length", F.col("key").alias("head"), "over")
        if alive.isEmpty():
            break
    nodes = [_alone(rows, lengths, reduce(DataFrame.union, lone))]
    heads = None
    for layer in range(len(layers) - 1, -1, -1):
        one = F.col("going") == 1
        below = layers[layer]
        if heads is None:
            below = below.withColumns({c: F.lit(None).cast("bigint") for c in ("hc", "hl", "hs")})
        else:
            found = heads.select(
                F.col("container").alias("key"), F.col("n_children").alias("hc"),
                F.col("n_leaves").alias("hl"), F.col("saved_tokens").alias("hs"),
            )
            below = below.join(found, "key", "left")
        below = below.withColumns({
            "b_children": F.when(one, 1).otherwise(F.coalesce("hc", F.lit(0))).cast("bigint"),
            "b_leaves": F.when(one, 1).otherwise(F.coalesce("hl", F.lit(0))).cast("bigint"),
            "b_saved": F.coalesce("hs", F.lit(0)).cast("bigint"),
        }).drop("hc", "hl", "hs", "going")
        found, heads = sweep_layer(staged(below), layer)
        nodes += found
        heads = staged(heads)
    top = heads.select(
        "conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs",
        "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", "ends_sha256",
    )
    return reduce(DataFrame.unionByName, [*nodes, top])


def _alone(rows: DataFrame, lengths: DataFrame, lone: DataFrame) -> DataFrame:
    """Nodes of one member only, beyond the blocks it shares: a node for each turn."""
    held = lone.join(lengths, "conv").withColumnRenamed("from", "shared")
    found = rows.join(held, "conv").where("depth > shared")
    last = F.col("depth") == F.col("length")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return found.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"),
        F.when(F.col("depth") == F.col("shared") + 1, F.col("over")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256))
        .otherwise(EMPTY_SHA256).alias("ends_sha256"),
    )
