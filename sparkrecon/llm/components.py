"""Connected components of a table of links, by large and small stars.

Each step replaces a node's links by links to the least node it knows; paths
shorten by about half per pair of steps. Only minima are gathered per node, never
neighbour lists, and each step is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.common import staged

#: Pairs of steps after which something must be wrong (a path of n nodes needs about
#: log n).
MOST_STEPS = 60
#: Links up to which a step runs in one task without shuffles, at 16 bytes each.
SMALL_LINKS = 1_000_000


def _large_star(links: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of its neighbours and itself."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.select(F.inline(ways))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a != b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.array(
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))
    )
    return down.join(least, "a").select(F.inline(ends)).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``: the least node it
    is linked with over any path. Empty links give no rows."""
    links = staged(links.where("a != b").select("a", "b").distinct())
    small, before = links.count() <= SMALL_LINKS, None
    for _ in range(MOST_STEPS):
        # One partition needs no shuffle for any of a step's groups and joins.
        links = links.coalesce(1) if small else links
        links = staged(_small_star(_large_star(links)))
        state = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            ends = F.array(
                F.struct(F.col("a").alias("node"), F.col("b").alias("component")),
                F.struct(F.col("b").alias("node"), F.col("b").alias("component")),
            )
            return staged(links.select(F.inline(ends)).distinct())
        before = state
    raise RuntimeError("components did not settle")
