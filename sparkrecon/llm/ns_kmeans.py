"""Exact k-means on integer vectors, spared most distances by ns-bounds.

All centroids of all rounds are kept. For every vector and centroid a block of vectors
remembers the last distance evaluated and its round. The distance now lies no further
from that one than the centroid's total displacement since then: the norm of one
difference of two remembered centroids, which is never more than the sum of the drifts
of the single rounds. Only where such bounds can't tell the nearest centroid is the
vector rescanned, in integers, against the centroids in question.

A round is one pass over the blocks, which hold vectors, bounds and sums; nothing is
shuffled but the sums of each task. What a round writes replaces what it has read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.common import dropped, shared_folder, staged

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Vectors of a block.
BLOCK = 4096
#: Size of an integer component up to which every squared distance fits a long.
LARGEST = 1 << 27

STATE = (
    "ids array<bigint>, vectors binary, owner binary, known binary, seen binary,"
    " sums array<bigint>, evaluated bigint"
)
ROWS = (
    "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint,"
    " centroid_sha256 string"
)


@dataclass
class Block:
    """Vectors (n, size) with their centroid, and for each of k centroids the last known
    distance, rounded down, and the round in which it was evaluated."""

    vectors: np.ndarray
    owner: np.ndarray
    known: np.ndarray
    seen: np.ndarray
    evaluated: int = 0

    def put(self, rows: np.ndarray, j: np.ndarray | int, squares: np.ndarray, t: int) -> None:
        near = np.sqrt(squares.astype(np.float64)).astype(np.float32)
        self.known[rows, j] = np.maximum(np.nextafter(near, np.float32(-np.inf)), 0)
        self.seen[rows, j] = t
        self.evaluated += len(squares)


def _squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", apart, apart)


def _above(known: np.ndarray) -> np.ndarray:
    """A number that the distance rounded down to ``known`` doesn't exceed."""
    far = np.float32(np.inf)
    return np.nextafter(np.nextafter(known, far), far).astype(np.float64)


def first_round(vectors: np.ndarray, centroids: np.ndarray) -> Block:
    """All distances; of equal ones the smaller number wins."""
    n, k = len(vectors), len(centroids)
    block = Block(vectors, np.zeros(n, np.uint16), np.zeros((n, k), np.float32), np.zeros((n, k), np.uint8))
    best = np.full(n, np.iinfo(np.int64).max)
    for j in range(k):
        squares = _squares(vectors, centroids[j])
        block.put(np.arange(n), j, squares, 0)
        closer = squares < best
        best[closer], block.owner[closer] = squares[closer], j
    return block


def next_round(block: Block, history: np.ndarray) -> None:
    """Find the nearest of the centroids ``history[-1]``, in place."""
    t, k = len(history) - 1, history.shape[1]
    moved = (history - history[t]).astype(np.float64)
    moved = np.sqrt(np.einsum("tkd,tkd->tk", moved, moved)) * (1 + 1e-9)
    rows, vectors = np.arange(len(block.owner)), block.vectors
    least = block.known - moved[block.seen, np.arange(k)]
    own = block.owner.astype(np.int64)
    most = _above(block.known[rows, own]) + moved[block.seen[rows, own], own]
    least[rows, own] = np.inf
    failed = np.flatnonzero(least.min(axis=1, initial=np.inf) <= most * (1 + 1e-9))
    if not len(failed):
        return
    own = own[failed]
    best = _squares(vectors[failed], history[t][own])
    block.put(failed, own, best, t)
    most = _above(block.known[failed, own]) * (1 + 1e-9)
    open_ = least[failed] <= most[:, None]
    for j in range(k):
        at = np.flatnonzero(open_[:, j])
        if len(at):
            squares = _squares(vectors[failed[at]], history[t][j])
            block.put(failed[at], j, squares, t)
            wins = (squares < best[at]) | ((squares == best[at]) & (j < own[at]))
            best[at[wins]], own[at[wins]] = squares[wins], j
    block.owner[failed] = own


def _sums(block: Block, centroids: np.ndarray) -> np.ndarray:
    """Per centroid the sums of components, the number and the summed squared distances
    of its vectors, in one row of ``k * (size + 2)`` numbers."""
    size = centroids.shape[1]
    found = np.zeros((len(centroids), size + 2), np.int64)
    squares = _squares(block.vectors, centroids[block.owner])
    for j in np.unique(block.owner):
        mine = block.owner == j
        found[j, :size] = block.vectors[mine].sum(axis=0, dtype=np.int64)
        found[j, size:] = mine.sum(), squares[mine].sum()
    return found.ravel()


def _packed(ids: pa.Array, block: Block, centroids: np.ndarray) -> pa.RecordBatch:
    one = {
        "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
        "vectors": pa.array([block.vectors.astype("<i4").tobytes()]),
        "owner": pa.array([block.owner.astype("<u2").tobytes()]),
        "known": pa.array([block.known.astype("<f4").tobytes()]),
        "seen": pa.array([block.seen.tobytes()]),
        "sums": pa.array([_sums(block, centroids)], pa.list_(pa.int64())),
        "evaluated": pa.array([block.evaluated], pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(one.values()), list(one))


def _unpacked(batch: pa.RecordBatch, i: int, k: int, size: int) -> tuple[pa.Array, Block]:
    def read(name: str, kind: str, *shape: int) -> np.ndarray:
        return np.frombuffer(batch[name][i].as_py(), kind).reshape(shape).copy()

    block = Block(
        read("vectors", "<i4", -1, size), read("owner", "<u2", -1),
        read("known", "<f4", -1, k), read("seen", "u1", -1, k),
    )
    return batch["ids"][i].values, block


def _start(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = part["vector"].flatten().to_numpy(zero_copy_only=False)
                vectors = np.floor(values.astype(np.float64) * SCALE).astype(np.int32)
                block = first_round(vectors.reshape(part.num_rows, -1), centroids)
                yield _packed(part["vec_id"], block, centroids)

    return run


def _step(history: np.ndarray):
    _, k, size = history.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, block = _unpacked(batch, i, k, size)
                next_round(block, history)
                yield _packed(ids, block, history[-1])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all blocks of a task as ``(place, n)``."""
    total: np.ndarray | None = None
    for batch in batches:
        for row in batch["sums"]:
            values = row.values.to_numpy()
            total = values if total is None else total + values
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], ["place", "n"]
        )


def _totals(state: DataFrame, k: int, size: int) -> np.ndarray:
    """``(k, size + 2)`` Python integers: as many numbers whatever the input."""
    parts = state.select("sums").mapInArrow(_added, "place bigint, n bigint")
    rows = parts.groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    found = np.zeros(k * (size + 2), object)
    for r in rows:
        found[r["place"]] = int(r["n"])
    return found.reshape(k, size + 2)


def _listed(history: np.ndarray, totals: np.ndarray):
    _, k, size = history.shape
    centroids = history[-1]
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = [int(n) for n in totals[:, size + 1]]
    whole = sum(inertia)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, block = _unpacked(batch, i, k, size)
                squares = _squares(block.vectors, centroids[block.owner])
                own = block.owner.tolist()
                columns = {
                    "vec_id": ids,
                    "cluster": pa.array(block.owner.astype(np.int32)),
                    "distance": pa.array(squares),
                    "cluster_inertia": pa.array([inertia[j] for j in own], pa.int64()),
                    "inertia": pa.array([whole] * len(own), pa.int64()),
                    "centroid_sha256": pa.array([names[j] for j in own], pa.string()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _usable(vector: Column, size: int) -> tuple[Column, Column]:
    """Whether a vector takes part, and whether its integers are small enough."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    kept = F.coalesce((F.size(vector) == size) & finite, F.lit(False))
    return kept, F.forall(vector, lambda x: F.abs(x) * SCALE <= LARGEST)


@dataclass
class Clusters:
    """``rows`` as the query returns them, the centroids of all rounds, and the number
    of distances evaluated in each."""

    rows: DataFrame
    history: np.ndarray
    evaluated: list[int]


def cluster(
    vectors: DataFrame,
    k: int,
    rounds: int,
    size: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    salt: str = "2:",
) -> Clusters:
    """Lloyd's rounds on ``floor(256 * x)``, exactly, then one more assignment.

    The first centroids are the ``k`` vectors (all, if fewer) whose ``sha256(salt + id)``
    is smallest; rows of one id are ordered by their components, rows without id come
    last. Vectors that are null, of another length, or hold a null or a number that is
    not finite are left out; an empty table gives no rows. Repeated rows count as often
    as they stand there, and further columns are not read. A vector with an integer
    above 2**27 in size, whose distances would not fit a long, is returned with a null
    cluster and moves no centroid. There may be 255 rounds at most."""
    vector = F.col(vector_col).cast("array<double>")
    named = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector"))
    kept, small = _usable(F.col("vector"), size)
    named = named.where(kept)
    usable = named.where(small)
    rank = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = usable.orderBy(rank.asc_nulls_last(), "vector").limit(k).collect()
    large = named.where(~small).select("vec_id", *[
        F.lit(None).cast(kind).alias(name)
        for name, kind in (field.split(" ") for field in ROWS.split(", ")[1:])
    ])
    if not first:
        return Clusters(large, np.zeros((1, 0, size), np.int64), [])
    start = np.array([np.floor(np.array(r["vector"]) * SCALE) for r in first]).astype(np.int64)
    history, k, evaluated = start[None], len(start), []
    spark = vectors.sparkSession
    path = shared_folder(spark)
    state = staged(usable.mapInArrow(_start(start), STATE), path=path)
    for t in range(rounds + 1):
        if t:
            old, path = path, shared_folder(spark)
            state = staged(state.mapInArrow(_step(history), STATE), path=path)
            dropped(spark, old)
        evaluated.append(state.agg(F.sum("evaluated")).first()[0])
        totals = _totals(state, k, size)
        if t < rounds:
            now = history[-1].copy()
            for j, row in enumerate(totals):
                if row[size]:
                    now[j] = [int(s) // int(row[size]) for s in row[:size]]
            history = np.concatenate([history, now[None]])
    rows = state.mapInArrow(_listed(history, totals), ROWS)
    return Clusters(rows.unionByName(large), history, evaluated)
