"""Exact k-means with bounds against plain loops."""

import hashlib

import numpy as np
import pytest

from sparkrecon.llm import ns_kmeans

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, vectors string"


def plain(rows, k, rounds, size):
    """``{(vec_id, vector): (cluster, distance)}``, the centroids of all rounds."""
    held = [(i, tuple(int(np.floor(x * 256)) for x in v)) for i, v in rows]
    order = sorted(
        held, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    )
    centroids = [list(v) for _, v in order[:k]]
    history = [centroids]
    for t in range(rounds + 1):
        found = []
        for _, v in held:
            apart = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            found.append((apart.index(min(apart)), min(apart)))
        if t < rounds:
            centroids = [
                [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c
                for j, c in enumerate(centroids)
                for mine in [[v for (_, v), f in zip(held, found, strict=True) if f[0] == j]]
            ]
            history.append(centroids)
    return [(i, v, *f) for (i, v), f in zip(held, found, strict=True)], history


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "mine", "mine") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("k", [1, 5, 12])
def test_rows_and_centroids(spark, k):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 4))
    rows = [
        (i, [float(x) for x in centres[i % 6] + rng.normal(scale=0.3, size=4)]) for i in range(400)
    ]
    rows += [(7, rows[7][1])] * 3 + [(None, rows[9][1]), (900, [0.0] * 4), (901, [0.0] * 4)]
    found = ns_kmeans.cluster(frame(spark, rows).repartition(3), k, 4, size=4)
    want, history = plain(rows, k, 4, 4)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.rows.collect())
    assert got == sorted((i is None, i or 0, j, d) for i, _, j, d in want)
    assert found.history.tolist() == history
    whole = sum(d for *_, d in want)
    for r in found.rows.collect():
        assert r.inertia == whole
        assert r.cluster_inertia == sum(d for *_, j, d in want if j == r.cluster)
        text = ",".join(map(str, history[-1][r.cluster]))
        assert r.centroid_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 3
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(scale=0.1, size=8)]) for i in range(2000)]
    found = ns_kmeans.cluster(frame(spark, rows), 20, 5, size=8)
    assert found.evaluated[0] == 2000 * 20
    assert found.evaluated[-1] < 2000 * 20 / 10


def test_norm_of_the_sum_not_sum_of_norms():
    """A centroid that goes and comes back leaves all bounds as they were."""
    vectors = np.array([[0, 0], [10, 0], [101, 0]], np.int32)
    start = np.array([[0, 0], [100, 0]])
    block = ns_kmeans.first_round(vectors, start)
    block.evaluated = 0
    history = np.array([start, start + [0, 40], start])
    ns_kmeans.next_round(block, history)
    assert block.evaluated == 0 and block.owner.tolist() == [0, 0, 1]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.5]), (2, [0.501, -0.5]), (3, [-0.001, 9.0]), (3, [-0.001, 9.0])]
    bad = [(4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [1.0, -inf])]
    large = [(10, [1e30, 0.0]), (11, [0.0, -(2.0**19) - 1])]
    found = ns_kmeans.cluster(frame(spark, good + bad + large), 9, 3, size=2)
    got = sorted(found.rows.collect(), key=lambda r: r.vec_id)
    assert [(r.vec_id, r.distance) for r in got] == [(1, 0), (2, 0), (3, 0), (3, 0), (10, None), (11, None)]
    assert all(r.cluster is None and r.centroid_sha256 is None for r in got if r.vec_id >= 10)
    assert got[2].cluster == got[3].cluster and found.history.shape == (4, 4, 2)


def test_largest_integers_are_exact(spark):
    rows = [(i, [s * 2.0**19, s * (2.0**19 - i)]) for i in range(6) for s in (1, -1)]
    found = ns_kmeans.cluster(frame(spark, rows), 3, 2, size=2)
    want, _ = plain(rows, 3, 2, 2)
    got = sorted((r.vec_id, r.cluster, r.distance) for r in found.rows.collect())
    assert got == sorted((i, j, d) for i, _, j, d in want)


def test_empty(spark):
    found = ns_kmeans.cluster(frame(spark, []), 3, 2, size=2)
    assert found.rows.collect() == [] and found.rows.columns[0] == "vec_id"
