"""SimHash links by generalised pigeonhole against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkrecon.llm import simhash
from sparkrecon.llm.queries import QUERIES

from .conftest import EDGE


def plain_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    lines = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in lines]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, reach):
    """The place of the first reachable fingerprint, for each."""
    fps = np.array(prints, np.uint64)
    label = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= reach)
        old = np.unique(label[near])
        label[np.isin(label, old)] = old.min()
    return label


def check(spark, rows, reach=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine"))
    prints = [plain_print(t) for _, t in rows]
    label = plain_components(prints, reach)
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    got = sorted(map(tuple, simhash.near_duplicates(docs, reach).collect()), key=key)
    want = [(i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, prints, label, strict=True)]
    assert got == sorted(want, key=key)
    return got


def test_edge_rows(spark):
    check(spark, EDGE)
    assert check(spark, []) == []
    assert check(spark, [(None, None), (None, "  ")]) == [(None, "0" * 16, None)] * 2


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(3000)) + "\n\t  x" + "y" * 500
    want = plain_print(text)
    for chunk in (1, 7, 100, 10_000):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert simhash.fingerprint(text.encode()) == want


def test_edited_texts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(400)]
        for _ in range(12):
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
            words[rng.randrange(400)] = "edit"
    got = check(spark, rows)
    assert 12 <= len({r[2] for r in got}) < 100


@pytest.mark.parametrize(("reach", "n"), [(1, 300), (3, 600), (4, 1500), (6, 400)])
def test_linked_fingerprints(spark, reach, n):
    """Chains and crowds of fingerprints, some bits always equal, some always together."""
    rng = np.random.default_rng(reach)
    bits = rng.random((n, 64)) < 0.5
    bits[:, 5:12], bits[:, 20:30] = False, bits[:, 19:20]
    fps = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    near = fps[rng.integers(0, 20, n)].copy()
    for _ in range(reach + 2):
        near ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    prints = np.unique(np.concatenate([fps, near, fps[:1] ^ np.arange(64).astype(np.uint64)]))
    df = spark.createDataFrame([(int(x), 1) for x in prints.view(np.int64)], "fp long, n long")
    got = {r.fp: r.comp for r in simhash.link_components(df, reach).collect()}
    label = plain_components(prints, reach)
    signed = prints.view(np.int64).tolist()
    least = {}
    for x, c in zip(signed, label, strict=True):
        least[c] = min(x, least.get(c, x))
    assert got == {x: least[c] for x, c in zip(signed, label, strict=True)}


def test_one_crowd(spark):
    """Many fingerprints around one, most further from each other than the limit."""
    rng = np.random.default_rng(0)
    fps = np.full(3000, rng.integers(1 << 63), np.uint64)
    for _ in range(4):
        fps ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    fps = np.unique(fps)
    df = spark.createDataFrame([(int(x), 1) for x in fps.view(np.int64)], "fp long, n long")
    plan = simhash.make_plan(df, len(fps), 4)
    pivots = simhash.pivot_links(df, plan).count()
    assert 0 < pivots < 10 * len(fps)
    comps = {r.comp for r in simhash.link_components(df, 4).collect()}
    assert len(comps) == len(set(plain_components(fps, 4)))


def test_limits_cost_least_and_suffice():
    rng = np.random.default_rng(1)
    costs = [np.hstack([np.zeros((50, 1)), rng.random((50, 5)).cumsum(axis=1)]) for _ in range(3)]
    got = simhash.choose_limits(costs, 4)
    assert (got.sum(axis=1) == 5).all()
    for row in range(50):
        ways = [(a, b, 5 - a - b) for a in range(6) for b in range(6 - a)]
        least = min(sum(c[row, u] for c, u in zip(costs, w, strict=True)) for w in ways)
        assert np.isclose(sum(c[row, u] for c, u in zip(costs, got[row], strict=True)), least)


def test_expected_counts_are_exact_within_the_table():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 256, 500)
    near = simhash.expected(np.bincount(values, minlength=256), 8, 3)
    for t in range(4):
        for v in (0, 17, 255):
            assert near[t, v] == (np.bitwise_count(values ^ v) <= t).sum()


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(4)
    bits = rng.random((4000, 64)) < 0.5
    bits[:, 40:50] = bits[:, 3:4]
    together = bits.T.astype(np.int64) @ bits.astype(np.int64)
    parts = simhash.group_bits(together, 4000, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any({3, *range(40, 50)} <= set(p) for p in parts)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = [plain_print(t) for _, t in rows]
    least = {}
    label = plain_components(prints, 4)
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(i, least.get(c, i))
    want = [(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, prints, label, strict=True)]
    assert sorted(map(tuple, QUERIES["op12_simhash"](spark, sf_dir).collect())) == sorted(want)
