"""The trie of rebuilt conversations against plain loops."""

import hashlib
import random
import zlib

import pytest

from sparkrecon.llm import conversation_trie
from sparkrecon.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def order(row):
    role, text = row[2] or "", row[3] or ""
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return (row[1] is not None, row[1] or 0, digest[:32])


def plain(rows):
    own = {}
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            members.setdefault(tuple(built[:d]), []).append(c)
        ends.setdefault(tuple(built), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = leaves.get(node, 0) or 1
        if node:
            saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * len(node[-1][1].encode())
            children[node[:-1]] = children.get(node[:-1], 0) + 1
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), children.get(node, 0),
            leaves[node], saved.get(node, 0),
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS head", "'mine' AS depth")
    got = [tuple(r) for r in conversation_trie.trie(df).collect()]
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in got) == plain(rows)
    return got


@pytest.fixture
def small(monkeypatch):
    """Limits that make small tables use bursts and layers."""

    def put(block, most):
        monkeypatch.setattr(conversation_trie, "BLOCK", block)
        monkeypatch.setattr(conversation_trie, "MOST_TURNS", most)

    return put


def made(seed, convs, turns, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * convs), convs):
        for t in range(rng.randrange(1, turns)):
            text = rng.choice(["", "a", "é b", None, *(f"w{i}" for i in range(words))])
            rows.append((c, rng.choice([t, t, t, 0, None]), rng.choice(["user", "", None]), text))
    return rows


def test_odd_rows(spark):
    rows = [
        (5, None, "user", "first"), (5, 0, None, None), (5, 0, "", ""), (5, 1, "user", "é"),
        (6, 3, "user", "own"), (7, 1, "a", "b"), (7, 1, "a", "b"), (8, 1, "ab", ""), (9, 2, "", "ab"),
        (None, 1, "user", "nobody's"), (3, 1, "user", "no base"), (1003, 1, "user", "none either"),
    ]
    check(spark, rows)
    assert check(spark, []) == [] and check(spark, rows[9:10]) == []


@pytest.mark.parametrize(("block", "most"), [(1024, 1 << 17), (1024, 6), (3, 1 << 17), (2, 4)])
def test_random_conversations(spark, small, block, most):
    small(block, most)
    check(spark, made(block + most, 40, 14, 1))


def test_copies_and_shared_starts(spark, small):
    """Copies of one conversation, and long beginnings that many share, burst as chains."""
    small(16, 40)
    rows = []
    for c in range(0, 200, 5):
        for t in range(20):
            rows.append((c, t, "user", f"t{t}" if t < 18 or c < 100 else f"t{t} of {c}"))
    check(spark, rows)


def test_one_conversation_holds_most_rows(spark, small):
    small(32, 50)
    rows = [(10, i // 3, "user", f"x{i}") for i in range(700)]
    rows += [(11, i, "user", f"y{i}") for i in range(9)] + [(20, i // 3, "user", f"x{i}") for i in range(650)]
    check(spark, rows)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_conversation_trie"](spark, sf_dir).collect()]
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in got) == plain(rows)
