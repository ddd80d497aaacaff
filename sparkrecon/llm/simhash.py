"""Near duplicates by SimHash: fingerprints within a Hamming distance, by the
generalised pigeonhole principle.

Bits that go together are put into one of ``m`` parts. If a fingerprint may differ in
``t`` bits, and its parts get limits ``t1 .. tm`` (-1: the part is not looked up) whose
sum is ``t - m + 1``, then any partner differs in at most ``ti`` bits in some part ``i``:
else it would differ in ``t1 + 1 + ... + tm + 1 = t + 1`` bits. So each fingerprint
chooses its own limits: a dynamic program over the parts takes those that cost least by
the number of values to probe and of candidates to expect there, from counts of part
values over all fingerprints. Probes meet the fingerprints filed under their parts'
values, and all candidates are verified.

What is wanted are connected components, so links inside a component already known are
not looked for. Crowded values are first thinned by pivots: their members within reach
of the commonest one are joined to it. After that probes and fingerprints travel in
blocks, blocks of one large component skip each other, and a pair of blocks gives no
more links than it has members."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.common import staged
from sparkrecon.llm.components import components

BITS = 64
WORDS = 4
SEED = 42
#: Bytes of a text that are hashed at once (up to the next blank).
CHUNK = 1 << 20
#: Bits of a part whose values are counted; the other bits are taken as random.
TABLE_BITS = 14
#: What verifying a candidate costs, of what a probe costs.
CHECK_COST = 0.2
#: Fingerprints of a block, about.
BLOCK = 512
#: A value is crowded from so many fingerprints, if that is also so many times the mean.
CROWD, CROWD_MEANS = 64, 16
#: Rounds of pivots; what they leave is left to the probes.
PIVOT_ROUNDS = 3
#: Probes sent out at once by a task.
PROBES = 1 << 19

_BLANKS = b" \t\n\x0b\x0c\r"


# --------------------------------------------------------------------- fingerprints


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end] not in _BLANKS:
            end += 1
        yield text[at:end]
        at = end


def _hashes(text: bytes) -> Iterator[list[int]]:
    """Hashes of the shingles of a text, repeats included."""
    last: list[bytes] = []
    digest, any_whole = xxhash.xxh64_intdigest, False
    for piece in _pieces(text):
        words = last + piece.lower().split()
        if len(words) >= WORDS:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-WORDS]]).tolist()
            stops = (ends[WORDS - 1 :] - 1).tolist()
            yield [digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
            any_whole, words = True, words[-(WORDS - 1) :]
        last = words
    if last and not any_whole:
        yield [digest(b" ".join(last), SEED)]


def fingerprint(text: bytes) -> int:
    """64 bits, each set if it is set in more than half of the hashes; 0 without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in _hashes(text):
        eight = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(eight, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        found = np.fromiter(
            (fingerprint(t.as_py() or b"") for t in texts), np.uint64, batch.num_rows
        )
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` per row, ``fp`` as a signed long. Null and empty texts and those
    without words have 0; further columns are not read."""
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(_fingerprinted, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- parts and limits


def part_count(n: int, reach: int) -> int:
    """The number of equal parts that costs least for ``n`` random fingerprints."""

    def cost(m: int) -> float:
        width, (limit, more) = BITS / m, divmod(reach + 1, m)
        balls = [sum(math.comb(int(width), i) for i in range(limit + (p < more))) for p in range(m)]
        return sum(balls) * (1 + CHECK_COST * n / 2**width)

    return min(range(1 if reach == 0 else 2, reach + 2), key=cost)


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits in ``m`` parts, each bit put where it correlates most with those before.

    ``together[i, j]`` is the number of the ``n`` fingerprints with bits i and j."""
    share = together / max(n, 1)
    mean = np.diag(share)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    likeness = np.abs((share - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(likeness, 0)
    left, parts = set(range(BITS)), []
    for p in range(m):
        rest = sorted(left)
        part = [rest[int(likeness[np.ix_(rest, rest)].sum(axis=1).argmax())]]
        left.discard(part[0])
        while len(part) < (BITS + p) // m and left:
            rest = sorted(left)
            part.append(rest[int(likeness[np.ix_(rest, part)].sum(axis=1).argmax())])
            left.discard(part[-1])
        parts.append(part)
    return parts


def values_of(fps: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part as a number, its first bit lowest."""
    found = np.zeros(len(fps), np.int64)
    for place, bit in enumerate(part):
        found |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << place
    return found


def expected(counts: np.ndarray, width: int, reach: int) -> np.ndarray:
    """``[t, v]``: how many fingerprints to expect within ``t`` bits of the value whose
    low bits are ``v``, from the ``counts`` of all low bits."""
    low = int(len(counts)).bit_length() - 1
    exact = [counts.astype(np.float64)] + [np.zeros(len(counts)) for _ in range(reach)]
    place = np.arange(len(counts))
    for bit in range(low):
        other = place ^ (1 << bit)
        exact = [exact[0], *(exact[s] + exact[s - 1][other] for s in range(1, reach + 1))]
    rest = width - low
    found = [
        sum(exact[s] * math.comb(rest, t - s) for s in range(t + 1)) / 2.0**rest
        for t in range(reach + 1)
    ]
    return np.cumsum(found, axis=0)


def choose_limits(costs: list[np.ndarray], reach: int) -> np.ndarray:
    """``(n, m)`` numbers ``ti + 1``, which add up to ``reach + 1``, of least cost.

    ``costs[i][:, u]`` is what part ``i`` costs with the limit ``u - 1``."""
    n, whole = len(costs[0]), reach + 1
    best = np.full((n, whole + 1), np.inf)
    best[:, 0] = 0
    taken = []
    for cost in costs:
        ways = np.full((n, whole + 1, whole + 1), np.inf)  # sum, own share
        for u in range(whole + 1):
            ways[:, u:, u] = best[:, : whole + 1 - u] + cost[:, u, None]
        taken.append(ways.argmin(axis=2))
        best = ways.min(axis=2)
    left, found = np.full(n, whole), np.zeros((n, len(costs)), np.int64)
    for i in range(len(costs) - 1, -1, -1):
        found[:, i] = taken[i][np.arange(n), left]
        left -= found[:, i]
    return found


@dataclass
class Plan:
    """The parts, and what is to be expected near their values."""

    parts: list[list[int]]
    reach: int
    near: list[np.ndarray]
    crowd: float

    def low(self, i: int, values: np.ndarray) -> np.ndarray:
        return values & (self.near[i].shape[1] - 1)

    def flips(self, i: int, limit: int) -> np.ndarray:
        """All differences of up to ``limit`` bits in a part."""
        found = level = np.zeros(1, np.int64)
        for _ in range(limit):
            more = (level[:, None] ^ (1 << np.arange(len(self.parts[i]), dtype=np.int64))).ravel()
            level = np.setdiff1d(more, found)
            found = np.concatenate([found, level])
        return found

    def limits(self, values: list[np.ndarray]) -> np.ndarray:
        costs = []
        for i, part in enumerate(self.parts):
            near = self.near[i][:, self.low(i, values[i])].T
            probes = np.cumsum([math.comb(len(part), t) for t in range(self.reach + 1)])
            costs.append(np.hstack([np.zeros((len(near), 1)), probes + CHECK_COST * near]))
        return choose_limits(costs, self.reach)

    def keys(self, i: int, values: np.ndarray) -> np.ndarray:
        return (np.int64(i) << 32) | values


def _counts(prints: DataFrame, measure, size: int) -> np.ndarray:
    """Sums over all tasks of the arrays (of ``size`` numbers) that ``measure`` makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += measure(batch["fp"].to_numpy().view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    rows = prints.select("fp").mapInArrow(run, "place bigint, n bigint")
    table = rows.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(size, np.int64)
    found[table["place"].to_numpy()] = table["n"].to_numpy()
    return found


def _bits(fps: np.ndarray) -> np.ndarray:
    eight = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(eight, axis=1, bitorder="little")


def _together(fps: np.ndarray) -> np.ndarray:
    bits = _bits(fps).astype(np.float32)  # exact below 2**24 rows of a batch
    return (bits.T @ bits).astype(np.int64).ravel()


def make_plan(prints: DataFrame, n: int, reach: int) -> Plan:
    """Parts and estimates from all fingerprints: 4096 counts of pairs of bits, then
    at most ``2**TABLE_BITS`` counts a part, whatever their number."""
    m = part_count(n, reach)
    parts = group_bits(_counts(prints, _together, BITS * BITS).reshape(BITS, BITS), n, m)
    lows = [1 << min(TABLE_BITS, len(part)) for part in parts]
    starts = np.concatenate([[0], np.cumsum(lows)])

    def low_values(fps: np.ndarray) -> np.ndarray:
        return np.concatenate([
            np.bincount(values_of(fps, part) & (low - 1), minlength=low)
            for part, low in zip(parts, lows, strict=True)
        ])

    counts = _counts(prints, low_values, int(starts[-1]))
    near = [
        expected(counts[starts[i] : starts[i + 1]], len(part), reach)
        for i, part in enumerate(parts)
    ]
    return Plan(parts, reach, near, max(CROWD, CROWD_MEANS * n / min(lows)))


# --------------------------------------------------------------------------- links


def _crowded(plan: Plan):
    """``(key, fp, n)`` for the parts in which a fingerprint has a crowded value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, n = batch["fp"].to_numpy(), batch["n"].to_numpy()
            for i, part in enumerate(plan.parts):
                values = values_of(fps.view(np.uint64), part)
                many = plan.near[i][0][plan.low(i, values)] * 2.0 ** max(0, len(part) - TABLE_BITS)
                at = np.flatnonzero(many >= plan.crowd)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (plan.keys(i, values[at]), fps[at], n[at])],
                    ["key", "fp", "n"],
                )

    return run


def pivot_links(prints: DataFrame, plan: Plan) -> DataFrame:
    """Links ``(a, b)`` of members of crowded values to the commonest member within
    reach; those out of reach choose again among themselves."""
    rest = staged(prints.mapInArrow(_crowded(plan), "key bigint, fp bigint, n bigint"))
    found = []
    for _ in range(PIVOT_ROUNDS):
        best = rest.groupBy("key").agg(
            F.max(F.struct("n", "fp")).alias("best"), F.count("*").alias("members")
        )
        best = best.where(F.col("members") >= 2).select("key", F.col("best.fp").alias("pivot"))
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= plan.reach
        met = staged(rest.join(best, "key").select("key", "fp", "n", "pivot", near.alias("near")))
        found.append(met.where("near AND fp != pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
        rest = met.where("NOT near").select("key", "fp", "n")
        if rest.isEmpty():
            break
    return reduce(DataFrame.union, found).distinct()


def _blocked(plan: Plan, probing: bool):
    """``(key, block, fp, comp, large)``: where a fingerprint is filed, or what it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PROBES // 32):
                yield from one(whole.slice(at, PROBES // 32))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps, comp, large = (batch[c] for c in ("fp", "comp", "large"))
        plain = fps.to_numpy().view(np.uint64)
        spread = (plain * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        values = [values_of(plain, part) for part in plan.parts]
        shares = plan.limits(values) if probing else np.ones((len(plain), len(values)), np.int64)
        for i, value in enumerate(values):
            for share in range(1, plan.reach + 2):
                rows, flips = np.flatnonzero(shares[:, i] == share), plan.flips(i, share - 1)
                near, step = plan.near[i][share - 1], max(1, PROBES // len(flips))
                for start in range(0, len(rows), step):
                    some = rows[start : start + step]
                    probes = (value[some, None] ^ flips).ravel()
                    each = np.repeat(some, len(flips))
                    blocks = np.ceil(near[plan.low(i, probes)] / BLOCK).astype(np.uint64)
                    block = (spread[each] % np.maximum(blocks, 1)).astype(np.int32)
                    to = pa.array(each)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(plan.keys(i, probes)), pa.array(block), fps.take(to), comp.take(to), large.take(to)],
                        ["key", "block", "fp", "comp", "large"],
                    )

    return run


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links ``(a, b)`` those that joined something not joined before."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    found = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            found.append((x, y))
    return found


def _verified(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                q, d, qc, dc = (
                    batch[c][i].values.to_numpy() for c in ("probes", "fps", "probe_comps", "comps")
                )
                apart = np.bitwise_count(q.view(np.uint64)[:, None] ^ d.view(np.uint64))
                x, y = np.nonzero((apart <= reach) & (qc[:, None] != dc))
                if len(x):
                    pairs = np.unique(np.stack([qc[x], dc[y]], axis=1), axis=0)
                    found += spanning(pairs[:, 0], pairs[:, 1])
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
            )

    return run


def probe_links(known: DataFrame, plan: Plan) -> DataFrame:
    """Links ``(a, b)`` between the components ``comp`` of ``(fp, comp, large)``, by
    probes. Blocks of one ``large`` component don't meet."""
    kind = "key bigint, block int, fp bigint, comp bigint, large bigint"

    def blocks(probing: bool, fps: str, comps: str, large: str) -> DataFrame:
        rows = known.mapInArrow(_blocked(plan, probing), kind)
        grouped = rows.groupBy("key", "large", "block").agg(
            F.collect_list(F.struct("fp", "comp")).alias("held")
        )
        return grouped.select(
            "key", F.col("large").alias(large),
            F.col("held.fp").alias(fps), F.col("held.comp").alias(comps),
        )

    probes = blocks(True, "probes", "probe_comps", "probe_large")
    filed = blocks(False, "fps", "comps", "filed_large")
    other = F.coalesce(F.col("probe_large") != F.col("filed_large"), F.lit(True))
    met = probes.join(filed, (probes["key"] == filed["key"]) & other)
    met = met.select("probes", "probe_comps", "fps", "comps")
    return met.mapInArrow(_verified(plan.reach), "a bigint, b bigint")


def link_components(prints: DataFrame, reach: int) -> DataFrame:
    """``(fp, comp)`` of distinct fingerprints ``(fp, n)``: those linked at ``reach`` or
    fewer differing bits, over any path, share ``comp``, the least of them."""
    prints = staged(prints)
    n = prints.count()
    if n < 2 or reach == 0:
        return prints.select("fp", F.col("fp").alias("comp"))
    plan = make_plan(prints, n, reach)
    first = components(pivot_links(prints, plan))
    known = prints.join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("comp")
    )
    sizes = first.groupBy(F.col("component").alias("comp")).agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") >= BLOCK).select("comp", F.col("comp").alias("large"))
    known = staged(known.join(large, "comp", "left"))
    second = components(staged(probe_links(known, plan)))
    return known.join(second.withColumnRenamed("node", "comp"), "comp", "left").select(
        "fp", F.coalesce("component", "comp").alias("comp")
    )


def near_duplicates(
    docs: DataFrame, reach: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row.

    Words are lower-cased runs (A-Z only) of signs other than ASCII blanks; a text of
    fewer than four words has its whole sequence as the one shingle. Documents link if
    their fingerprints differ in ``reach`` bits or fewer; ``component_id`` is the least
    id reachable, nulls left aside (null if the row and all it reaches have none). Null
    and empty texts have the fingerprint 0 and link like any other; repeated rows share
    their component; an empty table gives no rows."""
    held = staged(fingerprints(docs, id_col, text_col))
    prints = staged(held.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    found = staged(link_components(prints.select("fp", "n"), reach).join(prints, "fp"))
    least = found.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = staged(found.join(least, "comp").select("fp", "component_id"))
    return held.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
