"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their first letters, hashed to 32 bits. The
machine gives a term a weight and a short vector; two terms of one text add the
product of their vectors, so an insult together with a mention of a group can
count for more than both alone, which additive weights cannot say.

It is fitted on a bounded sample of labelled texts, in the driver, and knows the
terms that several of these hold; its size is bounded by the sample. All texts
are scored in Arrow batches with it."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrecon.llm.common import free_name, staged

#: Most labelled texts that are fitted, and the least of them that hold a term.
SAMPLE_TEXTS, LEAST_TEXTS = 12_000, 3
#: Least chi-square of a term and the label (one in two thousand by chance): terms that
#: go with neither label only add noise to the sums over pairs.
LEAST_CHI_SQUARE = 12.0
#: Length of a term's vector, passes over the sample, texts of a step.
FACTORS, EPOCHS, BATCH = 4, 12, 256
#: Step sizes of weights and vectors, and how much both shrink.
RATE, FACTOR_RATE, SHRINK = 0.3, 0.05, 1e-5
#: Lengths of the beginnings of words that are terms as well.
BEGINNINGS = (4, 5)
#: Words a worker remembers.
CACHE_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: CRC of the id as text divisible by 5. A
    null id is held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def terms_of(word: str) -> list[int]:
    found = [zlib.crc32(word.encode())]
    for n in BEGINNINGS:
        if len(word) > n:
            found.append(zlib.crc32(f"{word[:n]}\0".encode()))
    return found


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class FactorizationMachine:
    """Score ``sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>)`` over the terms."""

    terms: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray) -> float:
        raw = self.bias
        if len(rows):
            v = self.factors[rows]
            total = v.sum(0)
            raw += float(self.weights[rows].sum() + 0.5 * (total @ total - (v * v).sum()))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, raw))))


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """Fit on arrays of distinct term hashes and labels 0 or 1, by AdaGrad on the
    logistic loss. Without labelled texts, or with one label only, the score is
    the share of label 1 (0 without texts)."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0.0 < share < 1.0:
        edge = -30.0 if share <= 0 else 30.0
        return FactorizationMachine(
            np.empty(0, np.uint32), edge, np.empty(0), np.empty((0, FACTORS))
        )
    hashes, place = np.unique(np.concatenate(texts), return_inverse=True)
    counts = np.bincount(place, minlength=len(hashes)).astype(float)
    of_one = np.bincount(
        place, np.repeat(labels, [len(t) for t in texts]), minlength=len(hashes)
    )
    n = float(len(texts))
    gap = of_one * n - counts * n * share
    chi = gap * gap / np.maximum(counts * (n - counts) * n * share * (1 - share), 1.0)
    terms = hashes[(counts >= LEAST_TEXTS) & (chi >= LEAST_CHI_SQUARE)]
    rows = []
    for text in texts:
        at = np.searchsorted(terms, text)
        at = np.minimum(at, max(len(terms) - 1, 0))
        rows.append(at[terms[at] == text] if len(terms) else np.empty(0, np.int64))
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS))
    bias = math.log(share / (1 - share))
    seen_w, seen_v, seen_b = np.full(len(terms), 1e-3), np.full(factors.shape, 1e-3), 1.0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            sizes = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            v = factors[flat]
            total = np.stack(
                [np.bincount(owner, v[:, f], len(part)) for f in range(FACTORS)], axis=1
            )
            own = np.bincount(owner, (v * v).sum(1), len(part))
            raw = bias + np.bincount(owner, weights[flat], len(part))
            raw += 0.5 * ((total * total).sum(1) - own)
            slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]
            used, place = np.unique(flat, return_inverse=True)
            each = slope[owner]
            step = np.bincount(place, each, len(used)) + SHRINK * BATCH * weights[used]
            seen_w[used] += step * step
            weights[used] -= RATE * step / np.sqrt(seen_w[used])
            pull = each[:, None] * (total[owner] - v)
            for f in range(FACTORS):
                step = np.bincount(place, pull[:, f], len(used))
                step += SHRINK * BATCH * factors[used, f]
                seen_v[used, f] += step * step
                factors[used, f] -= FACTOR_RATE * step / np.sqrt(seen_v[used, f])
            step = slope.sum()
            seen_b += step * step
            bias -= RATE * step / math.sqrt(seen_b)
    return FactorizationMachine(terms, float(bias), weights, factors)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("text"):
            terms = {t for word in words_of(text.as_py()) for t in terms_of(word)}
            found.append(np.array(sorted(terms), np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())],
            ["doc_id", "toxic", "terms"],
        )


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The machine fitted on all rows of a task, as one row."""
    rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    rows.sort(key=lambda r: (r[1], r[0]))
    found = fit(
        [np.frombuffer(terms, np.uint32) for _, terms in rows],
        np.array([float(toxic > 0) for toxic, _ in rows]),
    )
    arrays = [found.terms.astype("<u4"), found.weights.astype("<f8"), found.factors.astype("<f8")]
    yield pa.RecordBatch.from_arrays(
        [pa.array([found.bias]), *(pa.array([a.tobytes()]) for a in arrays)],
        ["bias", "terms", "weights", "factors"],
    )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_TEXTS) -> FactorizationMachine:
    """Fit on at most ``sample`` labelled documents, those of lowest hashed id.

    Labels of held-out ids are not read. Of several labels of one id the highest
    counts, of several texts the one whose terms come first; null labels and ids are
    none, and empty tables or one label only give a constant score. The sample's ids are
    broadcast, so the texts do not shuffle; the terms of the sample are written, and one
    task fits them. The driver receives the machine alone."""
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    terms = texts.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(
        _hashed, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, toxic int, terms binary"
    )
    once = staged(terms.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms")))
    kind = "bias double, terms binary, weights binary, factors binary"
    row = once.select("toxic", "terms").coalesce(1).mapInArrow(_fitted, kind).first()
    if row is None:
        return fit([], np.empty(0))
    return FactorizationMachine(
        np.frombuffer(row["terms"], "<u4"), row["bias"], np.frombuffer(row["weights"], "<f8"),
        np.frombuffer(row["factors"], "<f8").reshape(-1, FACTORS),
    )


def with_score(
    docs: DataFrame, model: FactorizationMachine, text_col: str = "text", into: str = "score"
) -> DataFrame:
    """``docs`` with the column ``into``. A null or empty text has no terms, its score
    follows from the bias. Repeated rows are scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = {int(t): i for i, t in enumerate(own.terms)}
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for text in batch.column(text_col):
                rows: set[int] = set()
                for word in words_of(text.as_py()):
                    at = cache.get(word)
                    if at is None:
                        at = tuple(place[t] for t in terms_of(word) if t in place)
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        cache[word] = at
                    rows.update(at)
                scores.append(own.score(np.fromiter(sorted(rows), np.int64, len(rows))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, into]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    return docs.mapInArrow(scored, schema)


def score(
    docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, score, predicted)`` of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_score(rows, model).select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic."""
    into = free_name(docs, "toxic_score")
    return with_score(docs, model, text_col, into).where(F.col(into) < 0.5).drop(into)
