"""Personal data by weak supervision.

Base spans come from fixed patterns and checks and always stay. Looser patterns
propose more: keys and tokens, phone numbers without a country code, spelled-out
addresses. On all of these spans three labelers vote: the shape of the span, a
gazetteer of known beginnings and endings, and words before it. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler
is; with these probabilities as soft labels a logistic classifier learns to judge a
span by its features, and proposed spans it accepts are added.

DataFrame functions throughout. Texts are scanned twice: to learn and to apply."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.common import staged

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "secret", "spelled_email")
KINDS = BASE + ADDED

#: The base patterns, so written that a search is linear: a run of signs is taken
#: whole, and no match begins inside a run that failed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "added": (
        r"(?<![A-Za-z0-9_+)(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
        r"|(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+"
        r"|(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++"
        r" ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,}+"
    ),
}
#: A quick test that a text without it has no match.
HINTS = {
    "email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]",
    "phone": r"\+[0-9]", "added": r"[0-9]|dot",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Gazetteers: beginnings of keys, country codes, card issuers, endings of hosts.
KEY_STARTS = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|glpat|sk_|pk_|xox[abp]|eyJ)"
COUNTRY_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]"
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
HOST_ENDS = r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$"
#: Words that announce a kind, looked for in the code points before a span.
CONTEXT = 32
CUES = {
    "email": "mail|contact|write to", "ip": "ip|host|server|address", "card": "card|visa|credit|pay",
    "phone": "phone|tel|call|fax|mobile", "local_phone": "phone|tel|call|fax|mobile",
    "secret": "key|token|secret|password|passwd|auth", "spelled_email": "mail|contact|write to",
}
#: Steps of the expectation maximisation, and counts each outcome has beforehand.
STEPS, PRIOR = 50, 1.0
LABELERS = ("shape", "gazetteer", "context")

_SPANS = "array<struct<kind:string,start:int,end:int,match:string>>"


def _hits(text: Column, name: str) -> tuple[Column, Column]:
    """Matches of a pattern and the gaps around them."""
    pattern, some = PATTERNS[name], text.rlike(HINTS[name])
    none = F.array().cast("array<string>")
    hits = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(some, F.split(text, pattern, -1)).otherwise(none)
    return hits, gaps


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _added_kind(match: Column) -> Column:
    return (
        F.when(match.rlike("^[A-Za-z0-9_]{16,}$"), "secret")
        .when(match.rlike("[A-Za-z]"), "spelled_email").otherwise("local_phone")
    )


def _spans(name: str, hits: Column, gaps: Column) -> Column:
    """Valid matches with their places: before match i lie gaps 0 to i and matches 0
    to i - 1. Only valid ones are placed."""
    lengths = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
    numbered = F.transform(hits, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    kept = numbered if name in ("email", "added") else F.filter(numbered, lambda x: _valid(name, x["h"]))

    def place(x: Column) -> Column:
        before = F.aggregate(F.slice(lengths, F.lit(1), x["i"]), F.lit(0), lambda a, b: a + b)
        start = before + F.length(F.get(gaps, x["i"]))
        kind = _added_kind(x["h"]) if name == "added" else F.lit(name)
        return F.struct(
            kind.alias("kind"), start.alias("start"),
            (start + F.length(x["h"])).alias("end"), x["h"].alias("match"),
        )

    return F.transform(kept, place).cast(_SPANS)


def _with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``_text``, ``_base`` (spans in the order of kinds, then place) and
    ``_proposed`` (spans that overlap no base span)."""
    found = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    for name in PATTERNS:
        hits, gaps = _hits(F.col("_text"), name)
        found = found.withColumns({f"_hits_{name}": hits, f"_gaps_{name}": gaps})
    base = F.concat(*[_spans(k, F.col(f"_hits_{k}"), F.col(f"_gaps_{k}")) for k in BASE])
    proposed = _spans("added", F.col("_hits_added"), F.col("_gaps_added"))
    found = found.withColumns({"_base": base, "_loose": proposed}).drop(
        *[f"_{what}_{name}" for name in PATTERNS for what in ("hits", "gaps")]
    )
    free = F.filter(
        "_loose",
        lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    return found.withColumn("_proposed", free).drop("_loose")


def _before(text: Column, span: Column) -> Column:
    first = F.greatest(span["start"] - CONTEXT, F.lit(0))
    return F.lower(F.substring(text, first + 1, span["start"] - first))


def _has_cue(kind: Column, before: Column) -> Column:
    found = F.lit(False)
    for name, words in CUES.items():
        found = found | ((kind == name) & before.rlike(rf"(?:{words})\W"))
    return found


def _votes(kind: Column, match: Column, cue: Column) -> dict[str, Column]:
    """Each labeler's vote: 1 for, 0 against, 2 none."""
    hexadecimal = match.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$")
    mixed = match.rlike("[0-9].*[A-Za-z].*[0-9]|[A-Za-z].*[0-9].*[A-Za-z]")
    shape = (
        F.when(kind.isin(*BASE), 1)
        .when(kind == "secret", F.when(hexadecimal | mixed, 1).otherwise(0))
        .when(kind == "spelled_email", F.when(match.rlike(r"\[at\]|\(at\)"), 1).otherwise(0))
        .otherwise(F.when(match.rlike(r"^\("), 1).otherwise(2))
    )
    gazetteer = (
        F.when(kind == "secret", F.when(match.rlike(KEY_STARTS), 1).otherwise(2))
        .when(kind == "phone", F.when(match.rlike(COUNTRY_CODES), 1).otherwise(0))
        .when(kind == "card", F.when(match.rlike(CARD_ISSUERS), 1).otherwise(0))
        .when(kind == "email", F.when(match.rlike(HOST_ENDS), 1).otherwise(0))
        .when(kind == "spelled_email", F.when(match.rlike(r"\b(?:com|org|net|de|fr|es)$"), 1).otherwise(0))
        .otherwise(2)
    )
    return {"shape": shape, "gazetteer": gazetteer, "context": F.when(cue, 1).otherwise(2)}


def _features(kind: Column, match: Column, text: Column, start: Column, cue: Column) -> list[Column]:
    """Features of a span, in steps, so that few different rows of them exist."""
    n = F.length(match)
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    capitals = F.length(F.regexp_replace(match, "[^A-Z]", ""))
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(F.lit(" "))
    quarters = [F.floor(4 * part / n).cast("double") / 4 for part in (digits, capitals)]
    return [
        *[(kind == k).cast("double") for k in KINDS],
        F.least(F.floor(F.log2(n.cast("double"))), F.lit(8)).cast("double") / 8,
        *quarters,
        cue.cast("double"),
        before.rlike(r"\s").cast("double"),
        before.rlike("[\"'=:]").cast("double"),
    ]


@dataclass
class SpanModel:
    """What was learned: the chance of a true span, each labeler's votes given truth,
    and the classifier. Without spans to learn from it accepts none."""

    share: float = 0.5
    reliability: dict[str, list[list[float]]] = field(default_factory=dict)
    intercept: float = -math.inf
    weights: list[float] = field(default_factory=list)

    def accepts(self, features: Sequence[Column]) -> Column:
        if not self.weights:
            return F.lit(False)
        total = F.lit(self.intercept)
        for weight, value in zip(self.weights, features, strict=True):
            total = total + weight * value
        return total >= 0


def estimate(patterns: Sequence[tuple[tuple[int, ...], float]]) -> tuple[float, dict, list[float]]:
    """Expectation maximisation over ``(votes, count)`` of at most 27 vote patterns:
    the share of true spans, ``reliability[labeler][truth][vote]``, and each
    pattern's probability to be true. Labelers start as better than chance."""
    share = 0.5
    tables = {name: [[0.6, 0.2, 0.2], [0.2, 0.6, 0.2]] for name in LABELERS}
    true: list[float] = []
    for _ in range(STEPS):
        true = []
        for votes, _count in patterns:
            odds = [1.0 - share, share]
            for name, vote in zip(LABELERS, votes, strict=True):
                odds = [o * tables[name][y][vote] for y, o in enumerate(odds)]
            true.append(odds[1] / (odds[0] + odds[1]))
        counts = [c for _, c in patterns]
        total = sum(counts)
        share = (sum(p * c for p, c in zip(true, counts, strict=True)) + PRIOR) / (total + 2 * PRIOR)
        for at, name in enumerate(LABELERS):
            for y in (0, 1):
                sums = [PRIOR] * 3
                for (votes, count), p in zip(patterns, true, strict=True):
                    sums[votes[at]] += count * (p if y else 1 - p)
                tables[name][y] = [s / sum(sums) for s in sums]
    return share, tables, true


def learn(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Estimate the labelers and train the classifier on the spans of all texts.

    Spans are grouped by votes and features as soon as they are found; the features
    come in steps, so the groups stay few whatever the size of the corpus."""
    found = _with_spans(docs.select(F.col(text_col).alias("_source")), F.col("_source"))
    spans = found.select("_text", F.explode(F.concat("_base", "_proposed")).alias("s")).select(
        "_text", "s.kind", "s.start", "s.match", _has_cue(F.col("s.kind"), _before(F.col("_text"), F.col("s"))).alias("cue")
    )
    votes = _votes(F.col("kind"), F.col("match"), F.col("cue"))
    features = _features(F.col("kind"), F.col("match"), F.col("_text"), F.col("start"), F.col("cue"))
    grouped = staged(
        spans.select(*[v.alias(k) for k, v in votes.items()], F.array(*features).alias("x"))
        .groupBy(*LABELERS, "x").agg(F.count("*").cast("double").alias("n"))
    )
    rows = grouped.groupBy(*LABELERS).agg(F.sum("n").alias("n")).orderBy(*LABELERS).collect()
    if not rows:
        return SpanModel()
    patterns = [(tuple(r[k] for k in LABELERS), r.n) for r in rows]
    share, reliability, true = estimate(patterns)
    chance = F.lit(0.0)
    for (pattern, _), p in zip(patterns, true, strict=True):
        same = [F.col(k) == v for k, v in zip(LABELERS, pattern, strict=True)]
        chance = F.when(same[0] & same[1] & same[2], p).otherwise(chance)
    soft = grouped.withColumn("p", chance)
    both = F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")),
    )
    training = soft.select(array_to_vector("x").alias("features"), F.explode(both).alias("y")).select(
        "features", "y.label", "y.weight"
    )
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(
        training.where("weight > 0")
    )
    return SpanModel(share, reliability, float(model.intercept), [float(w) for w in model.coefficients])


def with_spans(docs: DataFrame, model: SpanModel, text_col: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with ``into``: ``array<struct<kind, start, end, match>>``, ordered by kind
    (as in ``KINDS``) and place. Starts and ends count code points, the end excluded.
    A null or empty text has none. Columns whose names begin with ``_`` are reserved."""
    found = _with_spans(docs, F.col(text_col))

    def accepted(span: Column) -> Column:
        cue = _has_cue(span["kind"], _before(F.col("_text"), span))
        return model.accepts(_features(span["kind"], span["match"], F.col("_text"), span["start"], cue))

    added = F.filter("_proposed", accepted)
    by_kind = [_of_kind(added, k) for k in ADDED]
    return found.withColumn(into, F.concat("_base", *by_kind)).drop("_text", "_base", "_proposed")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def report(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans and all spans of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_spans(rows, model)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [
        F.size(_of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in BASE
    ]
    digest = F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets, as ``<email>``.
    Of overlapping spans the first, and of those the longest, gives the name, and
    all they cover is replaced."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("e"), s["kind"])))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        first, last = span["start"], -span["e"]
        gap = F.substring(text, state["at"] + 1, first - state["at"])
        fresh = F.concat(state["done"], gap, F.lit("<"), span["kind"], F.lit(">"))
        return F.struct(
            F.when(first >= state["at"], fresh).otherwise(state["done"]).alias("done"),
            F.greatest(state["at"], last).alias("at"),
        )

    def finish(state: Column) -> Column:
        return F.concat(state["done"], F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(order, start, step, finish)).otherwise(text)


def without_personal_data(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in their texts masked, and ``n_chars``, if there, counted
    anew. A null text stays null."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    found = with_spans(rows, model).withColumn("text", masked(F.col("text"), F.col("spans")))
    new = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(
        *[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    )
