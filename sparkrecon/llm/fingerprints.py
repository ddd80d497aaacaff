"""Document fingerprints: Merkle trees over sections, paragraphs and phrases.

Sections end at blank lines, paragraphs at line ends; a paragraph is cut into
phrases of a few words, at words that end in one of some letters, so an edit moves
only the cuts beside it. A leaf is the digest of a phrase as it stands, a node the
digest of its children's digests. Equal roots tell equal texts; where roots differ,
walking down the differing branches finds the edits.

A fingerprint is text: the root, ``:``, then the leaves, shortened, with ``,`` after
each paragraph and ``;`` after each section: ``<root>:<leaf><leaf>,<leaf>,;``."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.common import id_ranges, parts_for, range_of

#: Hex digits of a root and of a leaf in a fingerprint.
ROOT, LEAF = 32, 6
#: A phrase: three words or more up to one that ends in a cutting letter, 12 at most.
_PHRASE = re.compile(
    r"\s*+(?:\S++\s++){2,11}?\S*[dnrtzs.,;:!?]\s++|\s*+(?:\S++\s++){12}|.+", re.DOTALL
)
_BLANK = re.compile(r"\s*")
#: Bytes of compressed input of one part, and most parts.
PART_BYTES, MOST_PARTS = 4 << 20, 10_000
#: Code points of output texts in one batch.
BATCH_CHARS = 8_000_000


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text; null counts as empty."""
    sections: list[bytes] = []
    paragraphs: list[bytes] = []
    shown: list[str] = []
    for line in (text or "").splitlines(keepends=True):
        leaves = [_digest(phrase.encode()) for phrase in _PHRASE.findall(line)]
        paragraphs.append(_digest(b"p" + b"".join(leaves)))
        shown += [leaf.hex()[:LEAF] for leaf in leaves]
        shown.append(",")
        if _BLANK.fullmatch(line):
            sections.append(_digest(b"s" + b"".join(paragraphs)))
            paragraphs = []
            shown.append(";")
    if paragraphs:
        sections.append(_digest(b"s" + b"".join(paragraphs)))
        shown.append(";")
    root = _digest(b"r" + b"".join(sections))
    return f"{root.hex()[:ROOT]}:{''.join(shown)}"


def leaves_of(fingerprint: str) -> list[str]:
    tree = fingerprint.partition(":")[2].replace(",", "").replace(";", "")
    return [tree[i : i + LEAF] for i in range(0, len(tree), LEAF)]


def likeness(one: str, other: str) -> float:
    """1 for equal roots, else the share of leaves in common, each as often as both
    hold it (0 for an empty text and another)."""
    if one[:ROOT] == other[:ROOT]:
        return 1.0
    return _likeness(Counter(leaves_of(one)), Counter(leaves_of(other)))


def _likeness(one: Counter, other: Counter) -> float:
    total = one.total() + other.total()
    if len(one) > len(other):
        one, other = other, one
    common = sum(min(n, other[leaf]) for leaf, n in one.items() if leaf in other)
    return 2.0 * common / total if total else 1.0


def differing(one: str, other: str) -> list[tuple[int, int]]:
    """Where two texts differ: ``(section, paragraph)`` numbers of the first one whose
    branch the second one lacks at that place of the tree. Whole sections that agree
    are passed over; a missing section differs in all its paragraphs."""
    if one[:ROOT] == other[:ROOT]:
        return []
    trees = [
        [section.split(",")[:-1] for section in f.partition(":")[2].split(";")[:-1]]
        for f in (one, other)
    ]
    found = []
    for i, section in enumerate(trees[0]):
        twin = trees[1][i] if i < len(trees[1]) else []
        if section != twin:
            found += [
                (i, j) for j, p in enumerate(section) if j >= len(twin) or twin[j] != p
            ]
    return found


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint)`` of each row."""
    kind = dict(docs.dtypes)[id_col]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(made, f"doc_id {kind}, fingerprint string")


def with_next(
    docs: DataFrame,
    each: Callable[[int | None, str, str], tuple],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``each(doc_id, text, next text)`` for every document, the next one by ascending
    id; after the last comes the first.

    Documents are dealt to ascending ranges of ids and sorted there. The first
    document of a range also goes, marked, to the end of the range before it; these
    are as many as ranges, ``MOST_PARTS`` at most. A task holds two documents at a
    time. Null ids come first, rows of one id in the order of their texts; a null
    text is empty. A single document is its own next one."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = min(parts_for(rows, PART_BYTES), MOST_PARTS)
    bounds = id_ranges(rows, "doc_id", parts)
    ranged = rows.withColumn("part", range_of(F.col("doc_id"), bounds))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    heads = sorted(
        (r.part, r.head.known, r.head.doc_id)
        for r in ranged.groupBy("part").agg(F.min(key).alias("head")).collect()
    )
    goal = {part: heads[i - 1][0] for i, (part, _, _) in enumerate(heads)}
    marks = docs.sparkSession.createDataFrame(
        [(part, doc_id, goal[part]) for part, _, doc_id in heads],
        "part int, head long, goal int",
    )
    marked = ranged.join(
        F.broadcast(marks.withColumnRenamed("part", "of")),
        (F.col("part") == F.col("of")) & F.col("head").eqNullSafe(F.col("doc_id")),
        "left",
    )
    stay = F.struct(F.col("part").alias("part"), F.lit(False).alias("follows"))
    also = F.struct(F.col("goal").alias("part"), F.lit(True).alias("follows"))
    places = F.when(F.col("goal").isNull(), F.array(stay)).otherwise(F.array(stay, also))
    dealt = (
        marked.select(F.explode(places).alias("to"), "doc_id", "text")
        .select("to.part", "to.follows", "doc_id", "text")
        .repartitionById(parts, "part")
        .sortWithinPartitions("part", "follows", "doc_id", "text")
    )
    fields = [field.split() for field in schema.split(", ")]
    types = pa.schema([pa.field(name, _ARROW[kind]) for name, kind in fields])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        chars, held = 0, None

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*found, strict=True)]
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types
            )

        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                part, follows, doc_id, text = (v.as_py() for v in values)
                text = text or ""
                if held and held[0] == part:
                    found.append(each(held[1], held[2], text))
                    chars += len(held[2])
                    if chars >= BATCH_CHARS:
                        yield flush()
                        chars = 0
                held = None if follows else (part, doc_id, text)
        if found:
            yield flush()

    return dealt.mapInArrow(walk, schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def edited_text(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the beginning of the
    following one, as many code points of it or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they are:
    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``."""

    def each(doc_id: int | None, text: str, following: str) -> tuple:
        edited = edited_text(text, following)
        own, changed, after = fingerprint(text), fingerprint(edited), fingerprint(following)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed,
            likeness(own, changed), likeness(own, after),
        )

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return with_next(docs, each, schema, id_col, text_col)
