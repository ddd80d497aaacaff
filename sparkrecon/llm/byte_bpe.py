"""Byte-level BPE: encoding and decoding with ranks of a public vocabulary.

1. Texts are cut by the vocabulary's pattern. The words of some texts form a block;
   it keeps its texts as codes of its distinct words, and files these words in
   buckets by hash.
2. A bucket's distinct words, from all blocks, are folded once each: a higher-order
   ``aggregate`` over a word's array of bytes merges the adjacent pair of lowest rank
   until no pair has one. Ranks are a literal of the plan, a map cut into small
   buckets by CRC so that a look-up reads one or two entries; the vocabulary bounds it.
3. A bucket's ids are written with the places each block asks for, and go back to the
   blocks from there, packed: words shuffle once.
4. A block turns its codes into ids, and ids into text by joining binary pieces.

A fold copies its arrays in each step, so a very long word is merged through a queue of
pairs instead, with the same merges in the same order. So neither single words of texts nor the corpus' dictionary ever meet in one task,
and texts do not shuffle as rows of words."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.common import parts_for, staged

#: The pattern of the vocabulary with Unicode white space, as Java reads it.
JAVA_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
#: More than any rank.
NO_RANK = 2**31 - 1
#: Words of texts after which a block ends, and the codes' bytes that are kept apart.
BLOCK_WORDS, PLANES = 4_000_000, 4
#: Bytes of compressed input for each bucket of words, and buckets at most: a dictionary
#: grows slower than its corpus.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 1 << 16
#: Bytes of a word from which on a queue merges it.
LONG_WORD = 512


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Piece of bytes -> rank, from a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(piece): int(rank) for piece, rank in pairs}


@lru_cache(maxsize=4)
def _buckets(path: str) -> tuple[str, int]:
    table = ranks(path)
    count = 1 << max(len(table).bit_length(), 1)
    buckets: list[dict[str, int]] = [{} for _ in range(count)]
    for piece, rank in table.items():
        buckets[zlib.crc32(piece) % count][piece.hex().upper()] = rank
    return json.dumps(buckets, separators=(",", ":")), count


def rank_table(path: str) -> Column:
    """The literal rank map, cut into buckets by CRC of the piece."""
    return F.from_json(F.lit(_buckets(path)[0]), "array<map<string,int>>")


def rank_of(piece: Column, table: Column, buckets: int) -> Column:
    """The rank of a piece of bytes, ``NO_RANK`` if it has none."""
    bucket = F.get(table, F.pmod(F.crc32(piece), F.lit(buckets)).cast("int"))
    return F.coalesce(F.try_element_at(bucket, F.hex(piece)), F.lit(NO_RANK))


def byte_pieces(word: Column) -> Column:
    """A word as an array of single bytes."""
    data = F.encode(word, "UTF-8")
    return F.transform(
        F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(data, i, F.lit(1))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_words(words: Column, path: str) -> Column:
    """The token ids of each word of an array, null for words of ``LONG_WORD`` bytes and
    more: the fold of a word's bytes by ranked merges.

    The state is the array of pieces and the array of ranks of adjacent pairs. A
    step merges the leftmost pair of lowest rank and looks up only the two pairs
    that the merge changes."""
    buckets = _buckets(path)[1]

    def folded(table: Column) -> Column:
        short = lambda word: F.octet_length(word) < LONG_WORD
        return F.transform(words, lambda word: F.when(short(word), _fold(word, table, buckets)))

    return let(rank_table(path), folded)


def merged_ids(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The token ids of one word, its pairs in a queue by rank and position. A byte
    without a rank gives ``NO_RANK``, as in the fold."""
    size = len(word)
    ends, before = list(range(1, size + 1)), list(range(-1, size - 1))
    alive, queue = bytearray(b"\1" * size), []

    def push(start: int) -> None:
        if start >= 0 and ends[start] < size:
            end = ends[ends[start]]
            rank = table.get(word[start:end])
            if rank is not None:
                heapq.heappush(queue, (rank, start, end))

    for start in range(size):
        push(start)
    while queue:
        _, start, end = heapq.heappop(queue)
        middle = ends[start]
        # A pair whose pieces have changed since has another end or none.
        if not alive[start] or middle >= size or ends[middle] != end:
            continue
        alive[middle], ends[start] = 0, end
        if end < size:
            before[end] = start
        push(before[start])
        push(start)
    return [table.get(word[i : ends[i]], NO_RANK) for i in range(size) if alive[i]]


def _fold(word: Column, table: Column, buckets: int) -> Column:
    none = F.array().cast("array<int>")

    def rank(left: Column, right: Column) -> Column:
        return rank_of(F.concat(left, right), table, buckets)

    def start(pieces: Column) -> Column:
        pairs = F.transform(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1),
            lambda piece, i: rank(piece, F.get(pieces, i + 1)),
        )
        return F.struct(pieces.alias("pieces"), pairs.alias("pairs"))

    def merge(state: Column, at: Column) -> Column:
        """Merge the pair ``at`` (from 1) of the state."""
        pieces, pairs = state["pieces"], state["pairs"]
        merged = F.concat(F.get(pieces, at - 1), F.get(pieces, at))

        def with_merged(new: Column) -> Column:
            before = F.when(at > 1, F.array(rank(F.get(pieces, at - 2), new))).otherwise(none)
            after = F.when(
                at < F.size(pairs), F.array(rank(new, F.get(pieces, at + 1)))
            ).otherwise(none)
            return F.struct(
                F.concat(
                    F.slice(pieces, F.lit(1), at - 1),
                    F.array(new),
                    F.slice(pieces, at + 2, F.size(pieces)),
                ).alias("pieces"),
                F.concat(
                    F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))),
                    before,
                    after,
                    F.slice(pairs, at + 2, F.size(pairs)),
                ).alias("pairs"),
            )

        return let(merged, with_merged)

    def step(state: Column, _: Column) -> Column:
        lowest = F.coalesce(F.array_min(state["pairs"]), F.lit(NO_RANK))
        return let(
            lowest,
            lambda low: F.when(low == NO_RANK, state).otherwise(
                merge(state, F.array_position(state["pairs"], low).cast("int"))
            ),
        )

    size = F.octet_length(word)
    steps = F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)))
    return let(
        byte_pieces(word),
        lambda pieces: F.aggregate(
            steps,
            start(pieces),
            step,
            lambda state: F.transform(state["pieces"], lambda piece: rank_of(piece, table, buckets)),
        ),
    )


_BLOCK = (
    "kind int, block string, bucket int, words binary, doc_ids array<long>, "
    "counts binary, codes binary, places binary"
)
_NAMES = ["kind", "block", "bucket", "words", "doc_ids", "counts", "codes", "places"]
_TYPES = [
    pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()),
    *[pa.binary()] * 3,
]
#: Kinds of rows of a block.
TEXTS, WORDS = 0, 1


def _packed(codes: np.ndarray) -> bytes:
    """Codes byte by byte, all low bytes first: high bytes of frequent words are 0."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, PLANES).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(
        pa.decompress(data, PLANES * count, "zstd", asbytes=True), np.uint8
    ).reshape(PLANES, count)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _zipped(*parts: bytes) -> bytes:
    """Bytes behind their lengths, compressed: shuffled data is mostly such."""
    data = b"".join(parts)
    head = np.array([len(parts), len(data), *map(len, parts)], "<u8").tobytes()
    return head + pa.compress(data, "zstd", asbytes=True)


def _unzipped(data: bytes) -> list[bytes]:
    count, size = (int(n) for n in np.frombuffer(data, "<u8", 2))
    ends = np.cumsum(np.frombuffer(data, "<u8", count, 16).astype(np.int64))
    whole = pa.decompress(data[16 + 8 * count :], size, "zstd", asbytes=True) if size else b""
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _packed_words(words: list[str]) -> bytes:
    data = [word.encode() for word in words]
    return _zipped(np.array([len(w) for w in data], "<u4").tobytes(), b"".join(data))


def _unpacked_words(data: bytes) -> pa.StringArray:
    lengths, text = _unzipped(data)
    ends = np.cumsum(np.frombuffer(lengths, "<u4"))
    offsets = np.concatenate([[0], ends]).astype("<i4")
    return pa.StringArray.from_buffers(
        len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)
    )


def _blocks(buckets: int):
    """Batches of ``(doc_id, words)`` to rows of blocks."""

    def rows_of(block: str, vocabulary: dict[str, int], ids: list, counts: list, codes: list):
        words = list(vocabulary)
        codes = np.concatenate([np.empty(0, np.int64), *codes])
        # Frequent words get small codes; a place is a word's rank by bucket.
        often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        code = np.empty(len(words), np.int64)
        code[often] = np.arange(len(words))
        bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words], np.int64)
        # Words in order within a bucket: neighbours share letters and ids, and shrink.
        by_bucket = np.array(sorted(range(len(words)), key=lambda i: (bucket[i], words[i])), np.int64)
        places = np.empty(len(words), "<u4")
        places[code[by_bucket]] = np.arange(len(words))
        rows = [
            (
                TEXTS, block, None, None, ids, np.concatenate([np.empty(0, "<i4"), *counts]).astype("<i4").tobytes(),
                _packed(code[codes]), places.tobytes(),
            )
        ]
        cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
        for part in np.split(by_bucket, cuts) if len(words) else []:
            own = _packed_words([words[i] for i in part])
            rows.append((WORDS, block, int(bucket[part[0]]), own, None, None, None, None))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        vocabulary: dict[str, int] = {}
        ids, counts, codes, size = [], [], [], 0
        for batch in batches:
            # Few documents at a time, so a block ends soon after it is full.
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                lists = part.column("words")
                flat = lists.flatten().dictionary_encode()
                known = np.array(
                    [vocabulary.setdefault(w, len(vocabulary)) for w in flat.dictionary.to_pylist()], np.int64
                )
                codes.append(known[flat.indices.to_numpy()] if len(flat) else np.empty(0, np.int64))
                counts.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                ids += part.column("doc_id").to_pylist()
                size += len(flat)
                if size >= BLOCK_WORDS:
                    yield rows_of(f"{task}-{number}", vocabulary, ids, counts, codes)
                    number += 1
                    vocabulary, ids, counts, codes, size = {}, [], [], [], 0
        if ids:
            yield rows_of(f"{task}-{number}", vocabulary, ids, counts, codes)

    return run


_ASKED = "bucket int, words array<string>, blocks array<string>, wanted array<binary>"


def _asked(table: pa.Table) -> pa.Table:
    """A bucket's rows to one: its distinct words, and for each block the places of its
    words among them."""
    lists = [_unpacked_words(data) for data in table.column("words").to_pylist()]
    words = pc.unique(pa.concat_arrays(lists))
    wanted = [_zipped(pc.index_in(own, words).to_numpy().astype("<u4").tobytes()) for own in lists]
    return pa.table(
        {
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
            "words": pa.array([words.to_pylist()], pa.list_(pa.string())),
            "blocks": pa.array([table.column("block").to_pylist()], pa.list_(pa.string())),
            "wanted": pa.array([wanted], pa.list_(pa.binary())),
        }
    )


_GIVEN = "block string, bucket int, given binary"


def _given_back(path: str):
    """Rows ``(bucket, ids, long_words, blocks, wanted)`` to the ids of each block's words,
    in the order of its list."""
    table = ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lists = batch.column("ids")[row].values
                rest = batch.column("long_words")[row].as_py()
                if rest:
                    found = lists.to_pylist()
                    gaps = [i for i, own in enumerate(found) if own is None]
                    for i, word in zip(gaps, rest, strict=True):
                        found[i] = merged_ids(word.encode(), table)
                    lists = pa.array(found, pa.list_(pa.int32()))
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, starts = lists.flatten().to_numpy(), np.cumsum(sizes) - sizes
                blocks = batch.column("blocks")[row].as_py()
                given = []
                for wanted in batch.column("wanted")[row].as_py():
                    at = np.frombuffer(_unzipped(wanted)[0], "<u4")
                    own = _gathered(ids, starts[at], sizes[at]).astype("<u4").tobytes()
                    given.append(_zipped(sizes[at].astype("<u4").tobytes(), own))
                bucket = batch.column("bucket")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.string()), pa.array([bucket] * len(blocks), pa.int32()), pa.array(given, pa.binary())],
                    ["block", "bucket", "given"],
                )

    return run


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start : start + size]`` of all, one after the other."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return values[at]


class Decoder:
    """Ids to bytes, by joining the binary pieces of the vocabulary."""

    def __init__(self, table: dict[bytes, int]):
        pieces = [b""] * (max(table.values(), default=-1) + 1)
        for piece, rank in table.items():
            pieces[rank] = piece
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        return _gathered(self.data, self.starts[ids], self.sizes[ids]).tobytes()


_CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ENCODED = "doc_id long, ids array<int>"
_DECODED = "doc_id long, bytes binary"


def _assembled(build: Callable[[list, list[np.ndarray]], pa.Table]):
    """Blocks and the ids of their words to tables, by ``build``, of document ids and
    each document's token ids."""

    def run(texts: pa.Table, given: pa.Table) -> pa.Table:
        doc_ids, tokens = [], []
        order = np.argsort(given.column("bucket").to_numpy(), kind="stable")
        parts = [_unzipped(given.column("given")[int(i)].as_py()) for i in order]
        # By place, that is by bucket; then by code.
        ids = np.frombuffer(b"".join(p[1] for p in parts), "<u4")
        lengths = np.frombuffer(b"".join(p[0] for p in parts), "<u4").astype(np.int64)
        for row in texts.to_pylist():
            places = np.frombuffer(row["places"], "<u4")
            starts, sizes = (np.cumsum(lengths) - lengths)[places], lengths[places]
            counts = np.frombuffer(row["counts"], "<i4")
            codes = _unpacked(row["codes"], int(counts.sum()))
            first = 0
            for doc_id, count in zip(row["doc_ids"], counts, strict=True):
                own = codes[first : first + count]
                first += count
                doc_ids.append(doc_id)
                tokens.append(_gathered(ids, starts[own], sizes[own]))
        return build(doc_ids, tokens)

    return run


def _ids(doc_ids: list, tokens: list[np.ndarray]) -> pa.Table:
    ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
    values = np.concatenate([np.empty(0, "<u4"), *tokens]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": lists})


def _digests(path: str):
    table = ranks(path)

    def build(doc_ids: list, tokens: list[np.ndarray]) -> pa.Table:
        decoder, sha256 = Decoder(table), hashlib.sha256
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "n_tokens": pa.array([len(t) for t in tokens], pa.int64()),
                "ids_sha256": pa.array([sha256(t.astype("<u4").tobytes()).hexdigest() for t in tokens], pa.string()),
                "decoded_sha256": pa.array([sha256(decoder.decode(t)).hexdigest() for t in tokens], pa.string()),
            }
        )

    return build


def _written(blocks: DataFrame, buckets: int) -> DataFrame:
    """The blocks' rows as a table bucketed by block, so that texts don't shuffle again
    when their words' ids come back."""
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    (
        blocks.write.format("parquet").option("compression", "zstd").partitionBy("kind")
        .bucketBy(min(buckets, 100_000), "block").saveAsTable(name)
    )
    return blocks.sparkSession.table(name)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, build, schema: str) -> DataFrame:
    words = F.regexp_extract_all(
        F.coalesce(F.col(text_col), F.lit("")), F.lit(JAVA_PATTERN), F.lit(0)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    buckets = min(parts_for(docs, BUCKET_BYTES), MOST_BUCKETS)
    blocks = _written(rows.mapInArrow(_blocks(buckets), _BLOCK), buckets)
    asked = blocks.where(F.col("kind") == WORDS).select("bucket", "block", "words")
    asked = asked.groupBy("bucket").applyInArrow(_asked, _ASKED)
    long_words = F.filter("words", lambda word: F.octet_length(word) >= LONG_WORD)
    folded = staged(
        asked.select(
            "bucket", fold_words(F.col("words"), path).alias("ids"), long_words.alias("long_words"),
            "blocks", "wanted",
        )
    )
    given = folded.mapInArrow(_given_back(path), _GIVEN)
    texts = blocks.where(F.col("kind") == TEXTS).select(
        "block", "doc_ids", "counts", "codes", "places"
    )
    return texts.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(
        _assembled(build), schema
    )


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of each row: its text's token ids, as integers.

    A null or empty text has no ids. Repeated rows give a row each, an empty table
    none."""
    return _encoded(docs, path, id_col, text_col, _ids, _ENCODED)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, bytes)`` of each row: the pieces of its ids, joined. Ids may end within a
    character, so these are bytes, not a text. Null ids give no bytes, and neither does
    an id that is null or that the vocabulary lacks. Repeated rows give a row each."""
    table = ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(table)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            ids = [np.array([i for i in own or [] if i is not None], np.int64) for own in lists]
            found = pa.array([decoder.decode(own) for own in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "bytes"])

    rows = coded.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")
    )
    return rows.mapInArrow(run, _DECODED)


def encode_digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each row: the digests of its
    ids as little-endian unsigned 32-bit integers and of the bytes they decode to.
    Rows are handled as by :func:`encode`."""
    return _encoded(docs, path, id_col, text_col, _digests(path), _CODED)
