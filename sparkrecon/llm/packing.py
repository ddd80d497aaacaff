"""Packing token ids into windows by the sum-of-squares rule.

Documents of a task are placed one after the other, as they come. Whole windows
are cut off a long document first. The rest goes to the fill level that makes the
sum of squared counts of partially filled windows smallest, a new window counting
as level 0; the counts stand in an array by level. That keeps the levels mixed, so
that most rests find a window they complete.

Windows still partial at the end of a task (or beyond ``OPEN`` of them) are closed
by cutting: pieces of the least filled ones fill the gaps of the fullest. One
window per task remains, and it is cut at powers of two, which need no padding.
Tasks need no data of each other, so nothing shuffles."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.word_tokens import encoder

WINDOW, END_ID = 4096, 2
#: Most partial windows a task holds, at 16 KB each.
OPEN = 2048
#: Sequence numbers of a task start at its number times this.
SEQUENCES = 1 << 40
#: Rows and bytes of ids of an output batch.
ROWS, BATCH_BYTES = 20_000, 8 << 20


class Piece:
    """Ids ``start`` to ``start + length`` of a document."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id, start: int, ids: bytes, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        at = 4 * length
        return (
            Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens),
            Piece(self.doc_id, self.start + length, self.ids[at:], self.doc_tokens),
        )


class Packer:
    """Packs the documents of one task; ``add`` and ``close`` yield full sequences as
    lists of pieces."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)  # partial windows by level
        self.levels: list[int] = []  # levels with such windows, ascending
        self.open: dict[int, list[list[Piece]]] = {}
        self.partial = 0

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        self.partial -= 1
        sequence = self.open[level].pop()
        if not self.counts[level]:
            del self.open[level]
            self.levels.pop(bisect_right(self.levels, level) - 1)
        return sequence

    def _put(self, level: int, sequence: list[Piece]) -> None:
        if not self.counts[level]:
            insort(self.levels, level)
            self.open[level] = []
        self.counts[level] += 1
        self.partial += 1
        self.open[level].append(sequence)

    def _level_for(self, size: int) -> int:
        """The level whose change of the sum of squares is least: moving a window from
        level h to h + size changes it by 2 (N[h + size] - N[h]) + 2, completing one by
        1 - 2 N[h], opening one by 2 N[size] + 1. Ties go to the fullest window."""
        best, least = 0, 2 * int(self.counts[size]) + 1
        room = bisect_right(self.levels, self.window - size)
        if room:
            levels = np.array(self.levels[:room])
            change = 2 * (self.counts[levels + size] - self.counts[levels]) + 2
            if levels[-1] + size == self.window:
                change[-1] -= 1
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= least:
                best = int(levels[at])
        return best

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece) >= self.window:
            whole, piece = piece.cut(self.window)
            yield [whole]
        size = len(piece)
        if not size:
            return
        level = self._level_for(size)
        sequence = self._take(level) if level else []
        sequence.append(piece)
        if level + size == self.window:
            yield sequence
        else:
            self._put(level + size, sequence)
            if self.partial > self.most_open:
                yield from self._fill(self.most_open // 2)

    def _fill(self, keep: int) -> Iterator[list[Piece]]:
        """Complete windows by pieces of the least filled ones until ``keep`` are left."""
        while self.partial > max(keep, 1):
            level = self.levels[-1]
            sequence = self._take(level)
            while level < self.window and self.partial:
                low = self.levels[0]
                donor = self._take(low)
                piece = donor.pop()
                gap = self.window - level
                if len(piece) > gap:
                    first, rest = piece.cut(gap)
                    sequence.append(first)
                    donor.append(rest)
                    level, low = self.window, low - gap
                else:
                    sequence.append(piece)
                    level, low = level + len(piece), low - len(piece)
                if low:
                    self._put(low, donor)
            if level < self.window:
                self._put(level, sequence)
                return
            yield sequence

    def close(self) -> Iterator[list[Piece]]:
        yield from self._fill(1)
        if self.partial:
            level = self.levels[0]
            rest = self._take(level)
            for bit in reversed(range(level.bit_length())):
                size = 1 << bit
                if level & size:
                    sequence = []
                    while size:
                        piece = rest.pop(0)
                        if len(piece) > size:
                            piece, left = piece.cut(size)
                            rest.insert(0, left)
                        sequence.append(piece)
                        size -= len(piece)
                    yield sequence


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per piece: ``(doc_id, start, length, ids, ids_crc32, doc_tokens,
    sequence_id, offset)``. ``ids`` holds ``length`` ids as little-endian integers of
    32 bits. ``path`` is the vocabulary file.

    Each document's ids end with ``END_ID``, so an empty or null text has one id. Null
    and repeated ids are packed like any other row; an empty table gives no rows."""
    kind = dict(docs.dtypes)[id_col]
    fields = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    schema = f"doc_id {kind}, {fields}"
    names = ["doc_id", *(f.split()[0] for f in fields.split(", "))]
    end = np.array([END_ID], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(path), Packer()
        number = TaskContext.get().partitionId() * SEQUENCES
        rows: list[tuple] = []
        held, id_type = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows, strict=True))
            kinds = [id_type, *(pa.binary() if n == "ids" else pa.int64() for n in names[1:])]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, names)

        def write(sequences: Iterator[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    rows.append((p.doc_id, p.start, len(p), p.ids, p.doc_tokens, number, offset))
                    offset += len(p)
                held += 4 * offset
                number += 1
                if len(rows) >= ROWS or held >= BATCH_BYTES:
                    yield flush()

        for batch in batches:
            ids, texts = batch.columns
            id_type = ids.type
            for doc_id, text in zip(ids.to_pylist(), texts.cast(pa.binary()), strict=True):
                found = own.encode(text.as_py() or b"") + end
                yield from write(packer.add(Piece(doc_id, 0, found, len(found) // 4)))
        yield from write(packer.close())
        if rows:
            yield flush()

    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        packed, schema
    )
    return pieces.select(
        "doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )
