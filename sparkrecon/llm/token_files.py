"""Token ids in flat binary files, with 64-bit document offsets.

Format, in one folder, per part ``p`` (parts are ascending ranges of ids):

* ``ids-p-*.bin``: the ids of its documents, one after the other, as unsigned
  little-endian integers of 16 bits if the vocabulary fits, else 32;
* ``docs-p-*.bin``: the documents' ids, signed 64-bit (a null id is the least
  64-bit integer, which therefore can't be an id);
* ``offsets-p-*.bin``: unsigned 64-bit, one more than documents: where each document
  begins in the whole corpus, and where the part ends.

A task streams a part's sorted documents into its files, so memory doesn't grow
with a part. Parts know their place in the corpus by prefix sums over the parts'
token counts. File names are unique to an attempt, and only those of the attempt
that Spark accepts stand in the manifest, so a lost executor or a repeated task
leaves no wrong file in use. Files are memory-mapped where the folder is local to
the reader (or mounted), else read in ranges."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrecon.llm.common import id_ranges, parts_for, range_of, shared_folder, staged
from sparkrecon.llm.word_tokens import encoder

END_ID = 1
#: Bytes of compressed input of one part, and most parts.
PART_BYTES, MOST_PARTS = 4 << 20, 10_000
NULL_ID = -(2**63)
#: Rows of an output batch.
ROWS = 20_000

_MANIFEST = "part int, name string, n_docs long, n_tokens long"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class FlatFile:
    """A flat file of integers, memory-mapped if it is local."""

    def __init__(self, folder: str, name: str, kind: str):
        system, path = _place(folder)
        self.kind = np.dtype(kind)
        self.mapped = self.file = None
        if isinstance(system, fs.LocalFileSystem):
            size = system.get_file_info(f"{path}/{name}").size
            self.mapped = (
                np.memmap(f"{path}/{name}", self.kind, "r") if size else np.empty(0, self.kind)
            )
        else:
            self.file = system.open_input_file(f"{path}/{name}")

    def read(self, start: int, stop: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:stop]
        size = self.kind.itemsize
        data = self.file.read_at((stop - start) * size, start * size)
        return np.frombuffer(data, self.kind)


def write_tokens(
    docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the files; return the manifest ``(part, name, n_docs, n_tokens, base,
    offsets)``, with the names of a part's offsets and of its other files.

    Ids are those of the vocabulary at ``path``, each document's end with ``END_ID``.
    A null text counts as empty, a null id comes first; rows of one id follow in the
    order of their texts. An empty table writes nothing."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = min(parts_for(rows, PART_BYTES), MOST_PARTS)
    bounds = id_ranges(rows, "doc_id", parts)
    dealt = (
        rows.withColumn("part", range_of(F.col("doc_id"), bounds))
        .repartitionById(parts, "part")
        .sortWithinPartitions("part", "doc_id", "text")
        .select("part", "doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(folder)
        system.create_dir(root, recursive=True)
        own = encoder(path)
        narrow = own.tokenizer.get_vocab_size() <= 1 << 16
        end = struct.pack("<I", END_ID)
        done: list[tuple] = []
        part, files, count, total = None, None, 0, 0

        def start(new: int) -> None:
            nonlocal part, files, count, total
            part, count, total = new, 0, 0
            name = f"{new:06d}-{uuid.uuid4().hex}"
            streams = [
                system.open_output_stream(f"{root}/{what}-{name}.bin")
                for what in ("ids", "docs", "lengths")
            ]
            files = (name, *streams)

        def finish() -> None:
            if files:
                for stream in files[1:]:
                    stream.close()
                done.append((part, files[0], count, total))

        for batch in batches:
            columns = zip(
                batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(),
                batch.column("text").cast(pa.binary()), strict=True,
            )
            for at, doc_id, text in columns:
                if at != part:
                    finish()
                    start(at)
                ids = np.frombuffer(own.encode(text.as_py() or b"") + end, "<u4")
                files[1].write((ids.astype("<u2") if narrow else ids).tobytes())
                files[2].write(struct.pack("<q", NULL_ID if doc_id is None else doc_id))
                files[3].write(struct.pack("<q", len(ids)))
                count, total = count + 1, total + len(ids)
        finish()
        if done:
            yield _batch(done, ["part", "name", "n_docs", "n_tokens"])

    written = staged(dealt.mapInArrow(write, _MANIFEST))
    # At most MOST_PARTS rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    based = written.withColumn("base", base)

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(folder)
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                # A name of this attempt: another one may write the same part's offsets.
                names.append(f"{row['part']:06d}-{uuid.uuid4().hex}")
                lengths = FlatFile(folder, f"lengths-{row['name']}.bin", "<i8")
                sums = np.zeros(row["n_docs"] + 1, "<u8")
                np.cumsum(lengths.read(0, row["n_docs"]), out=sums[1:])
                with system.open_output_stream(f"{root}/offsets-{names[-1]}.bin") as stream:
                    stream.write((sums + np.uint64(row["base"])).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string())], [*batch.schema.names, "offsets"]
            )

    tasks = based.repartitionById(max(1, min(parts, 1000)), "part")
    return staged(tasks.mapInArrow(offsets, f"{_MANIFEST}, base long, offsets string"))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [list(column) for column in zip(*rows, strict=True)]
    kinds = {"part": pa.int32(), "name": pa.string()}
    arrays = [pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(columns, names, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def read_tokens(manifest: DataFrame, folder: str, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files alone.
    The CRC is that of the ids as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for row in batch.to_pylist():
                ids = FlatFile(folder, f"ids-{row['name']}.bin", kind)
                docs = FlatFile(folder, f"docs-{row['name']}.bin", "<i8")
                starts = FlatFile(folder, f"offsets-{row['offsets']}.bin", "<u8")
                for first in range(0, row["n_docs"], ROWS):
                    last = min(first + ROWS, row["n_docs"])
                    found = []
                    at = starts.read(first, last + 1).astype(np.int64)
                    for doc, a, b in zip(docs.read(first, last), at[:-1], at[1:], strict=True):
                        own = ids.read(a - row["base"], b - row["base"]).astype("<u4")
                        doc_id = None if doc == NULL_ID else int(doc)
                        found.append((doc_id, int(a), int(b - a), zlib.crc32(own.tobytes())))
                    yield _batch(found, names)

    tasks = manifest.repartitionById(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 8), "part")
    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write all documents to a new folder of the shared storage and read them back."""
    folder = shared_folder(docs.sparkSession)
    return read_tokens(write_tokens(docs, folder, path), folder, path)
