"""Exact deduplication with a persistent digest index.

The index is a table of digests, bucketed and sorted by digest. A batch is
reduced to one row per digest, the digests the index lacks are found by a
sort-merge anti-join (the index side neither shuffles nor sorts), and only these
are appended, with the name of their batch. DataFrame operations throughout."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkrecon.llm.common import lower_ascii, semi_join_rows, staged

#: A digest is hot if it holds a thousandth of a batch, so at most so many are.
HOT_DIGESTS = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)`` of each row: SHA-256 of the text in UTF-8 with A-Z in
    lower case. A null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))


def digest_of(text: Column) -> Column:
    text = lower_ascii(F.coalesce(text, F.lit("")))
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


class DigestIndex:
    """A persistent index ``(digest, keep_id, group_size, batch)`` in the warehouse,
    empty at first."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(self) -> DataFrame | None:
        try:
            return self.spark.table(self.name)
        except AnalysisException:
            return None

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks."""
        index = self.read()
        if index is None:
            self.append(groups.withColumn("batch", F.lit("")).limit(0))
            index = self.read()
        return groups.join(index.select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Append ``(digest, keep_id, group_size, batch)`` of one row per new digest.
        Rows are dealt by digest first, so a task writes one file of one bucket."""
        columns = ["digest", "keep_id", "group_size", "batch"]
        (
            rows.select(columns).repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def add(self, batch: DataFrame, name: str | None = None) -> DataFrame:
        """Add ``digests()`` rows; return all of them with ``keep_id``,
        ``group_size`` and ``kept``.

        Of equal texts in a batch the row of the largest id stays (with repeated
        rows of that id, all of them are that id). A text that the index holds
        from an earlier batch keeps that batch's row, and none of this batch
        stays, not even a row delivered again. ``group_size`` counts the rows of the
        batch in which a text came first. A null id is kept only if its group has
        no other.

        Each batch counts as another, unless it has a ``name``: one that died is then
        repeated under its name, which gives the answer of its first run."""
        name = name or uuid.uuid4().hex
        groups = batch.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
        )
        batch_groups = staged(groups)
        self.append(self.fresh(batch_groups).withColumn("batch", F.lit(name)))
        # A hot digest is found by broadcast, all others by the buckets of the index.
        total = F.lit(batch.count())
        hot_keys = batch_groups.where(F.col("group_size") * HOT_DIGESTS >= total).select("digest")
        index = self.read().withColumn("fresh", F.col("batch") == name).drop("batch")
        hot = F.broadcast(index.join(F.broadcast(hot_keys), "digest", "left_semi"))
        found = batch.join(hot, "digest", "left")
        done = found.where("group_size is not null")
        rest = found.where("group_size is null").select("doc_id", "digest")
        cold = rest.join(index.hint("merge"), "digest", "inner")
        columns = ["doc_id", "digest", "keep_id", "group_size", "fresh"]
        rows = done.select(columns).unionByName(cold.select(columns))
        kept = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return rows.withColumn("kept", kept).drop("fresh")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Each row of ``docs`` as ``(doc_id, keep_id, group_size, kept, text_sha256)``.
    An empty table gives no rows; other columns are not read. ``batch`` names the
    batch, see :meth:`DigestIndex.add`."""
    marked = index.add(staged(digests(docs)), batch)
    return marked.select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_rows(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows that stay, with all their columns: one per text the index did not have.
    Null texts count as empty, repeated rows of an id as one row, an empty table gives
    no rows."""
    marked = index.add(staged(digests(docs, id_col, text_col)))
    kept = marked.where("kept").select("doc_id", F.col("digest").alias("mark")).distinct()
    return semi_join_rows(docs, id_col, digest_of(F.col(text_col)), kept)
