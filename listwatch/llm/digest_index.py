"""Exact deduplication against a persistent digest index.

The index is a table (digest, doc_id) bucketed and sorted by digest; a table beside it says how many buckets it has.  A batch of new data is reduced
to one row per digest, anti-joined with the index by sort-merge (the index side needs no shuffle) and
what is new is appended, one file per bucket.  Running a batch again appends nothing.
"""

import hashlib
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from listwatch.llm.common import id_key, staged
from listwatch.session import scratch_dir


@F.pandas_udf(T.BinaryType())
def text_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 of the text after lower-casing A-Z only; null counts as empty."""
    return texts.map(lambda t: hashlib.sha256((t or "").encode().lower()).digest())


@dataclass
class DigestIndex:
    """The index under ``path``; an existing one is opened with the bucket count it was made with, whatever is asked for."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def __post_init__(self):
        about = f"{self.path}/about"
        try:
            self.buckets = self.spark.read.schema("buckets int").parquet(about).agg(F.min("buckets")).first()[0] or self.buckets
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("ignore").parquet(about)
        # The count is in the name: a session that knows the table under another count makes its own entry.
        self.name = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}_{self.buckets}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, doc_id BIGINT) USING parquet "
                       f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (digest, doc_id) that the index lacks, each with its largest doc_id."""
        first = batch.groupBy("digest").agg(F.max("doc_id").alias("doc_id"))
        fresh = first.join(self.rows().hint("merge"), "digest", "left_anti")
        # Dealt by the bucket itself: one file a bucket, however many partitions the shuffle has.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        (fresh.repartition(self.buckets, bucket).sortWithinPartitions(bucket, "digest")
         .select("digest", "doc_id").write.insertInto(self.name))


def temporary_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An empty index in the scratch folder, for data that has to be unique in itself only."""
    return DigestIndex(spark, scratch_dir(spark, f"index-{uuid.uuid4().hex[:8]}"), buckets)


@dataclass(frozen=True)
class ExactDedup:
    """Keeps one row of those whose texts are equal after lower-casing A-Z: the one with the largest id.

    Ids are integers.  The batches are id ranges and the highest goes first, so the entry that the
    index gets for a text is the one with the largest id.  With an index that already has entries, a
    text it knows keeps its earlier document.

    Null and empty texts are equal.  A null id is smaller than any other.  Of rows that repeat both
    text and id one stays.  Other columns are carried along by ``keep_one``, whatever their names, and ignored otherwise.
    """

    batches: int = 2
    id: str = "doc_id"
    text: str = "text"

    def decisions(self, docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
        """id, digest, keep_id, group_size and kept for every row."""
        index = index or temporary_index(docs.sparkSession)
        rows = self._indexed(docs, index)
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        heads = index.rows().select("digest", F.col("doc_id").alias("keep_id")).join(sizes, "digest")
        heads = staged(heads, "heads")
        # By digest and id, with the copies of a row reduced first: a hot text is dealt by its ids.
        own = rows.groupBy("digest", id_key("id").alias("k")).agg(F.max("row").alias("keep_row"))
        best = own.join(heads.select("digest", id_key("keep_id").alias("k")), ["digest", "k"]).drop("k")
        # Written first: then both sides of the next join are plain scans and a hot text is split at run time.
        groups = staged(heads.join(best, "digest", "left"), "groups")
        return rows.join(groups, "digest").select(
            F.col("id").alias(self.id), "digest", "keep_id", "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))

    def keep_one(self, docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
        """Rows of ``docs`` that stay, with all their columns."""
        index = index or temporary_index(docs.sparkSession)
        self._indexed(docs, index)
        # The columns travel in a struct, so helper columns clash with none of them.
        # A digest is never null, and said so: a test for null would compute it again, in workers of its own beside the first ones.
        digest = F.coalesce(text_digest(F.col(self.text)), F.lit(b""))
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("digest"), id_key(self.id).alias("k"))
        kept = index.rows().select("digest", id_key("doc_id").alias("k"))
        # The id is part of the key, so copies of a hot text are not sent to one task.
        return rows.join(kept.hint("shuffle_merge"), ["digest", "k"], "left_semi").dropDuplicates(["digest", "k"]).select("row.*")

    def _indexed(self, docs: DataFrame, index: DigestIndex) -> DataFrame:
        """(row, id, digest) of every row, after the index has taken them in."""
        rows = docs.select(F.col(self.id).cast("long").alias("id"), text_digest(F.col(self.text)).alias("digest"))
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
        low, high = rows.agg(F.min("id"), F.max("id")).first()
        step = 1 if low is None else (high - low) // self.batches + 1
        for k in reversed(range(self.batches)):
            part = F.lit(low if low is not None else 0) + k * step
            inside = (F.col("id") >= part) & (F.col("id") < part + step)
            if k == 0:
                inside = (F.col("id") < part + step) | F.col("id").isNull()
            index.add(rows.where(inside).select("digest", F.col("id").alias("doc_id")))
        return rows
