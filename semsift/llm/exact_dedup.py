"""Exact de-duplication against a persistent digest index (operator 2).

The index is a Parquet table bucketed and sorted by the digest of the normalised
text. A new batch is reduced to its distinct digests, anti-joined against the index
bucket by bucket (the index is never shuffled), and only unseen digests are appended.
Texts never move: a row travels as its id and 32-byte digest.

Texts are equal when identical after replacing every ``[\\x20\\x09-\\x0D]+`` by one
space. A null text counts as empty. Rows with a null id lose to rows with one; rows
with the same text and id are ordered by their position in the staged table, so
exactly one row of every group stays. An empty table gives an empty result and an
empty index.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semsift.llm.common import SPACES, parallelism, pick, stage, text_or_empty
from semsift.session import scratch_path

INDEX_SCHEMA = "digest binary, keep_id long, keep_row long, first_batch int, delivery string"


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, digest)`` of every document, staged so that ``row`` is fixed."""
    norm = F.regexp_replace(text_or_empty("_text"), SPACES, " ")
    return stage(pick(docs, _id=id_col, _text=text_col).select(
        F.monotonically_increasing_id().alias("row"), F.col("_id").cast("long").alias("id"),
        F.unhex(F.sha2(norm, 256)).alias("digest")), "digest-rows")


class DigestIndex:
    """A digest table in ``path``: ``buckets`` buckets, each file sorted by digest. ``delivery``
    names this use of it: digests that it adds are its own, others were there before."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.delivery = uuid.uuid4().hex
        self.table = f"digest_index_{self.delivery}"
        spark.sql(f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, batch: DataFrame, batch_no: int) -> None:
        """Adds the digests of ``batch`` (``row, id, digest``) that the index lacks, each
        with the smallest id that carries it."""
        first = (batch.groupBy("digest")
                 .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
                 .select("digest", F.col("first.id").alias("keep_id"),
                         F.col("first.row").alias("keep_row"), F.lit(batch_no).alias("first_batch"),
                         F.lit(self.delivery).alias("delivery")))
        new = first.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        # rows of a bucket arrive together and sorted, so every append adds one file a bucket
        (new.repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path)
         .saveAsTable(self.table))
        self.spark.catalog.refreshTable(self.table)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """``(row, id, digest, keep_id, keep_row, delivery, group_size)`` for rows whose digests are
        indexed.

        Group sizes are summed before the join, so a digest that a third of all rows
        share meets the index as one row; rows then pick up their group's verdict in a
        join that adaptive execution can split."""
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        groups = sizes.join(self.rows(), "digest").select(
            "digest", "keep_id", "keep_row", "delivery", "group_size")
        # written, so that the join has exchanges of its own on both sides and can be split
        return rows.join(stage(groups, "digest-groups"), "digest")

    def drop(self) -> None:
        """Forgets the table's name in this session; the files in ``path`` stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                buckets: int | None = None, index_path: str | None = None, loads: int = 2) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The rows enter a new index in ``loads`` appends by ascending id ranges (null ids
    last), as deliveries of a growing corpus would, so the first one to hold a text
    also holds its smallest id. The index has as many buckets as the session has shuffle
    partitions unless ``buckets`` says otherwise, so an append writes one file a bucket.
    ``index_path`` may hold the index of earlier deliveries: a text that is known from one of
    them is kept in none of these rows, and ``keep_id`` is the row that stayed then;
    ``group_size`` counts the rows of this delivery."""
    spark = docs.sparkSession
    rows = digest_rows(docs, id_col, text_col)
    lo, hi = rows.agg(F.min("id"), F.max("id")).first()
    index = DigestIndex(spark, index_path or scratch_path(spark, "digest-index"),
                        buckets or parallelism(spark))
    lo, hi = (0, 0) if lo is None else (lo, hi)
    part = F.floor((F.col("id") - F.lit(lo)) * F.lit(loads) / F.lit(hi - lo + 1))
    load = F.when(F.col("id").isNull(), loads).otherwise(part)
    for n in range(loads + 1):
        index.append(rows.where(load == n), n)
    kept = (F.col("row") == F.col("keep_row")) & F.coalesce(F.col("delivery") == index.delivery, F.lit(False))
    return index.resolve(rows).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
