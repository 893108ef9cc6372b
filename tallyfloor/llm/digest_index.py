"""Exact deduplication against a persistent index of digests."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import keyed_join, normalised, scratch, settle, without


class DigestIndex:
    """A table of text digests, bucketed and sorted by digest, that outlives the session.

    A row is a digest with the key of the document that stays. ``append`` takes new data: one row for each digest
    (partial maxima, so a group of copies never meets in a task) goes through a sort-merge anti-join against
    the index, whose bucketed side is not shuffled, and what is new is appended with the same buckets. Of equal
    texts the earliest batch wins, within a batch the largest ``doc_id``, and of rows that even share the id the
    one with the largest tag. Opening an index at the same path again in another session continues it.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT, keep_tag BIGINT, batch INT"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({self.SCHEMA}) USING parquet LOCATION '{path}' "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, digests: DataFrame, batch: int) -> None:
        """``digests``: digest, doc_id, tag (longs, the tag unique). Adds the digests that are new."""
        new = digests.groupBy("digest").agg(F.max(F.struct("doc_id", "tag")).alias("k"))
        new = new.select("digest", F.col("k.doc_id").alias("keep_id"), F.col("k.tag").alias("keep_tag"), F.lit(batch).alias("batch"))
        fresh = new.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        fresh = settle(fresh)  # a table is not read and written in one job
        (fresh.repartition(self.buckets, "digest").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name))

    def close(self) -> None:
        """Forgets the name in this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest_rows(docs: DataFrame) -> DataFrame:
    """tag, doc_id, digest: SHA-256 of the whole text with A-Z lower-cased (null: empty). Written once, so tags hold."""
    d = docs.select(
        F.monotonically_increasing_id().alias("tag"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
    )
    return settle(d)


def build(digests: DataFrame, path: str, batches: int = 2, buckets: int = 64) -> DigestIndex:
    """Feeds documents to an index in ``batches`` ranges of ``doc_id``, the largest first, so that over all
    batches the largest ``doc_id`` stays. Rows without an id come last."""
    index = DigestIndex(digests.sparkSession, path, buckets)
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    step = max(1, -(-(high - low + 1) // batches))
    arrival = F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / step), F.lit(batches - 1))
    for k in range(batches):
        index.append(digests.where(arrival == k), k)
    return index


def decisions(docs: DataFrame, path: str | None = None, batches: int = 2, buckets: int = 64) -> DataFrame:
    """For each row of ``docs``: tag, doc_id, digest, keep_id, group_size, kept. Texts are equal when identical after
    lower-casing A-Z; one row of each group is kept, by the rules of :class:`DigestIndex`.

    Null texts count as empty, null ids rank below all others, repeated rows form a group of which one is kept, and
    an empty table gives no rows. Other columns are ignored."""
    digests = digest_rows(docs)
    index = build(digests, path or scratch(docs.sparkSession, "digest-index"), batches, buckets)
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = settle(index.table().select("digest", "keep_id", "keep_tag").join(sizes.hint("merge"), "digest"))
    index.close()
    out = keyed_join(digests, groups, "digest", "group_size", digests.count())
    return out.select("tag", "doc_id", "digest", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"))


def deduplicate(docs: DataFrame, path: str | None = None, batches: int = 2, buckets: int = 64) -> DataFrame:
    """``docs`` with one row of each group of equal texts and all its columns.

    The narrow decisions give the ids that go; only they are joined back. Where an id occurs more than once (repeated rows) the
    rows are told apart by digest and content, and of completely equal ones a single one stays."""
    chosen = settle(decisions(docs, path, batches, buckets))
    repeats = chosen.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count() > 0
    if not repeats:
        gone = settle(chosen.where("NOT kept").select(F.col("doc_id").alias("_id")))
        return without(docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_id")), gone, "_id").select("row.*")
    keys = chosen.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    seen = docs.withColumn("_d", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)))
    same = (seen["_d"] == keys["_digest"]) & seen["doc_id"].cast("long").eqNullSafe(keys["_id"])
    first = seen.join(keys, same, "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    pick = first.groupBy("doc_id", "_d").agg(F.min(F.struct("text", *rest)).alias("_row"))
    return pick.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, keep_id, group_size, kept, text_sha256."""
    return decisions(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id,
  sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
