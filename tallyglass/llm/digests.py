"""Exact deduplication by a persistent index of text digests.

The index is a table bucketed and sorted by digest, with one partition per batch of documents.  A batch is reduced to one row
per digest, rows whose digest the index already has leave by a sort-merge anti-join that reads the index in place, and the
rest become the batch's partition.  A batch that is run again replaces its own partition, so a lost job is just repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm.common import id_and_text, stored
from tallyglass.session import fresh_path
from tallyglass.sources.tables import create_bucketed_snapshots, drop_table, path_exists

#: Groups that hold more than one row in this many are joined by broadcast; there are fewer of them than this number.
HOT_SHARE = 20_000
#: Digests a bucket of a new index is meant to hold.
BUCKET_ROWS = 2_000_000
ENTRY = T.StructType(
    [T.StructField("digest", T.BinaryType()), T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("batch", T.IntegerType())]
)


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; a NULL text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, a number of the row and the SHA-256 ``digest`` of its normalised text, stored."""
    rows = id_and_text(docs, id_col, text_col)
    digest = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    return stored(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), digest.alias("digest")), "digests")


def _first(doc_id: str = "doc_id", row: str = "row") -> Column:
    """The row that stays: the smallest id, a NULL id after all others, then the first row."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col(row).alias("row")))


class DigestIndex:
    """All digests seen so far, each with the row that brought it first.

    ``path`` is the index's folder, in a store that all executors share; the same path and ``n_buckets`` open it again in
    another session.  Rows: ``digest``, ``doc_id`` and ``row`` of the first document, and the ``batch`` it came with.
    """

    def __init__(self, spark: SparkSession, path: str, n_buckets: int):
        self.spark, self.path, self.n_buckets = spark, path, n_buckets
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        known = path_exists(spark, path)
        create_bucketed_snapshots(spark, self.table, ENTRY, "batch", ["digest"], n_buckets, path)
        if known:
            spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def rows(self, before: int | None = None) -> DataFrame:
        """The index's rows, or those of the batches before one."""
        entries = self.spark.table(self.table)
        return entries if before is None else entries.filter(F.col("batch") < before)

    def unseen(self, rows: DataFrame, batch: int) -> DataFrame:
        """Of ``rows`` as :func:`digests` gives them, the one that stays of each digest that no batch before this has."""
        groups = rows.groupBy("digest").agg(_first().alias("first"))
        known = self.rows(batch).select("digest").hint("merge")
        return groups.join(known, "digest", "left_anti").select("digest", "first.doc_id", "first.row")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Append the unseen digests of ``rows`` as partition ``batch``; running a batch again replaces it.

        Batches have ascending numbers, and one is run again before later ones are.  The new rows are staged first, as a
        table is not overwritten by what reads it.
        """
        new = stored(self.unseen(rows, batch), "unseen")
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = {int(batch)}) SELECT digest, doc_id, row FROM {{new}}",
            new=new.repartition(self.n_buckets, "digest"),
        )

    def close(self) -> None:
        """Drop the session's name for the index; its files stay."""
        drop_table(self.spark, self.table)


def group_report(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of ``rows``, all of which the index has seen: which row stays of its group, and the group's size.

    Sizes are counted with a map-side combine.  The digests of ordinary groups join their rows by merge; those of groups
    with more than one row in ``HOT_SHARE``, fewer than ``HOT_SHARE`` by that bound, are broadcast.
    """
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    first = index.rows().select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")).hint("merge")
    groups = stored(sizes.join(first, "digest"), "groups")
    is_hot = F.col("group_size") * HOT_SHARE > F.lit(rows.count())
    hot = F.broadcast(groups.filter(is_hot))
    ordinary = rows.join(F.broadcast(groups.filter(is_hot).select("digest")), "digest", "left_anti")
    ordinary = ordinary.join(groups.filter(~is_hot).hint("merge"), "digest")
    both = rows.join(hot, "digest").unionByName(ordinary)
    return both.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, batches: int = 4, path: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """One row per document: the document that stays of those with the same normalised text, and how many there are.

    Documents come to a new index in ``batches`` by ascending id, so the first seen of equal texts has the smallest id.  A
    NULL text is empty, and all empty texts are equal; a NULL id counts as larger than any other, and of rows with the same
    id and text the first stays.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = digests(docs)
    cuts = rows.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    if n_buckets is None:
        n_buckets = max(8, -(-rows.count() // BUCKET_ROWS))
    index = DigestIndex(spark, path or fresh_path(spark, "digest-index"), n_buckets)
    for number, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        here = F.lit(True) if low is None else F.col("doc_id") >= low
        here = here & (F.col("doc_id") < high) if high is not None else F.col("doc_id").isNull() | here
        index.add(rows.filter(here), number)
    return group_report(rows, index)


EXACT_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
