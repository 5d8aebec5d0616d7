"""Exact deduplication against a persistent index of text digests.

The index is a table bucketed and sorted by digest. A batch of documents is
reduced to digests in the scan, grouped, compared with the index by a
sort-merge anti-join that leaves the index where it lies, and what is new is
appended. Everything is DataFrame work.

Defined results
    null text          counts as empty; all empty texts are equal
    null doc_id        smaller than any number; a group without numbers has keep_id null
    equal doc_id, text all such rows are flagged alike; ``drop_copies`` leaves one
    equal doc_id only  separate documents
    empty table        no rows, and the index stays as it is
    further columns    not read by ``add``; passed on by ``drop_copies``, whatever their names
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm.common import cut, place, scratch_dir


def digest(text: str | Column = "text") -> Column:
    """SHA-256 of the text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text if isinstance(text, Column) else F.col(text),
                                     F.lit("")).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, and the document that stays for each.

    ``buckets`` is fixed when the table is made; the session's number of shuffle
    partitions is the default, so that batches are dealt the way the index lies.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"create table {name} (digest binary, keep_id bigint) using parquet "
                f"clustered by (digest) sorted by (digest) into {self.buckets} buckets "
                f"location '{path}'"
            )

    @classmethod
    def scratch(cls, spark: SparkSession) -> DigestIndex:
        """A new, empty index in the shared folder."""
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", scratch_dir(spark, "digest-index"))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, kept: DataFrame) -> None:
        """Add digests that the index does not hold yet."""
        (
            kept.select("digest", F.col("keep_id").cast("long").alias("keep_id"))
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )

    def add(self, docs: DataFrame) -> DataFrame:
        """Decide on a batch and add what is new.

        Returns a row for each document: ``doc_id, digest, keep_id, group_size,
        kept``. Of equal texts in the batch the largest doc_id stays, unless the
        index knows the text already: then its document stays. ``group_size``
        counts the rows of the batch.

        Copies are counted where they are scanned before they meet, and ``place``
        spreads the rows of a text that holds a third of all rows.
        """
        rows = cut(docs.select("doc_id", digest().alias("digest")), "digests")
        totals = rows.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        found = cut(totals, "groups")
        known = self.read()
        self.append(found.hint("merge").join(known, "digest", "left_anti"))
        settled = found.select("digest", "group_size").hint("merge").join(self.read(), "digest")
        return place(rows, settled, "digest", "doc_id").select(
            "doc_id", "digest", "keep_id", "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns.

    Only the keys of dropped rows are joined to the texts. Rows that repeat both
    doc_id and text are told apart by nothing, so one of them is taken.
    """
    index = index or DigestIndex.scratch(docs.sparkSession)
    decided = index.add(docs.select("doc_id", "text"))
    gone = cut(
        decided.groupBy("doc_id", "digest")
        .agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
        .where(~F.col("kept") | (F.col("rows") > 1)),
        "copies",
    )
    # Texts are joined to all these keys once, by a merge at every size, as dropped rows
    # grow with the input. The few repeats are a table of their own, so that Spark sees
    # its size and finds them without another shuffle of the texts.
    repeated = cut(gone.where("kept"), "repeated")
    mark, number, sha = (f"_{uuid.uuid4().hex}" for _ in range(3))
    rows = docs.withColumn(mark, digest(docs["text"]))

    def listed(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(number), F.col("digest").alias(sha))
        same = F.col("doc_id").eqNullSafe(F.col(number)) & (F.col(mark) == F.col(sha))
        return rows.join(keys, same, how)

    again = listed(repeated, "left_semi").dropDuplicates(["doc_id", mark])
    return listed(gone.hint("merge"), "left_anti").unionByName(again).drop(mark)
