"""Facts of texts, kept by content: a text is judged once, wherever and whenever it lands.

A table holds the facts under the SHA-256 of the text. It is bucketed by digest,
so new digests are told from known ones without moving it. The version of the
rules is part of its place: other rules begin a new table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.operators.joins import dealt_join
from trustlake.sources.scratch import saved

# To be raised when rules change that are not in the constants.
RULES = 1


@dataclass(frozen=True)
class Kind:
    """A kind of facts: what they are, and how they are read off a column ``text``."""

    name: str
    schema: str
    judge: Callable[[DataFrame], DataFrame]


def version() -> str:
    """Changes with every constant of the rules."""
    rules = sorted((k, repr(v)) for k, v in vars(C).items() if k.isupper())
    return hashlib.sha256(repr((RULES, rules)).encode()).hexdigest()[:12]


def digest(text: str = "text") -> Column:
    """The SHA-256 of a text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


class FactStore:
    """Tables of facts below a folder of their own, one for each kind."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _name(self, kind: Kind) -> tuple[str, str]:
        """The name and the place of the table, which is made if it is not there."""
        path = f"{self.root}/{kind.name}-{version()}"
        name = f"facts_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"create table {name} (digest binary, {kind.schema}) using parquet "
                f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{path}'"
            )
        return name, path

    def table(self, kind: Kind) -> DataFrame:
        """One row per digest. Runs that overlap may have judged a text twice, alike."""
        return self.spark.table(self._name(kind)[0]).dropDuplicates(["digest"])

    def learn(self, kind: Kind, files: DataFrame, keys: Sequence[str], wanted: DataFrame | None = None) -> int:
        """Judge each text of ``files`` that was never judged; how many there were.

        ``keys`` tell the files apart; ``wanted`` (keys and ``digest``) names those that
        matter, all by default. Digests are compared first, so the texts that are
        judged are those of one file for each new digest.
        """
        keys = list(keys)
        marked = files.select(*keys, digest().alias("digest")) if wanted is None else wanted
        first = marked.groupBy("digest").agg(F.min(F.struct(*keys)).alias("_key"))
        name, path = self._name(kind)
        unseen = first.join(self.spark.table(name).select("digest"), "digest", "left_anti")
        once = saved(unseen.select("digest", "_key.*"), "unseen-texts")
        texts = files.select(*keys, "text", digest().alias("digest")).join(once, [*keys, "digest"], "left_semi")
        count = once.count()
        if not count:
            return 0
        judged = kind.judge(texts).select(
            "digest", *[f.name for f in self.spark.table(name).schema.fields if f.name != "digest"]
        )
        (
            judged.repartition(self.buckets, "digest")
            .write.format("parquet").mode("append")
            .bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", path).saveAsTable(name)
        )
        return count

    def facts(self, kind: Kind, marked: DataFrame, by: str) -> DataFrame:
        """``marked`` (with ``digest``) and the facts of its texts, in place of the digest.

        A text that a third of all files hold is spread by a hash of ``by``.
        ``marked`` is read twice; pass a scan.
        """
        return dealt_join(marked, self.table(kind), ["digest"], by).drop("digest")
