"""Joins to narrow tables: one plan, whatever the sizes.

Adaptive execution picks the join by bytes and splits the partitions of a hot or
missing key on the side of the facts. Nothing is counted beforehand, so building a
join starts no job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Build = Callable[[DataFrame], DataFrame]


def lookup_join(facts: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a narrow table with one row per key."""
    return facts.join(table, list(keys), "left")


def join_built(facts: DataFrame, keys: Sequence[str], build: Build) -> DataFrame:
    """Left join to a table that ``build`` makes for the distinct keys in use.

    ``facts`` is read twice; pass a scan.
    """
    wanted = facts.select(*keys).dropna().distinct()
    return lookup_join(facts, build(wanted), keys)


# Cells into which the rows of every key are dealt.
CELLS = 64


def dealt_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: str | Column) -> DataFrame:
    """Inner join to a table with few rows per key that is large or lies in buckets.

    The rows of a key are dealt into ``CELLS`` cells by a hash of ``by``. The cells meet
    the table, which stays where it lies, and then the rows meet their cells, so a
    key with a third of all rows is spread. ``rows`` is read twice; pass a scan.
    """
    cell = F.pmod(F.xxhash64(by), F.lit(CELLS)).cast("int")
    dealt = rows.withColumn("_cell", cell)
    cells = dealt.select(*keys, "_cell").distinct().join(table, list(keys))
    return dealt.join(cells, [*keys, "_cell"]).drop("_cell")


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: str | Column) -> DataFrame:
    """Inner join of which a few bytes make many rows.

    The rows of a key are dealt into ``CELLS`` cells by a hash of ``by``, and every cell
    gets the table's rows of its key, one after another. The number of tasks is that of
    a shuffle, however few the bytes.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = F.pmod(F.xxhash64(by), F.lit(CELLS)).cast("int")
    cells = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))
    dealt = rows.withColumn("_cell", cell).repartition(tasks, *keys, "_cell")
    copies = table.withColumn("_cell", cells).repartition(tasks, *keys, "_cell")
    return copies.join(dealt.hint("merge"), [*keys, "_cell"]).drop("_cell")


def grown_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: str | Column) -> DataFrame:
    """As ``spread_join``, for tables with many keys that few rows have: the table's rows go to
    the cells of their key that hold rows, no others. ``rows`` is read twice; pass a scan.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = F.pmod(F.xxhash64(by), F.lit(CELLS)).cast("int")
    dealt = rows.withColumn("_cell", cell)
    copies = dealt.select(*keys, "_cell").distinct().join(table, list(keys)).repartition(tasks, *keys, "_cell")
    return copies.join(dealt.repartition(tasks, *keys, "_cell").hint("merge"), [*keys, "_cell"]).drop("_cell")
