"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import cut

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every linked node; the root is the least of its component.

    ``links`` has columns ``a, b`` of any ordered type. Each round hangs the
    larger neighbours of every node on its least neighbour, then the smaller
    ones, which takes a number of rounds of the order of the logarithm squared.
    Only the links travel; least neighbours are partial aggregates, and the join
    to them is one that adaptive execution splits where a node has many links.
    """

    def down(edges: DataFrame) -> DataFrame:
        return edges.where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()

    def hang(edges: DataFrame, least: DataFrame) -> DataFrame:
        joined = edges.join(least, "a")
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b"))

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    edges = cut(down(links), "links")
    before = state(edges)
    for _ in range(ROUNDS):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = down(hang(both.where("b > a"), least))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = hang(large, least).unionAll(least.toDF("a", "b"))
        edges = cut(down(small), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
