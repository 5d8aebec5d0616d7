"""Net score and admission gate over metric results, long or wide.

Long results have one row per (type, id, metric) with either ``score`` or a
``device_scores`` map; wide results have one nullable column per metric.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.files import map_mean
from trustlake.functions.numeric import col, round3

KEY = ["type", "id"]


def effective_score() -> Column:
    """The score, or the mean over devices where a metric has one per device."""
    return F.coalesce(F.col("score"), map_mean("device_scores"))


def widen(results: DataFrame, metrics: Mapping[str, float] = C.METRIC_WEIGHTS) -> DataFrame:
    """One row per artifact, one column per metric.

    Conditional maxima combine on the map side, so an artifact with any number
    of rows sends one partial row per task.
    """
    score = effective_score()
    return results.groupBy(*KEY).agg(
        *[F.max(F.when(F.col("metric") == m, score)).alias(m) for m in metrics]
    )


def with_net_score(
    wide: DataFrame, columns: Mapping[str, Column | str], weights: Mapping[str, float]
) -> DataFrame:
    """Adds ``net_score``: weighted mean of the scores present, negative ones as zero.

    Terms are added one by one in the order of the weights: the sum, and with it
    the rounding at ties, is then independent of the partitioning.
    """
    net: Column = F.lit(0.0)
    used: Column = F.lit(0.0)
    for metric, weight in weights.items():
        score = col(columns[metric])
        net = net + F.when(score.isNull(), 0.0).otherwise(
            F.greatest(score, F.lit(0.0)) * F.lit(weight)
        )
        used = used + F.when(score.isNull(), 0.0).otherwise(F.lit(weight))
    mean = F.when(used > 0, net / used).otherwise(0.0)
    return wide.withColumn("_mean", mean).withColumn("net_score", round3("_mean")).drop("_mean")


def net_score(
    results: DataFrame, weights: Mapping[str, float] = C.METRIC_WEIGHTS
) -> DataFrame:
    wide = widen(results, weights)
    columns = {m: F.col(m) for m in weights}
    return with_net_score(wide, columns, weights).select(*KEY, "net_score")


def gate_failures(columns: Mapping[str, Column | str], threshold: float) -> Column:
    """Sorted names of the metrics that are missing or below the threshold."""
    failing = [
        F.when(col(c).isNull() | (col(c) < threshold), F.lit(m)) for m, c in sorted(columns.items())
    ]
    return F.filter(F.array(*failing), lambda m: m.isNotNull())


def gate(results: DataFrame, threshold: float = C.ADMISSION_THRESHOLD) -> DataFrame:
    """Admission of each artifact and the metrics it fails.

    Only models are gated. A metric without any row counts as failed.
    """
    wide = widen(results)
    failures = gate_failures({m: m for m in C.METRIC_WEIGHTS}, threshold)
    none = F.array().cast("array<string>")
    return wide.select(
        *KEY, F.when(F.col("type") == "model", failures).otherwise(none).alias("failures")
    ).select(*KEY, (F.size("failures") == 0).alias("admitted"), "failures")
