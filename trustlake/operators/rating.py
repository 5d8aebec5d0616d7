"""Rating view of stored records: results JSON to flat scores and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake import constants as C

SCALAR_METRICS = [m for m in C.METRIC_WEIGHTS if m != "size_score"]


def rating_view(registry: DataFrame) -> DataFrame:
    """Flat rating record per model.

    A result is normally ``[score, latency]``. A bare number is a score without
    latency; anything else, a null score included, reads as 0. The results text
    is parsed once into a variant.
    """
    parsed = registry.where(F.col("type") == "model").select(
        "type", "id", "name", "net_score", F.try_parse_json("results").alias("_v")
    )

    def entry(metric: str) -> Column:
        return F.try_variant_get("_v", f"$.{metric}", "variant")

    def kind(metric: str) -> Column:
        return F.schema_of_variant(entry(metric))

    def score(metric: str) -> Column:
        listed = F.try_variant_get("_v", f"$.{metric}[0]", "double")
        number = F.when(
            kind(metric).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"),
            F.try_variant_get("_v", f"$.{metric}", "double"),
        )
        return F.coalesce(listed, number, F.lit(0.0))

    def latency(metric: str) -> Column:
        return F.coalesce(F.try_variant_get("_v", f"$.{metric}[1]", "long"), F.lit(0))

    def device(name: str) -> Column:
        value = F.try_variant_get("_v", f"$.size_score[0].{name}", "double")
        return F.coalesce(value, F.lit(0.0)).alias(name)

    columns: list[Column] = []
    for metric in SCALAR_METRICS:
        columns += [score(metric).alias(metric), latency(metric).alias(f"{metric}_latency")]
    return parsed.select(
        "id",
        "name",
        F.lit("model").alias("category"),
        "net_score",
        F.lit(0).cast("long").alias("net_score_latency"),
        *columns,
        F.lit(C.TREE_SCORE).alias("tree_score"),
        F.lit(0).cast("long").alias("tree_score_latency"),
        F.struct(*[device(d) for d in C.DEVICES]).alias("size_score"),
        latency("size_score").alias("size_score_latency"),
    )


def subscores(ratings: DataFrame) -> DataFrame:
    """Numeric scores as (id, key, value) rows, without net score and latencies."""
    return ratings.unpivot(["id"], [*SCALAR_METRICS, "tree_score"], "key", "value")


def device_rows(ratings: DataFrame) -> DataFrame:
    """Size scores as (id, device, score) rows."""
    scores = F.map_from_arrays(
        F.array(*map(F.lit, C.DEVICES)), F.array(*[F.col(f"size_score.{d}") for d in C.DEVICES])
    )
    return ratings.select("id", F.explode(scores).alias("device", "score"))
