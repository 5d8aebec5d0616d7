"""Registry state as an append-only change log, and the current view of it.

A change is a record with ``op`` (``put``, ``delete`` or ``reset``) and a
strictly growing ``seq``. Nothing is rewritten in place: an upsert, a deletion
or a reset appends rows, and concurrent writers cannot lose each other's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.functions.numeric import col
from trustlake.operators.joins import lookup_join

KEY = ["type", "id"]


def last_wins(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The row with the greatest ``order`` per key; combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    # Rows at one place in the order are told apart by all that they hold.
    total = F.struct(order, *[c for c in rest if c != order])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), total).alias("_last"))
        .select(*keys, "_last.*")
        .select(*df.columns)
    )


def alive(changes: DataFrame) -> DataFrame:
    """Changes after the last reset."""
    last_reset = changes.where(F.col("op") == "reset").agg(F.max("seq")).scalar()
    return changes.where(F.col("op") != "reset").where(
        last_reset.isNull() | (F.col("seq") > last_reset)
    )


def current_view(changes: DataFrame) -> DataFrame:
    """Latest record per (type, id) after the last reset, without deleted ones."""
    return last_wins(alive(changes), KEY).where(F.col("op") == "put").drop("op")


def as_changes(records: DataFrame, op: str) -> DataFrame:
    return records.withColumn("op", F.lit(op))


def upsert(registry: DataFrame, records: DataFrame) -> DataFrame:
    """Records replace stored ones with the same key; later ``seq`` wins."""
    return last_wins(registry.unionByName(records), KEY)


def prune_index(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop index lines of deleted artifacts (by default they stay). An id that
    was registered very often is a hot key of the index.
    """
    gone = keys.select(F.col("id").cast("string").alias("id"), "type").distinct()
    return index.join(gone, ["id", "type"], "left_anti").select(*index.columns)


def reset(registry: DataFrame) -> DataFrame:
    return registry.limit(0)


# --- validation ------------------------------------------------------------------------


def _blank(column: Column | str) -> Column:
    return F.coalesce(col(column).cast("string"), F.lit("")) == ""


def validate_registrations(requests: DataFrame) -> DataFrame:
    """Adds ``error``: null for a registration that can go on.

    Names are required as well, because ids are derived from them.
    """
    return requests.withColumn(
        "error",
        F.when(_blank("artifact_type") | _blank("source_url"), "Missing artifact_type or url").when(
            F.col("name").isNull(), "Missing name"
        ),
    )


def validate_uploads(uploads: DataFrame) -> DataFrame:
    missing = (
        _blank("artifact_type")
        | _blank("model_url")
        | F.col("results").isNull()
        | F.col("net_score").isNull()
    )
    return uploads.withColumn("error", F.when(missing, "Missing one or more required fields"))


def validate_updates(updates: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``status``: ``ok``, ``invalid`` (path and body disagree, or no name)
    or ``not_found`` (no such artifact).
    """
    agree = F.col("path_type").eqNullSafe(F.col("type")) & F.col("path_id").eqNullSafe(F.col("id"))
    return (
        with_stored_flag(updates, registry)
        .withColumn(
            "status",
            F.when(~agree | _blank("name"), "invalid")
            .when(~F.col("stored"), "not_found")
            .otherwise("ok"),
        )
        .drop("stored")
    )


def with_stored_flag(changes: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``stored``: is the (type, id) of a change in the registry? The
    registry has one row per key; an artifact may be changed very often.
    """
    known = registry.select(*KEY, F.lit(True).alias("stored"))
    flagged = lookup_join(changes, known, KEY)
    return flagged.withColumn("stored", F.coalesce("stored", F.lit(False)))


def existing_updates(updates: DataFrame, registry: DataFrame) -> DataFrame:
    return with_stored_flag(updates, registry).where("stored").drop("stored")


def missing_updates(updates: DataFrame, registry: DataFrame) -> DataFrame:
    return with_stored_flag(updates, registry).where("not stored").drop("stored")
