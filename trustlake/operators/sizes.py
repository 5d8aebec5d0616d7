"""Weight-file operators behind the size score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.files import device_scores, is_weight_file, size_bytes


def weight_files(siblings: DataFrame) -> DataFrame:
    return siblings.where(is_weight_file("rfilename"))


def sized(siblings: DataFrame) -> DataFrame:
    return siblings.withColumn("size_bytes", size_bytes("content_length", "content_range"))


def large_enough(files: DataFrame) -> DataFrame:
    """Files of known size from 5 MiB up. One null-safe comparison, so that the
    filter evaluates a computed size once.
    """
    return files.where(F.coalesce("size_bytes", F.lit(0)) >= C.MIN_WEIGHT_BYTES)


def counted_files(siblings: DataFrame) -> DataFrame:
    return large_enough(sized(weight_files(siblings)))


def total_weight(siblings: DataFrame) -> DataFrame:
    """Bytes of weight files per model, for models that have any.

    A plain sum, combined on the map side: adding stops mattering at the cap,
    because every total from there on falls into the last bucket of each device.
    """
    totals = with_weight_bytes(siblings).groupBy("model_id").agg(counted_bytes().alias("total_bytes"))
    return totals.where(F.col("total_bytes").isNotNull())


def with_weight_bytes(siblings: DataFrame) -> DataFrame:
    """Adds ``weight_bytes``, the size of a weight file; null for other files. A column
    of its own, so that a sum with a bound does not read the size twice.
    """
    size = size_bytes("content_length", "content_range")
    return siblings.withColumn("weight_bytes", F.when(is_weight_file("rfilename"), size))


def counted_bytes() -> Column:
    """Aggregate over ``weight_bytes``: sum of the files that are large enough."""
    size = F.col("weight_bytes")
    return F.sum(F.when(size >= C.MIN_WEIGHT_BYTES, size))


def files_to_cap(
    files: DataFrame, cap: int = C.WEIGHT_CAP_BYTES, block: int = 100_000
) -> DataFrame:
    """Files in listing order up to and including the one that reaches the cap.

    The running sum is taken in two levels: per block of ``block`` listing positions,
    then inside each block, starting from the sum of the blocks before. A model with
    a third of all files is spread over its blocks, and most models are a single
    one. ``files`` is read twice; pass a scan.
    """
    blocks = files.withColumn("_block", F.floor(F.col("ord") / block))
    before = Window.partitionBy("model_id").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        blocks.groupBy("model_id", "_block")
        .agg(F.sum("size_bytes").alias("_bytes"))
        .withColumn("_start", F.coalesce(F.sum("_bytes").over(before), F.lit(0)))
        .where(F.col("_start") < cap)
        .drop("_bytes")
    )
    inside = (
        Window.partitionBy("model_id", "_block")
        .orderBy("ord", "size_bytes")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        blocks.join(starts, ["model_id", "_block"])
        .withColumn(
            "running_before",
            F.col("_start") + F.coalesce(F.sum("size_bytes").over(inside), F.lit(0)),
        )
        .where(F.col("running_before") < cap)
        .drop("_start", "_block")
    )


def size_scores(siblings: DataFrame) -> DataFrame:
    """(model_id, total_bytes, devices struct)."""
    return total_weight(siblings).withColumn("devices", device_scores("total_bytes"))


def as_map(devices: Column) -> Column:
    """Device struct as a map column."""
    return F.when(
        devices.isNotNull(),
        F.map_from_arrays(
            F.array(*map(F.lit, C.DEVICES)), F.array(*[devices[d] for d in C.DEVICES])
        ),
    )
