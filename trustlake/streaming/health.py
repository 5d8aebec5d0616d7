"""Health as streams: counts of log lines, and latencies of requests.

Each micro-batch is reduced to one row for each five-minute cell and stored as a run
(see ``sources.runs``) under its batch id: counts, exact sums, and a quantile
sketch. All of these merge, so there is no state and no watermark, no line is too
late, and a replayed batch is not stored again. The sliding hour is put together
from twelve cells when it is read. After some batches the stored cells are merged
into one run, so their files stay few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.operators.health import is_error, is_warning
from trustlake.sources.runs import Runs

COUNTS = ("total", "errors", "warnings")
CELL_MINUTES = 5
HOUR_CELLS = 12
# Sketches hold this many values for certain, and are exact up to there.
SKETCH = 400
SCHEMAS = {
    "counts": "cell timestamp, log_group string, total long, errors long, warnings long",
    "latencies": "cell timestamp, requests long, latency_sum decimal(38,6), sketch binary",
}
# Batches after which stored cells are merged.
MERGE_EVERY = 20


def cell_start() -> Column:
    return F.window(F.col("ts").cast("timestamp"), C.PERIOD)["start"]


def count_cells(logs: DataFrame) -> DataFrame:
    """Lines, errors and warnings per cell and log group."""
    return logs.groupBy(cell_start().alias("cell"), "log_group").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_error()).alias("errors"),
        F.count_if(is_warning()).alias("warnings"),
    )


def latency_cells(requests: DataFrame) -> DataFrame:
    """Requests, the exact sum of their latencies and a sketch of them per cell."""
    value = F.col("latency_ms").cast("double")
    return requests.where(value.isNotNull()).groupBy(cell_start().alias("cell")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.col("latency_ms").cast("decimal(28,6)")).alias("latency_sum"),
        F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias("sketch"),
    )


def merged_counts(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*(keys or ("cell", "log_group"))).agg(*[F.sum(c).alias(c) for c in COUNTS])


def merged_latencies(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*(keys or ("cell",))).agg(
        F.sum("requests").alias("requests"),
        F.sum("latency_sum").cast("decimal(38,6)").alias("latency_sum"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"),
    )


CELLS = {"counts": (count_cells, merged_counts), "latencies": (latency_cells, merged_latencies)}


def cell_runs(spark: SparkSession, root: str, table: str) -> Runs:
    return Runs(spark, root, {table: SCHEMAS[table]})


def merge_cells(runs: Runs, run: str, table: str) -> None:
    """One run in place of all that are stored."""

    def fold(rows: DataFrame) -> DataFrame:
        return CELLS[table][1](rows).withColumn(
            "seq", F.struct(F.lit(0).alias("at"), F.lit("").alias("place"))
        )

    if runs.compact(run, {table: fold}):
        runs.vacuum()


def run_cells(
    rows: DataFrame, table: str, root: str, checkpoint: str, merge_every: int = MERGE_EVERY
) -> None:
    """Store the cells of every micro-batch of a stream.

    The source sets how much a batch holds, with its number of files per trigger.
    """
    runs = cell_runs(rows.sparkSession, root, table)

    def write(batch: DataFrame, batch_id: int) -> None:
        cells = CELLS[table][0](batch).withColumn("place", F.lit(""))
        runs.write(f"batch-{batch_id}", {table: cells})
        if batch_id % merge_every == merge_every - 1:
            merge_cells(runs, f"cells-{batch_id}", table)

    (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )


def windows(cells: DataFrame, number: int, merged: Callable, *keys: str) -> DataFrame:
    """Windows of so many cells, one beginning with each cell in them."""
    minutes = F.expr(f"interval {CELL_MINUTES} minutes")
    if number > 1:
        starts = F.sequence(
            F.col("cell") - F.expr(f"interval {CELL_MINUTES * (number - 1)} minutes"), F.col("cell"), minutes
        )
        cells = cells.withColumn("cell", F.explode(starts))
    end = F.col("cell") + F.expr(f"interval {CELL_MINUTES * number} minutes")
    rest = [c for c in (*COUNTS, "requests", "latency_sum", "sketch") if c in cells.columns]
    return merged(cells, "cell", *keys).select(
        F.col("cell").alias("window_start"), end.alias("window_end"), *keys, *rest
    )


def read_counts(spark: SparkSession, root: str, cells: int = 1) -> DataFrame:
    """Lines, errors and warnings of every window of so many cells, per log group."""
    return windows(cell_runs(spark, root, "counts").read("counts"), cells, merged_counts, "log_group")


def read_latencies(
    spark: SparkSession, root: str, cells: int = 1, fraction: float = 0.95
) -> DataFrame:
    """Requests, average and a percentile of the latencies of every window of so many cells.

    The percentile is one of the values: at least this share is not above it. It is exact
    for up to ``SKETCH`` requests, and within a percent of the ranks beyond.
    """
    found = windows(cell_runs(spark, root, "latencies").read("latencies"), cells, merged_latencies)
    return found.select(
        "window_start", "window_end", "requests",
        (F.col("latency_sum").cast("double") / F.col("requests")).alias("avg_latency_ms"),
        F.kll_sketch_get_quantile_double("sketch", F.lit(fraction)).alias("percentile_ms"),
    )


# --- the same over a table, in one go --------------------------------------------------------


def window_counts(logs: DataFrame) -> DataFrame:
    """Lines, errors and warnings per cell and log group."""
    return windows(count_cells(logs), 1, merged_counts, "log_group")


def hourly_counts(logs: DataFrame) -> DataFrame:
    """The look-back hour, sliding by one cell."""
    return windows(count_cells(logs), HOUR_CELLS, merged_counts, "log_group")
