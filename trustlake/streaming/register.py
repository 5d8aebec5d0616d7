"""Registration as a stream: each micro-batch is a run of the stored registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_registrations(
    registrations: DataFrame,
    store: Callable[[DataFrame, str], object],
    checkpoint: str,
    name: str = "stream",
) -> None:
    """Hand every micro-batch of what is available to ``store`` with the id of its run.

    ``store`` decides and stores (see ``plans.flows``). Rows get ``seq``, the place of
    the registration in its source (column ``place``), so registrations of a name in
    one batch have an order of their own. A batch that is replayed after a failure
    has the same id: it repeats a run that was not committed and skips one that was.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = (F.col("place.path"), F.col("place.block"), F.monotonically_increasing_id())
        seq = F.concat_ws("/", parts[0], *[F.lpad(p.cast("string"), 20, "0") for p in parts[1:]])
        store(batch.withColumn("seq", seq).drop("place"), f"{name}-{batch_id}")

    (
        registrations.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )
