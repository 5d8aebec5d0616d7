"""Service health from log lines and request samples."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.numeric import let


def look_back(as_of: datetime, hours: int = C.LOOK_BACK_HOURS) -> tuple[datetime, datetime]:
    return as_of - timedelta(hours=hours), as_of


def between(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Rows with ``start <= ts <= end``; both bounds reach the scan.

    Bounds without a zone are read in the session's, like the column itself.
    """
    kind = df.schema["ts"].dataType
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start.isoformat()).cast(kind))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end.isoformat()).cast(kind))
    return df


def is_error() -> Column:
    return F.col("message").rlike(C.ERROR_LINE)


def is_warning() -> Column:
    return F.col("message").rlike(C.WARNING_LINE)


def error_lines(logs: DataFrame) -> DataFrame:
    return logs.where(is_error())


def warning_lines(logs: DataFrame) -> DataFrame:
    return logs.where(is_warning())


def configured(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The configured log groups as a one-column table."""
    return df.sparkSession.createDataFrame([(g,) for g in groups], "log_group string")


def log_counts(logs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Lines, errors and warnings per configured group; silent groups count 0.

    All three counts come from one pass and combine on the map side.
    """
    counts = (
        logs.where(F.col("log_group").isin(list(groups)))
        .groupBy("log_group")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(is_error()).alias("errors"),
            F.count_if(is_warning()).alias("warnings"),
        )
    )
    return configured(logs, groups).join(counts, "log_group", "left").na.fill(0)


def recent_errors(logs: DataFrame, limit: int = C.RECENT_ERRORS) -> DataFrame:
    """The newest error lines of each group.

    Ties in time go to the higher event id. Each map task keeps ``limit`` rows
    per group before the shuffle, however busy the group is.
    """
    newest = Window.partitionBy("log_group").orderBy(F.desc("ts"), F.desc("event_id"))
    return (
        error_lines(logs)
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= limit)
    )


def latest_lines(logs: DataFrame, cap: int = C.LOG_RESULT_CAP) -> DataFrame:
    """Newest first, at most ``cap`` lines: a top-k, not a full sort."""
    return logs.orderBy(F.desc("ts"), F.desc("event_id")).limit(cap)


def period_start(ts: Column | str = "ts", period: str = C.PERIOD) -> Column:
    return F.window(F.col(ts) if isinstance(ts, str) else ts, period)["start"]


def period_stats(requests: DataFrame, period: str = C.PERIOD) -> DataFrame:
    """Requests and average latency of every period that has data.

    Latencies are added up as decimals, so the average does not depend on the
    order in which partial sums meet.
    """
    exact = F.sum(F.col("latency_ms").cast("decimal(28,6)")).cast("double")
    return requests.groupBy(period_start(period=period).alias("period")).agg(
        F.count(F.lit(1)).alias("requests"),
        (exact / F.count(F.lit(1))).alias("avg_latency_ms"),
    )


def newest_period(stats: DataFrame) -> DataFrame:
    """The most recent row of per-period statistics."""
    return stats.agg(F.max_by(F.struct("*"), "period").alias("s")).select("s.*")


def latest_period(requests: DataFrame, period: str = C.PERIOD) -> DataFrame:
    """Samples of the most recent period with data.

    The period comes from the largest timestamp (a scalar subquery); its bounds
    then restrict the second scan to that period.
    """
    newest = requests.agg(F.max("ts").alias("ts"))
    start = newest.select(period_start(period=period).alias("start")).scalar()
    return requests.where(F.col("ts") >= start)


def average_latency(requests: DataFrame, period: str = C.PERIOD) -> DataFrame:
    """One row: average latency of the latest period, 0 without any data."""
    return latest_period(requests, period).agg(_mean().alias("avg_latency_ms"))


def _mean() -> Column:
    exact = F.sum(F.col("latency_ms").cast("decimal(28,6)")).cast("double")
    return F.coalesce(F.try_divide(exact, F.count(F.lit(1))), F.lit(0.0))


# Bits of a value that one scan settles, and how often it takes that to settle all.
DIGIT = 16
SCANS = 64 // DIGIT


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a number in the same order: its power of two, then the
    exact rest. NaN is the largest; both zeros are equal.
    """

    def bits(x: Column) -> Column:
        guess = F.floor(F.log2(x)).cast("int")  # off by one at most, near a power of two
        two = F.lit(2.0)
        low = F.when(x < F.pow(two, guess), guess - 1).when(x >= F.pow(two, guess + 1), guess + 1).otherwise(guess)
        # Smaller numbers have no leading bit; in steps, as 2^1074 itself is no double.
        tiny = (x * float(2**537) * float(2**537)).cast("long")
        whole = F.shiftleft((low + 1023).cast("long"), 52) + ((x / F.pow(two, low) - 1.0) * float(2**52)).cast("long")
        largest = F.lit(0x7FF0000000000000)
        return F.when(x == 0.0, F.lit(0)).when(F.isnan(x), largest + 1).when(x == float("inf"), largest).when(
            x < 2.2250738585072014e-308, tiny
        ).otherwise(whole)

    size = F.when(F.isnan(value), value).otherwise(F.abs(value))
    return let(size, lambda x: let(bits(x), lambda b: F.when(value < 0.0, -b).otherwise(b)))


def latency_percentiles(
    requests: DataFrame, fractions: Sequence[float], period: str = C.PERIOD
) -> DataFrame:
    """``fraction, latency_ms``: exact interpolated percentiles of the latest
    period, and its ``avg_latency_ms``; 0 without data.

    Each percentile lies between two order statistics. Every value is a 64-bit number
    in the order of the values, and a scan settles ``DIGIT`` bits of all order
    statistics at once: it counts the values by their next digit, among those that
    begin as an order statistic does. So a task never holds more than one count for
    each digit, however many values there are and however they cluster.
    """
    samples = latest_period(requests, period).select(F.col("latency_ms").cast("double").alias("v"))
    keyed = samples.withColumn("bits", ordered_bits(F.col("v")))

    def digits(scan: int) -> Column:
        """The leading bits after so many scans."""
        return F.shiftright("bits", 64 - DIGIT * scan)

    exact = F.sum(F.col("v").cast("decimal(28,6)"))
    upto = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = keyed.groupBy(digits(1).alias("digit")).agg(
        F.count("v").alias("c"), F.count(F.lit(1)).alias("rows"), exact.alias("s")
    )
    sums = {"n": "c", "rows": "rows", "total": "s"}
    first = first.withColumn("upto", F.sum("c").over(upto)).withColumns(
        {name: F.sum(column).over(whole) for name, column in sums.items()}
    )
    last = F.col("n") - 1

    def targets(fraction: float) -> list[Column]:
        position = last * F.lit(float(fraction))
        return [
            F.struct(F.lit(float(fraction)).alias("fraction"), F.lit(upper).alias("upper"),
                     (position - F.floor(position)).alias("share"), rank(position).cast("long").alias("rank"))
            for upper, rank in ((False, F.floor), (True, F.ceil))
        ]

    # The digits that hold a wanted rank, and the rank among the values of that digit.
    before = F.col("upto") - F.col("c")
    wanted = F.explode(F.array(*[t for f in fractions for t in targets(f)]))
    mean = (F.col("total").cast("double") / F.col("rows")).alias("mean")
    found = first.select("digit", "c", "upto", mean, wanted.alias("t")).where(
        (F.col("t.rank") >= before) & (F.col("t.rank") < F.col("upto"))
    ).select("t.fraction", "t.upper", "t.share", "mean", F.col("digit").alias("prefix"), (F.col("t.rank") - before).alias("rank"))
    for scan in range(2, SCANS + 1):
        prefixes = found.select("prefix").distinct()
        inside = keyed.withColumn("prefix", digits(scan - 1)).join(F.broadcast(prefixes), "prefix")
        counts = inside.groupBy("prefix", digits(scan).alias("digit")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("v")
        )
        upto = Window.partitionBy("prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("c").over(upto))
        found = found.drop("v").join(counts, "prefix").where(
            (F.col("rank") >= before) & (F.col("rank") < F.col("upto"))
        ).select("fraction", "upper", "share", "mean", F.col("digit").alias("prefix"),
                 (F.col("rank") - before).alias("rank"), "v")
    low, high = (F.max(F.when(F.col("upper") == upper, F.col("v"))) for upper in (False, True))
    result = found.groupBy("fraction").agg(
        (low + (high - low) * F.max("share")).alias("latency_ms"), F.max("mean").alias("avg_latency_ms")
    )
    asked = requests.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")
    return asked.join(result, "fraction", "left").na.fill(0.0)


def request_count(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count(F.lit(1)).alias("total_requests"))


def api_stats(requests: DataFrame, period: str = C.PERIOD) -> DataFrame:
    """One row with average, p95 and p99 latency and the request count."""
    names = {0.95: "p95_latency_ms", 0.99: "p99_latency_ms"}
    found = latency_percentiles(requests, list(names), period)
    of = {n: F.max(F.when(F.col("fraction") == f, F.col("latency_ms"))).alias(n) for f, n in names.items()}
    return found.agg(
        F.max("avg_latency_ms").alias("avg_latency_ms"),
        *of.values(),
        request_count(requests).scalar().alias("total_requests"),
    )


def health_status(counts: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: ``DEGRADED`` without requests or with errors in any group."""
    total = request_count(requests).scalar()
    return counts.agg(F.coalesce(F.max(F.col("errors") > 0), F.lit(False)).alias("failing")).select(
        F.when((total == 0) | F.col("failing"), "DEGRADED").otherwise("OK").alias("status")
    )
