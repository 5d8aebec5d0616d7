"""Numeric Column builders: clamping, rounding and popularity curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake import constants as C


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once per row.

    A Column that is used in several branches of a condition is otherwise
    evaluated in each of them; with whole texts that is most of the work. It
    also keeps generated code small: the JVM does not compile methods of more
    than 8000 bytes, and a filter that repeats its inputs soon gets there.
    """
    return F.transform(F.array(value), body)[0]


def clamp01(value: Column | str) -> Column:
    """Limit to [0, 1]; null stays null (``least`` alone would skip it)."""
    return let(col(value), lambda x: F.when(x < 0.0, 0.0).when(x > 1.0, 1.0).otherwise(x))


def round3(value: Column | str) -> Column:
    """Round to three places, half to even on the exact binary value.

    Spark's ``round`` rounds the shortest decimal form half up, which differs at
    ties such as 0.0625. Away from ties ``rint`` of the product is already the
    answer; at a computed tie the sign of the product's rounding error (exact,
    by splitting the value into two halves) says on which side the value lies.
    The value is used many times over: pass a column, or bind it with ``let``.
    """
    x = col(value).cast("double")
    scaled = x * 1000.0
    below = F.floor(scaled).cast("double")
    split = x * 134217729.0
    high = split - (split - x)
    error = (high * 1000.0 - scaled) + (x - high) * 1000.0
    nearest = (
        F.when(scaled - below != 0.5, F.rint(scaled))
        .when(error > 0, below + 1.0)
        .when(error < 0, below)
        .otherwise(F.rint(scaled))
    )
    return nearest / 1000.0


def score_clamp(score: Column | str) -> Column:
    """Negative scores count as zero, missing ones stay missing."""
    value = col(score)
    return round3(F.when(value < 0, 0.0).otherwise(value))


def popularity(downloads: Column | str) -> Column:
    """Log-scaled download count in [0, 1]; unparsable counts are zero."""
    count = F.coalesce(col(downloads).try_cast("long"), F.lit(0))
    return F.least(F.lit(1.0), F.log10(1 + count) / 6.0)


def likes_score(likes: Column | str) -> Column:
    return clamp01(F.log10(1 + F.coalesce(col(likes), F.lit(0))) / 3.0)


def freshness(last_modified: Column | str, as_of: Column) -> Column:
    """1 for a change at ``as_of``, falling to 0 over a year.

    Strings that are not ISO dates, and missing ones, count as a year old.
    """
    text = col(last_modified)
    parsed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|\z)"), text.try_cast("timestamp"))
    seconds = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(parsed)) / 1e6
    return F.coalesce(clamp01(1.0 - seconds / 86400.0 / 365.0), F.lit(0.0))


def trust_band(net_score: Column | str) -> Column:
    value = col(net_score)
    (low, low_bound), (mid, mid_bound), (high, _) = C.TRUST_BANDS
    return (
        F.when(value < low_bound, low)
        .when(value < mid_bound, mid)
        .when(value.isNotNull(), high)
    )


def mb_label(megabytes: Column | str) -> Column:
    """``"<n> MB"``; a missing size shows as ``"N/A MB"``."""
    return F.concat(F.coalesce(col(megabytes).cast("string"), F.lit("N/A")), F.lit(" MB"))
