"""Listing stored artifacts: type and name predicates, union order, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.ids import artifact_id


def requested_types(types: Sequence[str]) -> list[str]:
    """Validated types; an empty request means all of them."""
    unknown = [t for t in types if t not in C.ARTIFACT_TYPES]
    if unknown:
        raise ValueError(f"invalid type value: {unknown}")
    return list(types) or list(C.ARTIFACT_TYPES)


def filter_types(registry: DataFrame, types: Sequence[str]) -> DataFrame:
    return registry.where(F.col("type").isin(requested_types(types)))


def lookup_by_name(registry: DataFrame, name: str, types: Sequence[str] = ()) -> DataFrame:
    """Rows stored under the id of a name; the id folds to a constant, so the
    scan gets a pushed equality predicate.
    """
    by_id = registry.where(F.col("id") == artifact_id(F.lit(name)))
    return filter_types(by_id, types)


def by_name(registry: DataFrame, name: str, types: Sequence[str] = ()) -> DataFrame:
    """``*`` selects every row of the types, other names go through the id."""
    if not name.strip():
        raise ValueError("name must not be blank")
    if name == "*":
        return filter_types(registry, types)
    return lookup_by_name(registry, name, types)


def listing(df: DataFrame) -> DataFrame:
    extra = [c for c in ("type_rank", "next_offset") if c in df.columns]
    return df.select("name", "id", "type", *extra)


def union_types(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """Rows once per requested occurrence of their type, with its position.

    One scan: each row is expanded by the positions at which its type was asked
    for, instead of one union branch per type.
    """
    wanted = requested_types(types)
    positions = F.filter(
        F.array(*[F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(wanted)]),
        lambda p: p.isNotNull(),
    )
    return filter_types(df, wanted).withColumn("type_rank", F.explode(positions))


# Offsets from here on are found by counts, not by sorting all that comes before.
DEEP = 10_000
# Characters of an id by which its place is narrowed down.
LEVELS = (3, 6, 9)


def page(
    df: DataFrame, offset: int | str | None = 0, size: int = C.PAGE_SIZE, deep: int = DEEP
) -> DataFrame:
    """One page in (type position, id as text) order.

    ``next_offset`` is set only if rows remain. An offset that is no integer
    counts as zero. One more row than the page holds is read to know whether
    any remain, so the window below sees at most ``size + 1`` rows. An offset of
    ``deep`` or more is found by ranks.
    """
    try:
        start = int(offset)
    except (TypeError, ValueError):
        start = 0
    if start >= deep:
        return ranked_page(df, start, size)
    order = ["type_rank", F.col("id").cast("string")]
    probe = df.orderBy(*order).offset(start).limit(size + 1)
    whole = Window.partitionBy(F.lit(0))
    return (
        probe.withColumn("_rows", F.count(F.lit(1)).over(whole))
        .withColumn("_row", F.row_number().over(whole.orderBy(*order)))
        .where(F.col("_row") <= size)
        .withColumn(
            "next_offset", F.when(F.col("_rows") > size, F.lit(start + size)).cast("long")
        )
        .drop("_rows", "_row")
    )


def ranked_page(df: DataFrame, start: int, size: int = C.PAGE_SIZE) -> DataFrame:
    """The same page, without an order of the rows before it.

    Rows are counted by type position and the first characters of the id. Sums of
    the counts say which of these ranges the page begins and ends in; inside those
    the next characters are counted, and only what remains is sorted. A page
    touches no more ranges than it has rows, so they are broadcast.
    """
    end = start + size
    rows = df.withColumn("_key", F.col("id").cast("string"))
    found, at = None, 0
    for chars in LEVELS:
        inside = rows.withColumn("_range", F.substring("_key", 1, chars))
        if found is None:
            counts = inside.groupBy("type_rank", "_range").agg(F.count(F.lit(1)).alias("_n"))
            # As many rows as there are ranges.
            order = Window.orderBy("type_rank", "_range")
            counts = counts.withColumns(
                {"_base": F.lit(0), "_total": F.sum("_n").over(Window.partitionBy(F.lit(0)))}
            )
        else:
            inside = inside.withColumn("_outer", F.substring("_key", 1, at))
            outer = found.withColumnsRenamed({"_range": "_outer", "_before": "_base"})
            counts = (
                inside.join(F.broadcast(outer), ["type_rank", "_outer"])
                .groupBy("type_rank", "_outer", "_base", "_total", "_range")
                .agg(F.count(F.lit(1)).alias("_n"))
            )
            order = Window.partitionBy("type_rank", "_outer").orderBy("_range")
        upto = F.col("_base") + F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
        found = counts.where((F.col("_upto") > start) & (F.col("_before") < end)).select(
            "type_rank", "_range", "_before", "_total"
        )
        at = chars
    last = rows.withColumn("_range", F.substring("_key", 1, at)).join(F.broadcast(found), ["type_rank", "_range"])
    place = F.row_number().over(Window.partitionBy("type_rank", "_range").orderBy("_key"))
    return (
        last.withColumn("_rank", F.col("_before") + place - 1)
        .where((F.col("_rank") >= start) & (F.col("_rank") < end))
        .withColumn("next_offset", F.when(F.col("_total") > end, F.lit(end)).cast("long"))
        .select(*df.columns, "next_offset")
    )


def page_after(
    df: DataFrame, type_rank: int, artifact: int | str, size: int = C.PAGE_SIZE
) -> DataFrame:
    """The page that follows a key. Unlike a deep offset, the predicate reaches
    the scan and no earlier row is sorted.
    """
    key = F.col("id").cast("string")
    later = (F.col("type_rank") > type_rank) | (
        (F.col("type_rank") == type_rank) & (key > str(artifact))
    )
    return df.where(later).orderBy("type_rank", key).limit(size)
