"""URL lists as they stood when a page was fetched.

A dated list entry says that from an instant on a pattern is on a list (``add``)
or is not (``remove``). The entries of a pattern become intervals in which it is
listed. Each capture is looked up under every pattern that could cover its URL,
in the interval that holds its fetch time, and the most specific listed pattern
decides: the whole URL, then the longest path prefix, the host, the nearest
parent domain; for the same pattern ``allow`` beats ``deny``.

Intervals are cut by calendar months, so the as-of join is an equality on pattern
and month; the comparison of instants then sees the intervals of one month only.
Rows of a pattern are spread by ``place``, whatever host holds a third of them.
All of it is DataFrame work.

Defined results
    null or malformed URL    covered by nothing: not blocked
    null fetch time          covered by nothing
    null in an entry         the entry is ignored, as is an unknown kind, action or verdict
    entries at one instant   ``add`` beats ``remove``
    at the instant itself    an interval holds its begin, not its end
    repeated captures        one row each
    equal page_id            each row by its own URL and time
    empty tables             no rows; or nothing blocked
    further columns          not read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlake.llm.common import cut, place

KINDS = ("domain", "host", "prefix", "url")
_MONTH = "cast(date_trunc('month', {}) as date)"


def host(url: Column) -> Column:
    """Host of an absolute URL in lower case, without user, port and last dot; else null."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    found = F.regexp_replace(found, r"\.$", "")
    return F.when(found != "", found)


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def canonical(url: Column) -> Column:
    """Host, path and query: what URL entries are compared by."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(host(url), path(url), query)


def patterns(url: Column) -> Column:
    """Every pattern that covers a URL: ``kind, pattern, rank``; a higher rank is more specific."""
    labels = F.split(host(url), r"\.")
    steps = F.split(path(url), "/")
    # Ranks: domains by number of labels, the host, prefixes by number of steps, the URL.
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.struct(
            F.lit("domain").alias("kind"),
            F.array_join(F.slice(labels, -n, n), ".").alias("pattern"),
            n.cast("long").alias("rank"),
        ),
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(steps) - 1),
        lambda n: F.struct(
            F.lit("prefix").alias("kind"),
            F.concat(host(url), F.array_join(F.slice(steps, 1, n), "/"), F.lit("/")).alias("pattern"),
            (n + 2_000_000).cast("long").alias("rank"),
        ),
    )

    def one(kind: str, pattern: Column, rank: int) -> Column:
        named = (F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(rank).cast("long").alias("rank"))
        return F.array(F.struct(*named))

    return F.concat(
        domains, one("host", host(url), 1_000_000), prefixes, one("url", canonical(url), 9_000_000)
    )


def intervals(entries: DataFrame) -> DataFrame:
    """``kind, pattern, verdict, since, until`` from ``kind, pattern, verdict, action, at``.

    Entries of an instant count as one before a pattern's entries are ordered, so
    a pattern's rows are bounded by the list's calendar, not by its size.
    """
    key = ["kind", "pattern", "verdict"]
    valid = entries.where(
        F.col("kind").isin(*KINDS) & F.col("verdict").isin("allow", "deny")
        & F.col("action").isin("add", "remove") & F.col("pattern").isNotNull() & F.col("at").isNotNull()
    )
    changes = valid.withColumn("at", F.col("at").cast("timestamp")).groupBy(*key, "at").agg(F.max(F.col("action") == "add").alias("listed"))
    order = Window.partitionBy(*key).orderBy("at")
    turns = changes.withColumn("before", F.lag("listed", 1, False).over(order)).where("listed <> before")
    spans = turns.withColumn("until", F.lead("at").over(order)).where("listed")
    return spans.select(*key, F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each capture of ``page_id, url, fetched``, with ``blocked``, the number
    of listed patterns that cover it, and the deciding ``kind, pattern, verdict``."""
    rows = cut(
        captures.select("page_id", "url", F.col("fetched").cast("timestamp").alias("fetched")), "captures"
    )
    last = rows.agg(F.max("fetched").cast("string")).first()[0] or "1970-01-01"
    spans = intervals(entries).where(F.col("since") <= F.lit(last).cast("timestamp"))
    first, end = _MONTH.format("since"), _MONTH.format(f"least(until, timestamp'{last}')")
    spans = cut(
        spans.withColumn("month", F.explode(F.expr(f"sequence({first}, {end}, interval 1 month)"))),
        "intervals",
    )
    asked = (
        rows.where(host(F.col("url")).isNotNull() & F.col("fetched").isNotNull()).distinct()
        .withColumn("month", F.expr(_MONTH.format("fetched")))
        .withColumn("p", F.explode(patterns(F.col("url"))))
        .select("page_id", "url", "fetched", "month", "p.kind", "p.pattern", "p.rank")
    )
    named = spans.select("kind", "pattern").distinct()
    asked = cut(asked.join(named, ["kind", "pattern"], "left_semi"), "asked")
    found = place(asked, spans, ["kind", "pattern", "month"], "url").where(
        (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    )
    allows = F.col("verdict") == "allow"
    decided = found.groupBy("page_id", "url", "fetched").agg(
        F.count(F.lit(1)).alias("listed"),
        F.max(F.struct("rank", allows.alias("allows"), "kind", "pattern", "verdict")).alias("best"),
    )
    same = [rows[c].eqNullSafe(decided[c]) for c in ("page_id", "url", "fetched")]
    return rows.join(decided, same[0] & same[1] & same[2], "left").select(
        rows["page_id"], rows["url"], rows["fetched"],
        F.coalesce(F.col("best.verdict") == "deny", F.lit(False)).alias("blocked"),
        F.coalesce("listed", F.lit(0)).cast("long").alias("listed"),
        F.col("best.kind").alias("kind"), F.col("best.pattern").alias("pattern"),
        F.col("best.verdict").alias("verdict"),
    )
