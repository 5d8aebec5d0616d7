"""Sampling documents so that token shares meet targets, by iterative proportional fitting.

Documents are counted into cells of source, language and topic. Raking multiplies
the weight of cells by the ratio of target to present share, one margin after the
other, until the shares of all margins agree. ``expected``, how often a document is
to be in the sample, is its cell's weight times ``FRACTION``, the size of the sample
against all tokens. Its whole part is the number of sure copies, and a hash of number
and text draws one more with the chance that is left. So every margin of the sample
meets its target in expectation, those of values too rare for it by copies, and a
rerun draws the same.

Cells, margins and targets stay tables. What the driver sees is one number a
round, the largest change of a weight, and the totals.

Defined results
    null or empty text      0 tokens; drawn as its cell is, never if that has no tokens
    null source, language   a value of its own, written as an empty string
    value without target    share 0, never drawn
    target without tokens   left out, the other shares of its margin are scaled up
    no tokens at all        all weights are 0, nothing is drawn
    null doc_id, repeats    drawn by the same hash, so equal rows are drawn alike
    very long texts         whole; a text is in or out as one
    empty table             no rows
    further columns         not read by ``chances``; passed on by ``draw``, which
                            replaces columns named topic, weight, expected and copies
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import cut

ROUNDS = 15
# Raking ends before if no weight changes by more than this share.
SETTLED = 1e-13
FRACTION = 0.5
# Exponents that temper the present shares into targets.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
MARGINS = ("source", "lang", "topic")
# Topics by the first pattern that a text holds.
TOPICS = (
    ("contact", r"[A-Za-z0-9._]+@[A-Za-z0-9]"),
    ("legal", r"[Ll]icen[sc]e|LICEN[SC]E|[Cc]opyright|COPYRIGHT"),
    ("config", r"[A-Za-z_] ?[=:] ?[\"'0-9]"),
    ("table", r"\|"),
    ("symbols", r"###|\$\$\$|%%%|&&&|\*\*\*"),
    ("emphasis", r"!!"),
)


def tokens(text: Column) -> Column:
    """Words, as runs of anything but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def uniform(*columns: Column) -> Column:
    """A number from 0 up to 1, from a digest of the columns."""
    digits = F.substr(F.md5(F.concat_ws("|", *columns).cast("binary")), F.lit(1), F.lit(12))
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def measures_of(docs: DataFrame) -> dict[str, Column]:
    """The margins, the tokens and the uniform number of a document."""
    number = docs["doc_id"].cast("long").cast("string")
    return {
        "source": F.coalesce(docs["source"].cast("string"), F.lit("")),
        "lang": F.coalesce(docs["lang"].cast("string"), F.lit("")),
        "topic": topic(docs["text"]),
        "tokens": tokens(docs["text"]),
        "u": uniform(number, F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))),
    }


def measured(docs: DataFrame) -> DataFrame:
    """The margins and the weight in tokens of every document."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), *[c.alias(n) for n, c in measures_of(docs).items()]
    )


def tempered(cells: DataFrame, exponents: Mapping[str, float] = TEMPER) -> dict[str, DataFrame]:
    """Targets that lift rare values: present shares to a power below one."""
    out = {}
    for name, power in exponents.items():
        margin = cells.groupBy(name).agg(F.sum("tokens").alias("n")).where("n > 0")
        out[name] = margin.select(name, F.pow(F.col("n").cast("double"), F.lit(power)).alias("share"))
    return out


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (margins and ``tokens``) with ``weight``: how many times over a token counts;
    0 for cells without tokens.

    ``targets`` has a table of value and share for each margin; shares need not add
    up to 1. Weights keep the total number of tokens.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    shares = {}
    for name, target in targets.items():
        present = cells.groupBy(name).agg(F.sum("tokens").alias("n")).where("n > 0").select(name)
        known = cut(target.where("share > 0").join(present, name), f"target-{name}")
        sum_ = float(known.agg(F.sum("share")).first()[0] or 0)
        shares[name] = known.select(
            name, (F.col("share") / (sum_ or 1.0) * total).alias("aim")
        )
    # Cells without tokens count for no margin; nothing would bound their weights.
    held = F.when(F.col("tokens") > 0, 1.0).otherwise(0.0)
    cells = cells.withColumns({"weight": held, "moved": F.lit(0.0)})
    for _ in range(rounds):
        for at, (name, aim) in enumerate(shares.items()):
            now = cells.groupBy(name).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            factor = now.join(aim, name, "left").select(
                name,
                F.when(F.col("now") > 0, F.coalesce("aim", F.lit(0.0)) / F.col("now"))
                .otherwise(0.0).alias("factor"),
            )
            change = F.when(F.col("weight") > 0, F.abs(F.col("factor") - 1)).otherwise(0.0)
            # Written each time: a step reads the cells twice, so plans of several steps would double with each.
            cells = cut(
                cells.join(factor, name).select(
                    *[c for c in cells.columns if c not in ("weight", "moved")],
                    (F.col("weight") * F.col("factor")).alias("weight"),
                    F.greatest(F.col("moved") if at else F.lit(0.0), change).alias("moved"),
                ),
                "cells",
            )
        if (cells.agg(F.max("moved")).first()[0] or 0.0) <= SETTLED:
            break
    return cells.drop("moved")


def drawn(weight: Column, u: Column, fraction: float) -> dict[str, Column]:
    """``expected`` and ``copies`` of a document with a weight and a number from 0 up to 1."""
    expected = weight * F.lit(fraction)
    whole = F.floor(expected)
    return {"expected": expected, "copies": (whole + (u < expected - whole).cast("int")).cast("long")}


def chances(
    docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, fraction: float = FRACTION
) -> DataFrame:
    """A row for each document: its margins, tokens, ``weight, expected`` and ``copies``."""
    rows = cut(measured(docs), "measured")
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, targets or tempered(cells)).drop("tokens")
    # One row for each cell; adaptive execution splits the rows of a large cell.
    found = rows.join(raked, list(MARGINS))
    return found.withColumns(drawn(F.col("weight"), F.col("u"), fraction)).drop("u")


def draw(
    docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, fraction: float = FRACTION
) -> DataFrame:
    """The drawn documents, each once, with all their columns and ``topic, weight, expected, copies``.

    Texts are read once for their margins and written with them, so they are joined
    to the cells, which Spark does without a shuffle of them if the cells are few.
    """
    made = ("topic", "weight", "expected", "copies")
    kept = [c for c in docs.columns if c not in made]
    found = {name: f"_{uuid.uuid4().hex}" for name in (*MARGINS, "tokens", "u")}
    measures = measures_of(docs)
    rows = cut(docs.select(*[docs[c] for c in kept], *[measures[n].alias(x) for n, x in found.items()]), "measured")
    cells = rows.groupBy(*[F.col(found[m]).alias(m) for m in MARGINS]).agg(F.sum(found["tokens"]).alias("tokens"))
    cells = cut(cells, "cells")
    raked = rake(cells, targets or tempered(cells)).select(
        *[F.col(m).alias(found[m]) for m in MARGINS], F.col("weight").alias(f"{found['u']}w")
    )
    weight = F.col(f"{found['u']}w")
    new = drawn(weight, F.col(found["u"]), fraction)
    return (
        rows.join(raked, [found[m] for m in MARGINS])
        .where(new["copies"] > 0)
        .select(*kept, F.col(found["topic"]).alias("topic"), weight.alias("weight"),
                new["expected"].alias("expected"), new["copies"].alias("copies"))
    )
