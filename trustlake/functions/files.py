"""Column builders on file names and sizes of repository listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.numeric import col


def has_extension(filename: Column | str, extensions: Sequence[str]) -> Column:
    """Does the part after the last dot, in any case, belong to the list?"""
    name = col(filename)
    suffix = F.lower(F.substring_index(name, ".", -1))
    return name.contains(".") & suffix.isin([e.removeprefix(".") for e in extensions])


SPACE = f"[{''.join(f'\\x{{{ord(c):x}}}' for c in C.WHITESPACE)}]*"
# The stripped name ends in a weight extension, or its last path component begins with a stem.
WEIGHT_FILE = r"\.(?:{1}){0}\z|(?:\A{0}|/)(?:{2})[^/]*\z".format(
    SPACE, "|".join(e.removeprefix(".") for e in C.WEIGHT_EXTENSIONS), "|".join(C.WEIGHT_STEMS)
)


def is_weight_file(filename: Column | str) -> Column:
    """By extension, or by the first letters of the last path component."""
    return F.lower(col(filename)).rlike(WEIGHT_FILE)


def size_bytes(content_length: Column | str, content_range: Column | str) -> Column:
    """``Content-Length`` if it is a number, else the total in ``Content-Range``.

    One pattern for each, in generated code: listings are the largest table.
    """
    length = col(content_length)
    total = F.regexp_extract(col(content_range), rf"\A[^/]*/{SPACE}([0-9]+){SPACE}\z", 1)
    return F.coalesce(F.when(length.rlike(r"\A[0-9]+\z"), length.try_cast("long")), total.try_cast("long"))


def device_scores(total_bytes: Column | str) -> Column:
    """Struct with one suitability score per device; null without a size."""
    gib = col(total_bytes) / F.lit(float(C.GIB))

    def ladder(device: str) -> Column:
        rungs = C.DEVICE_LADDERS[device]
        inclusive = device == "raspberry_pi"
        score = F.when(gib <= rungs[0][0] if inclusive else gib < rungs[0][0], rungs[0][1])
        for bound, value in rungs[1:]:
            score = score.when(gib < bound, value)
        return score.otherwise(0.0)

    return F.when(
        col(total_bytes) > 0, F.struct(*[ladder(d).alias(d) for d in C.DEVICES])
    )


def device_mean(scores: Column | str) -> Column:
    """Mean over a device struct, added up in device order."""
    value = col(scores)
    total = sum((value[d] for d in C.DEVICES[1:]), value[C.DEVICES[0]])
    return total / float(len(C.DEVICES))


def map_mean(scores: Column | str) -> Column:
    """Mean of the values of any score map; null for an empty or missing map."""
    values = F.map_values(col(scores))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def first_named(siblings: Column | str, part: str) -> Column:
    """First file name, in listing order, that contains ``part`` in any case."""
    hits = F.filter(col(siblings), lambda s: F.contains(F.lower(s["rfilename"]), F.lit(part)))
    return F.try_element_at(hits, F.lit(1))["rfilename"]


def any_python_file(siblings: Column | str) -> Column:
    return F.exists(col(siblings), lambda s: F.endswith(F.lower(s["rfilename"]), F.lit(".py")))


def has_root_readme(siblings: Column | str) -> Column:
    return F.exists(col(siblings), lambda s: F.lower(s["rfilename"]) == "readme.md")


def has_examples_tag(tags: Column | str) -> Column:
    return F.exists(col(tags), lambda t: F.lower(t).rlike("example|tutorial"))
