"""README text rules as Column expressions.

The rules were defined on Python strings, so the patterns run with Java's
``(?U)`` (Unicode ``\\b \\d \\s \\w``) and ``(?d)`` (only ``\\n`` ends a line).
Repeated groups are possessive where a text decides the number of repetitions:
Java matches other repeated groups recursively, and a table of some thousand
rows would overflow the stack.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.numeric import col, let, round3
from trustlake.functions.urls import strip



def java(flags: str, pattern: str) -> str:
    """A Python pattern for Java: Unicode classes, and the four separators that
    only Python counts as white space.
    """
    spaces = pattern.replace(r"\s", r"[\s\x1c-\x1f]").replace(r"\S", r"[^\s\x1c-\x1f]")
    return f"(?U{flags}){spaces}"


# Cheap look-aheads keep the costly Unicode word boundary from being tried at
# every character.
NUMBER = java("", r"(?=\d)" + C.NUMBER)
NUMBER_LEFT = java("s", rf"(?=\d)\b(?<=(.{{{C.CLAIM_WINDOW}}})){C.NUMBER}")
NUMBER_RIGHT = java("s", rf"(?=\d)\b(?=(.{{{C.CLAIM_WINDOW}}})){C.NUMBER}")
DATE_OR_VERSION = java("", C.DATE_OR_VERSION)
YAML_VALUE = java("", C.YAML_VALUE)
CLAIM_HEADING = java("", C.CLAIM_HEADING)
HEADING_SPLIT = java("", C.HEADING_SPLIT)
# The trailing "+" makes the repeated rows possessive.
TABLE = java("d", C.METRIC_TABLE + "+")
BREAKS = "".join(f"\\x{{{ord(c):x}}}" for c in C.LINE_BREAKS)
FIRST_LINE = f"^[^{BREAKS}]*"
TABLE_HEADER = f"^\\n([^{BREAKS}]*)"
SPACES = java("", r"[\s_]+")
LICENSE_LINE = java("imd", C.LICENSE_LINE)


def section_pattern(heading: str) -> str:
    """A markdown section and, as group 2, its body up to the next heading."""
    level = r"^[ \t]*#{1,6}[ \t]"
    return java("imsd", rf"{level}*({heading})\b[^\n]*\n(.*?)(?={level}+\S|\z)")


def contains_any(text: Column | str, words: Sequence[str]) -> Column:
    # A word that holds another one adds nothing; short ones are found soonest.
    needed = sorted((w for w in words if not any(o != w and o in w for o in words)), key=len)
    return let(col(text), lambda value: reduce(or_, [value.contains(word) for word in needed]))


def words_found(text: Column | str, words: Sequence[str]) -> Column:
    """Array of the dictionary words that occur in a text as substrings."""

    def found(value: Column) -> Column:
        hits = [F.when(value.contains(word), F.lit(word)) for word in words]
        return F.array_compact(F.array(*hits))

    return let(col(text), found)


# --- performance claims ------------------------------------------------------------


def claim_sections(text: Column | str) -> Column:
    """Markdown parts whose heading line speaks of an evaluation."""
    parts = F.split(col(text), HEADING_SPLIT)
    return F.filter(
        parts,
        lambda part: F.regexp_extract(part, FIRST_LINE, 0).rlike(CLAIM_HEADING),
    )


def has_placeholder(text: Column | str) -> Column:
    return contains_any(text, C.PLACEHOLDER_WORDS)


def has_yaml_metric(text: Column | str) -> Column:
    """Structured results in the card header; expects lower-case text."""
    return let(
        col(text),
        lambda value: value.contains("model-index")
        & value.contains("metrics:")
        & value.rlike(YAML_VALUE),
    )


def one_unit_per_character(text: Column | str) -> Column:
    """Replace characters beyond U+FFFF, which take two units in Java, by
    one-unit characters of the same class: offsets then count characters.
    """
    value = col(text)
    beyond = r"\x{10000}-\x{10FFFF}"
    digits = F.regexp_replace(value, rf"[\p{{Nd}}&&[{beyond}]]", "0")
    letters = F.regexp_replace(digits, rf"[[\p{{L}}\p{{M}}\p{{N}}]&&[{beyond}]]", "ƿ")
    rest = F.regexp_replace(letters, f"[{beyond}]", "�")
    return F.when(value.rlike(f"[{beyond}]"), rest).otherwise(value)


def number_windows(text: Column | str) -> Column:
    """Array of (left, right): the 100 characters before and after the start of
    every number in a text, padded with blanks at the text's ends.
    """
    pad = F.repeat(F.lit(" "), C.CLAIM_WINDOW)
    padded = F.concat(pad, one_unit_per_character(text), pad)
    return F.arrays_zip(
        F.regexp_extract_all(padded, F.lit(NUMBER_LEFT), F.lit(1)).alias("left"),
        F.regexp_extract_all(padded, F.lit(NUMBER_RIGHT), F.lit(1)).alias("right"),
    )


def _position_reader(pattern: str):
    """The pandas function behind ``number_positions``, shipped by value."""

    def read(texts: pd.Series) -> pd.Series:
        number = re.compile(pattern)
        return pd.Series([
            None if text is None else [{"start": m.start(), "token": m[0]} for m in number.finditer(text)]
            for text in texts
        ], dtype=object)

    return read


def number_positions(text: Column | str) -> Column:
    """Array of (start, token) for every number; ``start`` counts from zero.

    One pass over each text, in Arrow batches: a running offset in a fold over an
    array would copy what was found for each number.
    """
    return F.pandas_udf(_position_reader(C.NUMBER), "array<struct<start:int,token:string>>")(col(text))


def has_number_near_metric(text: Column | str) -> Column:
    """A number that is no date or version has a metric word within 100
    characters of its start; expects lower-case text.
    """

    def supports(window: Column) -> Column:
        near = F.concat(F.right(window["left"], F.lit(C.DATE_WINDOW)), F.left(window["right"], F.lit(C.DATE_WINDOW)))
        around = F.concat(window["left"], window["right"])
        return ~near.rlike(DATE_OR_VERSION) & contains_any(around, C.METRIC_WORDS)

    return let(
        col(text),
        lambda value: value.rlike(NUMBER)
        & contains_any(value, C.METRIC_WORDS)
        & F.exists(number_windows(value), supports),
    )


def has_metric_table(text: Column | str) -> Column:
    """A markdown table with a metric word in its header and a number below."""
    tables = F.regexp_extract_all(col(text), F.lit(TABLE), F.lit(0))

    def is_metric_table(table: Column) -> Column:
        header = F.regexp_extract(table, TABLE_HEADER, 1)
        body = F.substr(table, F.length(header) + 2)
        return contains_any(header, C.METRIC_WORDS) & body.rlike(NUMBER)

    return F.exists(tables, is_metric_table)


def has_claims(text: Column | str) -> Column:
    """Does a README state measured results?"""

    def supports(section: Column) -> Column:
        return (
            section.rlike(NUMBER)
            & ~has_placeholder(section)
            & (has_number_near_metric(section) | has_metric_table(section))
        )

    def states_results(lowered: Column) -> Column:
        sections = let(
            claim_sections(lowered),
            lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.array(lowered)),
        )
        return has_yaml_metric(lowered) | F.exists(sections, supports)

    # Without a digit no rule can hold; most texts stop here.
    return col(text).rlike(r"\p{Nd}") & let(F.lower(col(text)), states_results)


# --- dataset and code ----------------------------------------------------------------


def has_python_signal(text: Column | str) -> Column:
    return contains_any(F.lower(col(text)), C.PYTHON_SIGNALS)


# --- dataset quality -----------------------------------------------------------------


def section_body(text: Column, headings: Sequence[str]) -> Column:
    """Body of the first section under the first heading pattern that matches;
    null when no heading does.
    """

    def under(heading: str, otherwise: Column) -> Column:
        pattern = section_pattern(heading)
        return let(
            F.regexp_substr(text, F.lit(pattern)),
            lambda section: F.when(
                section.isNotNull(), F.regexp_extract(section, pattern, 2)
            ).otherwise(otherwise),
        )

    body = F.lit(None).cast("string")
    for heading in reversed(headings):
        body = under(heading, body)
    # Texts without any heading skip the section patterns.
    return F.when(text.rlike(r"(?md)^[ \t]*#"), body)


def dataset_section(text: Column | str) -> Column:
    """Body of the section on training data; '' if missing or empty."""
    return F.coalesce(
        let(col(text), lambda value: section_body(value, C.DATASET_HEADINGS)), F.lit("")
    )


def quality_hits(text: Column | str) -> Column:
    """How many data-quality words occur; overlapping words count separately."""
    return F.size(words_found(text, C.QUALITY_WORDS))


def quality_share(hits: Column | str) -> Column:
    return F.least(F.lit(1.0), col(hits) / 4.0)


def all_found(found: Column | str, required: Sequence[str]) -> Column:
    """Is every required name among the ones found?"""
    return F.size(F.array_except(F.array(*map(F.lit, required)), col(found))) == 0


def dataset_quality_score(
    trusted: Column | str, hits: Column | str, described: Column | str
) -> Column:
    """Provenance ladder over the trusted datasets found, raised by the share of
    quality words. ``described``: a datasets entry or a data section exists.
    """
    found = col(trusted)
    share = quality_share(hits)
    strong = all_found(found, C.STRONG_DATASETS)
    score = (
        F.when(strong, F.least(F.lit(1.0), F.lit(0.9) + 0.05 + share * 0.05))
        .when(F.size(found) >= 2, F.least(F.lit(0.95), F.lit(0.8) + share * 0.15))
        .when(F.size(found) == 1, F.least(F.lit(0.9), F.lit(0.6) + share * 0.3))
        .when(col(described), F.least(F.lit(0.7), F.lit(0.4) + share * 0.3))
        .otherwise(0.0)
    )
    return let(score, round3)


# --- license -------------------------------------------------------------------------


def license_part(readme: Column | str) -> Column:
    """The part of a README that states the license, in lower case: the ``license:``
    line, else the license section, else everything.
    """

    def chosen(text: Column, low: Column) -> Column:
        line = F.when(low.contains("license"), F.regexp_extract(low, LICENSE_LINE, 1))
        section = F.lower(strip(section_body(text, [C.LICENSE_HEADING])))
        return let(
            line,
            lambda found: F.when(found != "", strip(found)).otherwise(F.coalesce(section, low)),
        )

    return let(strip(readme), lambda text: let(F.lower(text), lambda low: chosen(text, low)))


def license_text(readme: Column | str) -> Column:
    """``license_part`` with blanks and underscores as dashes."""
    return F.regexp_replace(license_part(readme), SPACES, "-")


# Part of a word once underscores are dashes, and \b as it is then.
LETTER = r"[a-z0-9[\w&&[^_]]]"
WORD_END = rf"(?:(?<={LETTER})(?!{LETTER})|(?<!{LETTER})(?={LETTER}))"


def _any_of(patterns: Sequence[str]) -> str:
    """One alternation of patterns that all are bounded words of two letters or more.

    A dash also stands for a run of blanks and underscores, so that texts need not
    be rewritten before they are searched.
    """
    words = [re.fullmatch(r"\\b([a-z]{2}.*)\\b", p).group(1) for p in patterns]
    first, second = ("".join(sorted({w[i] for w in words})) for i in (0, 1))
    dashed = [re.sub(r"\[-\\s\]|\(\?:-\|\\s\)|-", lambda _: r"(?:-|[\s_]++)", w) for w in words]
    return java("", rf"(?=[{first}][{second}])(?<!{LETTER})(?:{'|'.join(dashed)}){WORD_END}")


def license_class_score(text: Column | str) -> Column:
    """0 restrictive, 0.5 unclear, 1 permissive and compatible, else 0. Runs of blanks
    and underscores in a text count as dashes.
    """

    every = C.LICENSE_RESTRICTIVE + C.LICENSE_UNCLEAR + C.LICENSE_PERMISSIVE

    def score(value: Column) -> Column:
        # One pass settles texts that name no license at all.
        return (
            F.when(~value.rlike(_any_of(every)), 0.0)
            .when(value.rlike(_any_of(C.LICENSE_RESTRICTIVE)), 0.0)
            .when(value.rlike(_any_of(C.LICENSE_UNCLEAR)), 0.5)
            .when(
                value.rlike(_any_of(C.LICENSE_PERMISSIVE)),
                value.rlike(_any_of(C.LICENSE_COMPATIBLE)).cast("double"),
            )
            .otherwise(0.0)
        )

    return let(col(text), score)


def license_score(readme: Column | str) -> Column:
    text = col(readme)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(
        license_class_score(license_part(text))
    )


# --- reproducibility -------------------------------------------------------------------


def status_code(content: Column | str, lenient: bool = False) -> Column:
    """The status a response text reports, 0 when it reports none."""
    pattern = C.STATUS_CODE_LENIENT if lenient else C.STATUS_CODE
    found = F.regexp_extract(col(content), java("", pattern), 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0))


def response_content(body: Column | str) -> Column:
    return F.get_json_object(col(body), "$.choices[0].message.content")
