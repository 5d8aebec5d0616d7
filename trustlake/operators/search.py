"""Regular-expression search over artifact names and READMEs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.guard import unsafe_reason
from trustlake.functions.numeric import col
from trustlake.functions.text import words_found
from trustlake.operators import trigrams as tri
from trustlake.operators.joins import CELLS, dealt_join, grown_join, lookup_join, spread_join
from trustlake.sources.facts import digest
from trustlake.sources.scratch import saved


# What Python's syntax has, outside and inside of brackets, that needs other words here.
_PART = re.compile(
    r"""(?P<comment>\(\?\#[^)]*\))
      | \(\?P<(?P<name>\w+)>
      | \(\?P=(?P<back>\w+)\)
      | (?P<flags>\(\?(?=[aiLmsux-]+[:)])(?P<letters>[aiLmsux-]+))
      | (?P<condition>\(\?\()
      | (?P<open>\((?!\?))
      | \\(?P<escape>x..|u....|U.{8}|N\{[^}]*\}|[0-7]{1,3}|[89]|.)
      | (?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])
      | \{(?P<low>\d*)(?P<comma>,?)(?P<high>\d*)\}
      | (?P<brace>[{}])
      | (?P<other>.)""",
    re.X | re.S,
)
_IN_SET = re.compile(r"\\(?P<escape>x..|u....|U.{8}|[0-7]{1,3}|.)|(?P<other>.)", re.S)
_CONTROLS = {"a": 7, "f": 12, "v": 11, "b": 8}


def java_pattern(pattern: str) -> str:
    """The pattern in Java's syntax, with the flags that give it its Python meaning.

    Named groups become numbered ones. Raises ``ValueError`` for what Python does
    not compile and for what has no equivalent: conditional groups, names of
    characters, and the flags for ASCII, locale and verbose patterns.
    """
    try:
        groups = re.compile(pattern, re.IGNORECASE).groupindex
    except (re.error, OverflowError, RecursionError) as error:
        raise ValueError(f"Invalid regex: {error}") from error
    out = []
    for m in _PART.finditer(pattern):
        escape = m["escape"]
        if m["comment"]:
            continue
        if m["condition"] or set(m["letters"] or "") & set("aLx"):
            raise ValueError(f"Unsupported regex: {m[0]}")
        if m["letters"]:
            out.append("(?" + (m["letters"].replace("u", "") or "U"))
        elif m["name"] or m["open"]:
            out.append("(")
        elif m["back"]:
            out.append(f"(?:\\{groups[m['back']]})")
        elif escape:
            out.append(_escape(escape))
        elif m["set"]:
            out.append(_set(m["set"]))
        elif m["low"] is not None:
            given = m["low"] or m["high"]
            out.append(f"{{{m['low'] or 0}{m['comma']}{m['high']}}}" if given else "\\{" + m[0][1:-1] + "\\}")
        else:
            out.append("\\" + m["brace"] if m["brace"] else m["other"])
    return "(?iudU)" + "".join(out)


def _escape(escape: str, in_set: bool = False) -> str:
    if escape[0] == "N":
        raise ValueError("Unsupported regex: \\N{...}")
    if escape == "Z":
        return r"\z"
    if escape[0] == "U":
        return f"\\x{{{escape[1:]}}}"
    if escape in _CONTROLS and (in_set or escape != "b"):
        return f"\\x{_CONTROLS[escape]:02x}"
    if escape[0] == "0" or (escape[0] in "1234567" and (in_set or len(escape) == 3)):
        return f"\\x{{{int(escape, 8):x}}}"  # a number of three digits is a character, as in a set
    if escape[0] in "123456789":
        return f"(?:\\{escape})" if escape.isdecimal() else f"\\{escape}"
    return "\\" + escape


def _set(text: str) -> str:
    """A set of characters; Java reads some plain ones as operators."""
    head = "[^" if text.startswith("[^") else "["
    body = []
    for m in _IN_SET.finditer(text[len(head) : -1]):
        if m["escape"]:
            body.append(_escape(m["escape"], in_set=True))
        else:
            body.append("\\" + m["other"] if m["other"] in "[]&~^" else m["other"])
    return head + "".join(body) + "]"


def check_pattern(df: DataFrame, pattern: str) -> None:
    """Raise for an empty, invalid or unsafe pattern (one-row job, no data is read)."""
    if not pattern:
        raise ValueError("Missing 'regex' field")
    java_pattern(pattern)
    reason = df.sparkSession.range(1).select(unsafe_reason(F.lit(pattern))).first()[0]
    if reason:
        raise ValueError(f"Unsafe regex: {reason}")


def matches(text: Column | str, pattern: str) -> Column:
    """Case-insensitive search. A literal without letters or special characters
    runs as a substring test.
    """
    if re.fullmatch(r"[0-9 _-]+", pattern):
        return F.contains(col(text), F.lit(pattern))
    return col(text).rlike(java_pattern(pattern))


def search_names(name_index: DataFrame, pattern: str) -> DataFrame:
    return name_index.where(matches("name", pattern)).select("name", "id", "type")


def search_readmes(readmes: DataFrame, pattern: str) -> DataFrame:
    """Keys of the READMEs that match; the text stays in the scan stage."""
    return readmes.where(matches("text", pattern)).select(
        "type", F.col("id").cast("string").alias("id")
    )


def last_names(name_index: DataFrame) -> DataFrame:
    """Name on the last index line of each id. Maxima combine on the map side."""
    return name_index.groupBy("id").agg(F.max_by("name", "seq").alias("name"))


def name_hits(hits: DataFrame, name_index: DataFrame) -> DataFrame:
    """Attach the last indexed name to hits by id."""
    named = lookup_join(hits.select("type", "id"), last_names(name_index), ["id"])
    return named.select(F.coalesce("name", F.lit(C.UNKNOWN_NAME)).alias("name"), "id", "type")


def search(
    name_index: DataFrame, readmes: DataFrame, pattern: str, dedupe: bool = False
) -> DataFrame:
    """Name hits and README hits; an artifact may appear once for each.

    ``hit_source`` tells them apart. ``dedupe`` keeps one row per artifact.
    """
    check_pattern(name_index, pattern)
    return hits(name_index, search_readmes(readmes, pattern), pattern, dedupe)


def hits(
    name_index: DataFrame, readme_hits: DataFrame, pattern: str, dedupe: bool = False
) -> DataFrame:
    """Name hits of a checked pattern, together with README hits (type, id)."""
    by_name = search_names(name_index, pattern).withColumn("hit_source", F.lit("name"))
    by_readme = name_hits(readme_hits, name_index).withColumn("hit_source", F.lit("readme"))
    found = by_name.unionByName(by_readme)
    if not dedupe:
        return found
    return found.groupBy("type", "id").agg(
        F.max("name").alias("name"), F.min("hit_source").alias("hit_source")
    )


def safe_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.where(unsafe_reason("regex").isNull())


def check_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("reason", unsafe_reason("regex"))


# Rows of a table of patterns that are read at a time, and patterns or words that may go by one trigram.
GATHERED, CROWD = 1 << 16, 16
_ANCHOR = "key string, word boolean, grams array<string>, longs array<string>, ids array<int>, tags array<long>"


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What to look for: a pattern, or a word that decides alone on the patterns that are choices
    of words; with the trigrams (or longer pieces) of its cover, null where there is none, and
    the ids of many patterns, whose regexes the ``tags`` tell apart. Patterns that do not compile have no row.
    """

    @lru_cache(GATHERED)
    def one(word: str) -> tuple:
        covers = [sorted(tri.cover(tri.of_strings([word], size))) for size in (tri.SIZE, tri.LONG)]
        return java_pattern(re.escape(word)), True, *covers

    def sought(regex: str) -> list[tuple]:
        try:
            java, words = java_pattern(regex), tri.words(regex) or ()
            if len(words) > 1:
                return [one(word) for word in words]
            found = [tri.cover(tri.required(regex, size)) for size in (tri.SIZE, tri.LONG)]
        except ValueError:
            return []
        return [(java, False, *(cover and sorted(cover) for cover in found))]

    def gathered(rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple, tuple] = {}
        for regex, ids in rows.groupby("regex", sort=False)["pattern_id"]:
            tag = int.from_bytes(hashlib.blake2b(regex.encode(), digest_size=8).digest(), signed=True)
            for key, word, grams, longs in sought(regex):
                row = found.setdefault((key, word), (key, word, grams, longs, [], []))
                row[4].extend(None if pd.isna(i) else int(i) for i in ids)
                row[5].extend([tag] * len(ids) if word else [])
        return pd.DataFrame(found.values(), columns=["key", "word", "grams", "longs", "ids", "tags"])

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= GATHERED:
            yield gathered(pd.concat(held))
            held = []
    if held:
        yield gathered(pd.concat(held))


def _ties(anchors: DataFrame) -> DataFrame:
    """(key, word, gram): by which pieces a pattern or word meets texts. A trigram by which many go
    tells them apart no more, so those go by longer pieces.
    """
    short = anchors.select("key", "word", F.explode("grams").alias("gram")).distinct()
    crowd = short.groupBy("gram").count().where(F.col("count") > CROWD).select("gram")
    crowded = short.join(crowd, "gram").select("key", "word").distinct()
    longs = anchors.join(crowded, ["key", "word"], "left_semi").select("key", "word", F.explode("longs").alias("gram"))
    return short.join(crowded, ["key", "word"], "left_anti").unionByName(longs.distinct())


def matched_texts(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(_digest, key, word): every text (_digest, _text) with every pattern that it matches
    and every word that it holds, each once however often it occurs.
    """
    bare = anchors.where("grams is null").select("key", "word").distinct()
    ties = saved(_ties(anchors), "ties")
    longer = not ties.where(F.length("gram") > tri.SIZE).isEmpty()
    # Texts stay in the scan; their pieces meet those of the patterns, without them.
    body = F.col("_text")
    pieces = F.concat(*[tri.trigrams(body, size) for size in (tri.SIZE, tri.LONG)]) if longer else tri.trigrams(body)
    found = texts.select("_digest", F.explode(pieces).alias("_grams"))
    found = found.select("_digest", F.explode("_grams").alias("gram")).join(ties.select("gram").distinct(), "gram")
    pairs = grown_join(saved(found.distinct(), "pieces"), ties, ["gram"], "_digest")
    once = texts.dropDuplicates(["_digest"])
    by_gram = pairs.select("_digest", "key", "word").distinct().join(once, "_digest")
    # Patterns come one after another, so each is compiled once a cell.
    by_cell = spread_join(once, bare, [], "_digest")
    matched = [df.where(F.regexp_like(body, F.col("key"))).select("_digest", "key", "word") for df in (by_gram, by_cell)]
    return matched[0].unionAll(matched[1])


def _lists(matched: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_digest, _list) and (_list, ids): which lists of pattern ids a text gets, each id in one of them.

    A pattern has its ids. Words share patterns, so the words of a text are one list, as many texts
    as hold the same: the ids of all their patterns, each once.
    """
    own = matched.where("not word").select("_digest", F.col("key").alias("_list"))
    held = matched.where("word").groupBy("_digest").agg(F.array_sort(F.collect_set("key")).alias("words"))
    held = held.withColumn("_list", F.sha2(F.to_json("words"), 256))
    several = held.select("_list", "words").distinct().select("_list", F.explode("words").alias("key"))
    asked = several.join(anchors.where("word"), "key").select("_list", F.inline(F.arrays_zip("ids", "tags")))
    cell = F.pmod(F.xxhash64("ids"), F.lit(CELLS))
    unions = asked.groupBy("_list", cell.alias("_part")).agg(F.collect_set(F.struct("ids", "tags"))["ids"].alias("ids"))
    lists = anchors.where("not word").select(F.col("key").alias("_list"), "ids").unionByName(unions.drop("_part"))
    return own.unionByName(held.select("_digest", "_list")), lists


def multi_search(documents: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """Every document with every pattern of a table (pattern_id, regex) that it matches.

    Patterns that are unsafe or do not compile match nothing. Each pattern is
    reduced to a few trigrams or, where many share one, longer pieces, one of which any
    matching text holds; texts and patterns, each once however often it occurs, meet by
    those, and the pattern decides on the pairs that remain. Of patterns that are a choice
    of words each word is looked for once. Patterns without such pieces meet all texts,
    which are dealt into cells for that. Rows and pattern ids come last, ids as lists that
    are taken apart where a row meets them. Nothing is held in the driver. ``documents`` is
    read several times; pass a scan. Patterns are read once, and what they need is written.
    """
    key, body = digest(text), F.col(text)
    tasks = int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = (
        safe_patterns(patterns.select(F.col("pattern_id").cast("int").alias("pattern_id"), "regex"))
        .where(F.length("regex") > 0)
        .repartition(tasks, "pattern_id", "regex")
        .distinct()
        .mapInPandas(_anchors, _ANCHOR)
    )
    anchors = saved(anchors, "anchors")
    texts = documents.where(body.isNotNull()).select(key.alias("_digest"), body.alias("_text"))
    rows = documents.where(body.isNotNull()).withColumn("_digest", key).drop(text)
    names = [c for c in documents.columns if c != text]
    by = F.struct(*names) if names else F.lit(0)
    hits, lists = _lists(saved(matched_texts(texts, anchors), "matched"), anchors)
    hits = saved(dealt_join(rows, hits, ["_digest"], by).drop("_digest"), "hits")
    return grown_join(hits, lists, ["_list"], by).select(*names, F.explode("ids").alias("pattern_id"))


def keyword_matches(documents: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Every document with every dictionary word that occurs in it."""
    found = words_found(F.lower(text), words)
    return documents.withColumn("word", F.explode(found)).drop(text)
