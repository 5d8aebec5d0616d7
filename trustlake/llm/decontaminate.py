"""Benchmark items in documents, up to a budget of edits.

An item of n characters may be changed by ``RATE * n`` edits. Split into one piece
more than that, it has a piece that no edit touches, so every occurrence contains
some piece exactly. One automaton finds the pieces of a block of items in a single
walk over each text, and Myers' bit-parallel distance verifies the item around
each hit. Case and the kind of white space do not count; offsets are code points
of the text, ends exclusive.

Items are taken in blocks of at most ``BLOCK_CHARS`` characters (or one item), so
what reaches a task is bounded; each block is one scan of the documents, without
a shuffle. Whole texts are searched, every hit is verified.

Defined results
    null or empty text, item     matches nothing
    item under MIN_CHARS         not searched: ordinary prose would match it
    null doc_id or item_id       kept as it is
    several occurrences          the least distance, then the first
    equal items, repeated rows   each has its own rows; repeats of an item row count once
    empty table                  no rows
    further columns              not read by ``find``; passed on by ``drop_leaks``
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import slices

RATE = 0.1
MIN_CHARS = 24
BLOCK_CHARS = 4_000_000

SCHEMA = "doc_id long, item_id long, distance int, start long, end long"
_SPACES = {i: " " for i in (*range(9, 14), 0x85, 0xA0, 0x2028, 0x2029)}
Item = tuple[int | None, str]


def normal(text: str) -> str:
    """Lower case, each white space as a space; as many characters as before."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.translate(_SPACES)


class Matcher:
    """The pieces of a block of items in one automaton.

    A hit is verified upwards: two neighbouring pieces with one edit, then four
    with three, up to the item. With fewer edits than pieces in the whole, one of
    the halves has fewer edits than pieces too, so no occurrence is lost, and a
    chance hit ends after a few letters.
    """

    def __init__(self, items: list[Item], rate: float = RATE):
        self.items = [(item_id, normal(text)) for item_id, text in items]
        self.budget = [int(rate * len(text)) for _, text in self.items]
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        self.steps: list[list[list[tuple[int, int, int]]]] = []
        places: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            parts = self.budget[k] + 1
            cuts = [len(text) * i // parts for i in range(parts + 1)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                places.setdefault(text[a:b], []).append((k, i, b))
            self.steps.append([self._above(i, cuts) for i in range(parts)])
        self.pieces = ahocorasick.Automaton()
        for piece, at in places.items():
            self.pieces.add_word(piece, at)
        if places:
            self.pieces.make_automaton()

    @staticmethod
    def _above(i: int, cuts: list[int]) -> list[tuple[int, int, int]]:
        """Begin, end and budget of the parts around piece ``i`` that halving makes, small first."""
        low, high, out = 0, len(cuts) - 1, []
        while high - low > 1:
            out.append((cuts[low], cuts[high], high - low - 1))
            middle = (low + high) // 2
            low, high = (low, middle) if i < middle else (middle, high)
        return out[:0:-1]

    def _masks(self, k: int, low: int, high: int) -> dict[str, int]:
        if (k, low, high) not in self.masks:
            self.masks[k, low, high] = _positions(self.items[k][1][low:high])
        return self.masks[k, low, high]

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item found its distance, start and end."""
        out: dict[int, tuple[int, int, int]] = {}
        if not self.items or not text:
            return out
        text = normal(text)
        seen: dict[int, tuple[int, int]] = {}
        for last, at in self.pieces.iter(text):
            for k, i, offset in at:
                item, spare = self.items[k][1], self.budget[k]
                zero = last + 1 - offset  # where the item begins if nothing is moved
                low, high = max(0, zero - spare), zero + len(item) + spare
                done = seen.get(k)
                if k in out and not out[k][0] or done and done[0] <= low and high <= done[1]:
                    continue
                for a, b, most in self.steps[k][i]:
                    part = text[max(0, zero + a - most) : zero + b + most]
                    if _myers(self._masks(k, a, b), b - a, part)[0] > most:
                        break
                else:
                    seen[k] = (low, high)
                    part = text[low:high]
                    distance, end = _myers(self._masks(k, 0, len(item)), len(item), part)
                    if distance <= spare:
                        back = _positions(item[::-1])
                        _, size = _myers(back, len(item), part[:end][::-1], anchored=True)
                        found = (distance, low + end - size, low + end)
                        out[k] = min(out.get(k, found), found)
        return out


def _positions(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _myers(masks: dict[str, int], n: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of a pattern of length ``n`` to a part of ``text``, and its end.

    ``anchored`` parts begin with the text; others begin anywhere.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 | anchored
        plus = (down << 1 | (full & ~(x | up))) & full
        minus = up & x & full
        if score < best:
            best, end = score, j
    return best, end


def _blocks(items: DataFrame, limit: int) -> list[list[Item]]:
    """Items worth searching, in blocks that the driver may hold one at a time."""
    size = F.length("text")
    usable = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        size >= MIN_CHARS
    ).distinct()
    total = usable.agg(F.sum(size)).first()[0] or 0
    number = -(-total // limit)
    dealt = usable.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, number))))
    return [
        [(r.item_id, r.text) for r in dealt.where(F.col("block") == b).orderBy("item_id", "text").collect()]
        for b in range(number)
    ]


_MATCHERS: dict[int, Matcher] = {}


def _matcher(items: list[Item], rate: float) -> Matcher:
    key = hash((tuple(items), rate))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate)
    return _MATCHERS[key]


def _find(items: list[Item], rate: float) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "distance", "start", "end"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for part in slices(batches, "text"):
            matcher = _matcher(items, rate)
            rows = [
                (doc_id, matcher.items[k][0], *found)
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True)
                for k, found in sorted(matcher.find(text or "").items())
            ]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def find(
    docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``doc_id, item_id, distance, start, end`` of each item in each document."""
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    parts = [texts.mapInArrow(_find(b, rate), SCHEMA) for b in _blocks(items, block_chars)]
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], SCHEMA)
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def drop_leaks(
    docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents, with all their columns, that hold none of the items."""
    mark = f"_text_{uuid.uuid4().hex}"
    schema = docs.schema
    for block in _blocks(items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block: list[Item] = block) -> Iterator:
            for part in slices(batches, mark):
                matcher = _matcher(block, rate)
                clean = [not matcher.find(t or "") for t in part.column(mark).to_pylist()]
                names = [n for n in part.schema.names if n != mark]
                yield part.select(names).filter(pa.array(clean, pa.bool_()))

        docs = docs.withColumn(mark, docs["text"]).mapInArrow(run, schema)
    return docs
