"""Spelling variants: words one edit apart, by composing finite-state acceptors.

The words are counted in the scan and become a vocabulary of distinct words. It
is cut into partitions by the states that an acceptor of it reaches by short
prefixes: a partition is a prefix with at most ``PARTITION`` words, and a prefix
with more is split by its next letter.

Inside a partition the words after the prefix become a minimised acceptor. The
composition acceptor, one-edit transducer, acceptor is walked from its initial
state: both sides read the same letters until the transducer makes its edit, where
the two words first differ, and after it they read the same letters again. Whether
two states accept a word in common is worked out once for each pair of states.

Pairs whose edit comes at a split state lie in two partitions. There the
composition is a join: both words have the same prefix, and after the edit the
same rest, so prefix and rest are the key. A key has at most one word for each
letter and one without. So every pair is found once, and no task holds more than
a partition.

Defined results
    null or empty text  no words
    null doc_id         written as nothing where a variant is drawn
    repeated rows       count once each
    very long texts     whole; very long words are words as others
    ties                the smallest word in code-point order is the form
    empty table         no rows
    further columns     not read
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import cut, groups, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# One run in so many, by its hash, loses a letter.
ONE_IN = 97
SHORTEST, RAREST = 5, 3
# Words that one partition holds, and distinct words that a task counts before it passes them on.
PARTITION = 1 << 13
HELD = 300_000
# Pairs that a task holds before it passes them on.
PAIRS = 1 << 16
ROUNDS = 64
PAIR = "a string, n_a long, b string, n_b long"


# --- the vocabulary -------------------------------------------------------------------------


def variant(doc_id: int | None, run: str) -> str:
    """The run in lower case, without a letter if its hash says so."""
    word = run.lower() if run.isascii() else run.translate(LOWER)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % ONE_IN:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"]
        )
        totals.clear()
        return batch

    for part in slices(batches, "text"):
        ids = part.column("doc_id").to_pylist()
        for doc_id, text in zip(ids, part.column("text").to_pylist(), strict=True):
            for run, n in Counter(RUN.findall(text or "")).items():
                word = variant(doc_id, run)
                if len(word) >= SHORTEST:
                    totals[word] += n
        if len(totals) > HELD:
            yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all distinct words that are long and frequent enough."""
    parts = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


# --- inside a partition ---------------------------------------------------------------------

State = tuple[bool, tuple[tuple[str, int], ...]]


def minimised(words: list[str]) -> tuple[list[State], int]:
    """The smallest acceptor of sorted distinct words: its states (accepts, arcs) and the first one."""
    register: dict[State, int] = {}
    path: list[tuple[list[tuple[str, int]], bool]] = [([], False)]  # states of the last word
    last = ""

    def close(depth: int) -> None:
        """Settle the states below ``depth`` on the path of the last word."""
        while len(path) > depth + 1:
            arcs, accepts = path.pop()
            state = register.setdefault((accepts, tuple(arcs)), len(register))
            path[-1][0].append((last[len(path) - 1], state))

    for word in words:
        depth, least = 0, min(len(word), len(last))
        while depth < least and word[depth] == last[depth]:
            depth += 1
        close(depth)
        path.extend(([], False) for _ in word[depth:])
        path[-1] = (path[-1][0], True)
        last = word
    close(0)
    first = register.setdefault((path[0][1], tuple(path[0][0])), len(register))
    return list(register), first


class Composition:
    """Acceptor, one-edit transducer, acceptor. Nothing recurs, as words may be very long."""

    def __init__(self, words: list[str]):
        states, self.first = minimised(words)
        self.accepts = [accepts for accepts, _ in states]
        self.arcs = [dict(arcs) for _, arcs in states]
        self.known: dict[tuple[int, int], bool] = {}

    def steps(self, x: int, y: int) -> Iterator[tuple[str, int, int]]:
        """What both states read next."""
        one, two = self.arcs[x], self.arcs[y]
        return ((letter, one[letter], two[letter]) for letter in one.keys() & two.keys())

    def meet(self, x: int, y: int) -> bool:
        """Is there a word that both states accept? Every state accepts some."""
        known, accepts = self.known, self.accepts
        stack = [((x, y), self.steps(x, y))]
        if x == y or (accepts[x] and accepts[y]):
            return True
        if (x, y) in known:
            return known[x, y]
        while stack:
            pair, steps = stack[-1]
            for _, z, w in steps:
                found = True if z == w or (accepts[z] and accepts[w]) else known.get((z, w))
                if found:
                    known.update((p, True) for p, _ in stack)
                    return True
                if found is None:
                    stack.append(((z, w), self.steps(z, w)))
                    break
            else:
                known[pair] = False
                stack.pop()
        return False

    def common(self, x: int, y: int) -> Iterator[str]:
        """The words that both states accept."""
        path: list[str] = []
        stack = [(0, "", x, y)] if self.meet(x, y) else []
        while stack:
            depth, letter, x, y = stack.pop()
            path[max(0, depth - 1) :] = letter
            if self.accepts[x] and self.accepts[y]:
                yield "".join(path)
            stack += [(depth + 1, c, z, w) for c, z, w in self.steps(x, y) if self.meet(z, w)]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words that are one edit apart, each once."""
        path: list[str] = []
        stack = [(0, "", self.first)]
        while stack:
            depth, letter, state = stack.pop()
            path[max(0, depth - 1) :] = letter
            arcs = list(self.arcs[state].items())
            for i, (a, x) in enumerate(arcs):
                for b, y in arcs[i + 1 :]:  # another letter
                    if self.meet(x, y):
                        prefix = "".join(path)
                        for rest in self.common(x, y):
                            yield prefix + a + rest, prefix + b + rest
                # One letter more. The words first differ there, so the other one goes on unlike it.
                if self.accepts[x] and self.accepts[state]:
                    prefix = "".join(path)
                    yield prefix + a, prefix
                for c, z, w in self.steps(x, state):
                    if c != a and self.meet(z, w):
                        prefix = "".join(path)
                        for rest in self.common(z, w):
                            yield prefix + a + c + rest, prefix + c + rest
                stack.append((depth + 1, a, x))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64()) * 2, strict=True)],
            ["a", "n_a", "b", "n_b"],
        )
        held.clear()
        return batch

    for group in groups(batches, "leaf"):
        if group.num_rows < 2:
            continue
        start = len(group.column("leaf")[0].as_py())
        number = dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist(), strict=True))
        head = next(iter(number))[:start]
        for x, y in Composition([w[start:] for w in sorted(number)]).pairs():
            x, y = head + x, head + y
            held.append((x, number[x], y, number[y]))
            if len(held) >= PAIRS:
                yield out()
    if held:
        yield out()


# --- across partitions ----------------------------------------------------------------------


def partitions(words: DataFrame, most: int = PARTITION) -> tuple[DataFrame, DataFrame]:
    """``words`` with their ``leaf``, the shortest prefix of at most ``most`` words, and the
    same words once for each longer prefix that was split, as ``prefix, rest, letter``.

    ``rest`` is what follows with the letter after the prefix (``letter`` is that
    letter, ``dropped`` is false) and without it (``dropped`` is true).
    """
    leaves, split, level, depth = [], [], words, 0
    while True:
        head = F.substring("word", 1, depth)
        full = level.groupBy(head.alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
        full = cut(full.where(F.col("_n") > most).select("_head"), "full-prefixes")
        leaves.append(level.join(full, head == F.col("_head"), "left_anti").withColumn("leaf", head))
        if full.isEmpty():
            break
        level = cut(level.join(full, head == F.col("_head"), "left_semi"), "split-words")
        letter = F.substring("word", depth + 1, 1)
        longer = F.length("word") > depth
        whole = level.withColumns(
            {"prefix": head, "letter": letter, "rest": F.substr("word", F.lit(depth + 1)), "dropped": F.lit(False)}
        )
        short = level.where(longer).withColumns(
            {"prefix": head, "letter": letter, "rest": F.substr("word", F.lit(depth + 2)), "dropped": F.lit(True)}
        )
        split += [whole, short]
        level = level.where(longer)
        depth += 1

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    empty = words.selectExpr(
        "word", "n", "word prefix", "word letter", "word rest", "true dropped"
    ).limit(0)
    return union(leaves), union(split or [empty])


def near_pairs(words: DataFrame, most: int = PARTITION) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of words that are one edit apart, once.

    ``words`` has distinct ``word`` and their ``n``; it is read several times, so
    pass a table or a ``cut`` result.
    """
    leaves, split = partitions(words, most)
    # As many tasks as there are partitions of a shuffle: the work is in the words, not in their bytes.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = leaves.select("leaf", "word", "n").repartition(tasks, "leaf").sortWithinPartitions("leaf", "word")
    inside = dealt.mapInArrow(_compose, PAIR)
    one = split.where("dropped").select("prefix", "rest", F.col("word").alias("a"), F.col("n").alias("n_a"),
                                        F.col("letter").alias("letter_a"))
    two = split.select("prefix", "rest", F.col("word").alias("b"), F.col("n").alias("n_b"),
                       F.col("letter").alias("letter_b"), "dropped")
    # Another letter at the split, counted from one side; or none, and the words go on unlike it.
    apart = (F.col("dropped") & (F.col("letter_a") < F.col("letter_b"))) | (
        ~F.col("dropped") & (F.col("letter_a") != F.col("letter_b"))
    )
    across = one.join(two, ["prefix", "rest"]).where(apart).select("a", "n_a", "b", "n_b")
    return inside.unionByName(across)


# --- groups ---------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word with a form: the end of its chain of forms.

    Chains are shortened by half in each round. As a form is at least twice as
    frequent as its word, they are no longer than the logarithm of a count.
    """
    found = cut(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        on = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        hop = cut(found.join(on, "root", "left"), "hops")
        if hop.where("_next is not null").isEmpty():
            return found
        found = hop.select("word", F.coalesce("_next", "root").alias("root"))
    raise RuntimeError(f"chains of forms did not end in {ROUNDS} rounds")


def group_variants(docs: DataFrame, most: int = PARTITION) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the documents."""
    words = cut(vocabulary(docs), "words")
    pairs = near_pairs(words, most)
    both = pairs.select(
        F.explode(F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")),
        )).alias("p")
    ).select("p.*")
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best")
    )
    strong = -F.col("best.m") >= 2 * F.col("n")
    table = cut(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(table.where("form is not null"))
    return table.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
