"""Toxicity by the nearest labelled examples.

Documents are TF-IDF vectors over all their words, and over the word beginnings that
go with the label. A word that goes with the label in the labelled sample weighs more,
by one plus the root of its log-likelihood ratio; no word is left out. The nearest
examples by exact cosine are found among all examples: products with the most
frequent terms by a dense matrix, those with the others by an inverted index, both in
single precision; whatever may be among the nearest by the rounding error is then
summed again in double precision. Each neighbour votes with its cosine, and votes are
calibrated on the examples themselves, each left out of its own vote.

``SAMPLE`` labelled documents, dealt by a hash of their number, make the fitted part:
the examples with all their words. How many documents hold each term is counted over
all documents. Words that no example holds make a document's vector longer, each as if
no other document held it. Up to ``TERMS`` terms that go with the label clearly are
named as evidence; they do not decide who is searched.

Defined results
    null, empty text, no word   no neighbour; the rate of label 1 among such examples
    no word of any example      no neighbour; the calibrated vote of none
    nothing learned             score 0
    equal cosine                the smaller example first
    repeated labels             label 1 if any row says so
    null label or doc_id        not learned from; the document is scored all the same
    repeated rows               one row each
    empty table                 no rows
    further columns             not read
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import cut, slices

SAMPLE = 20_000
TERMS = 512
# Least log-likelihood ratio (G squared) of a term named as evidence: chance below one in a million.
ASSOCIATION = 25.0
LEAST = 3
# Letters of a word's beginning; longer words have it as a term of its own.
STEM = 5
NEIGHBOURS = 16
# Documents that are scored side by side.
BLOCK = 64
# Most frequent terms, whose weights are held as a dense matrix.
DENSE = 512
# Shorter lists of postings are added in one go for all terms of a document.
SHORT = 256
# More than single precision can lose in a cosine, twice.
ROUNDING = 2e-4
# A vote of this weight for the overall rate, so that few far neighbours say little.
PRIOR = 0.5
BINS = 10

_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = (
    "doc_id long, score double, predicted int, neighbours array<long>, "
    "cosines array<double>, terms array<string>"
)


class Fitted(NamedTuple):
    """What scoring needs; bounded by ``SAMPLE`` and the words of its documents."""

    terms: list[str]  # the first ones at least, which are named as evidence
    idf: Sequence[float]  # times the weight by label; the last is that of words in no example
    examples: list[tuple[int, int, Sequence[int], Sequence[int]]]  # doc_id, label, terms, counts
    without: float  # rate of label 1 among examples without a word
    overall: float
    levels: list[tuple[float, float]] = []  # calibration
    strong: int = 0  # terms named as evidence


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def stem(word: str) -> str:
    return word[:STEM] + "*"


def sample(labelled: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``doc_id, label`` of at most ``size`` documents, dealt by a hash of their number."""
    known = labelled.where("doc_id is not null and label is not null")
    return (
        known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a task hold each word and beginning, and how many with label 1."""
    for batch in batches:
        seen: Counter[str] = Counter()
        ones: Counter[str] = Counter()
        for text, label in zip(*(batch.column(c).to_pylist() for c in ("text", "label")), strict=True):
            found = set(words(text))
            found |= {stem(w) for w in found if len(w) > STEM}
            seen.update(found)
            if label:
                ones.update(found)
        terms = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([seen[t] for t in terms], pa.int64()),
             pa.array([ones[t] for t in terms], pa.int64())],
            ["term", "n", "k"],
        )


def vocabulary(learned: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """All words of ``text, label``, each with its weight by label, from 1.

    Terms that go with label 1 clearly, among them word beginnings, come first, strongest
    first; their number is the last result.
    """
    total, ones = learned.agg(F.count(F.lit(1)), F.sum("label")).first()
    ones = ones or 0
    counts = (
        learned.select("text", "label").mapInArrow(_term_counts, "term string, n long, k long")
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    )

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, k = F.col("n"), F.col("k")
    rest, zeros = F.lit(total) - n, total - ones
    ratio = 2 * (
        part(k, n * ones / total) + part(n - k, n * zeros / total)
        + part(ones - k, rest * ones / total) + part(rest - ones + k, rest * zeros / total)
    ) if ones and zeros else F.lit(0.0)
    known = counts.withColumn(
        "ratio", F.when((k >= LEAST) & (k * total > n * ones), F.greatest(ratio, F.lit(0.0))).otherwise(0.0)
    ).where((F.col("ratio") >= ASSOCIATION) | ~F.endswith("term", F.lit("*")))
    found = known.select("term", "n", "ratio").toArrow()  # the words of SAMPLE documents
    clear = pc.greater_equal(found["ratio"], ASSOCIATION)
    strong = found.filter(clear).sort_by([("ratio", "descending"), ("term", "ascending")])
    plain = pc.invert(pc.ends_with(found["term"], "*"))
    rows = pa.concat_tables(
        [
            strong[:TERMS],
            pa.concat_tables([strong[TERMS:].filter(pc.invert(pc.ends_with(strong[TERMS:]["term"], "*"))),
                              found.filter(pc.and_(plain, pc.invert(clear)))])
            .sort_by([("n", "descending"), ("term", "ascending")]),
        ]
    )
    gain = 1 + np.sqrt(rows["ratio"].to_numpy())
    gain[pc.ends_with(rows["term"], "*").to_numpy()] = 1.0  # its words have the weight
    return rows["term"].to_pylist(), gain, min(len(strong), TERMS)


def _vectors(terms: list[str]) -> Callable[[Iterator], Iterator]:
    """``doc_id`` with the numbers and counts of the terms in its text, and ``rest``: the
    squares of what its other words weigh before idf, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = {t[:-1]: i for i, t in enumerate(terms) if t[-1:] == "*"}
        # The number of each word and of its beginning, found together.
        number = {
            t: (i, begins.get(t[:STEM]) if len(t) > STEM else None)
            for i, t in enumerate(terms) if t[-1:] != "*"
        }

        def vector(text: str | None) -> tuple[list[int], list[int], float]:
            found: dict[int, int] = {}
            rest = []
            once = 0  # other words that occur once, of weight 1
            for w, c in Counter(words(text)).items():
                known = number.get(w)
                if known is not None:
                    k, begin = known
                    found[k] = c
                else:
                    if c == 1:
                        once += 1
                    else:
                        rest.append(c)
                    begin = begins.get(w[:STEM]) if len(w) > STEM else None
                if begin is not None:
                    found[begin] = found.get(begin, 0) + c
            held = sorted(found)
            squares = sum(((1 + math.log(c)) ** 2 for c in sorted(rest)), float(once))
            return held, [found[t] for t in held], squares

        for part in slices(batches, "text"):
            rows = [vector(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[2] for r in rows], pa.float64())],
                ["doc_id", "held", "counts", "rest"],
            )

    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a task hold each term; a row for each term, not for each pair."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        now = np.bincount(batch.column("held").flatten().to_numpy(), minlength=len(seen))
        now[: len(seen)] += seen
        seen = now
    terms = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.int32()), pa.array(seen[terms], pa.int64())], ["t", "n"]
    )


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column, as arrays."""
    values = column.flatten().to_numpy()
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(column) else []


class Index:
    """The examples by term: a dense matrix for the ``DENSE`` most frequent terms, postings
    for the others, and the vectors themselves. Equal vectors are held once."""

    def __init__(self, fitted: Fitted):
        self.fitted = fitted
        self.idf = np.asarray(fitted.idf, np.float64)
        self.labels = np.array([e[1] for e in fitted.examples])
        places: dict[bytes, int] = {}
        self.members: list[list[int]] = []
        firsts = []
        for i, (_, _, terms, counts) in enumerate(fitted.examples):
            digest = hashlib.sha256(np.asarray(terms, np.int32).tobytes())
            digest.update(np.asarray(counts, np.int32).tobytes())
            place = places.setdefault(digest.digest(), len(firsts))
            if place == len(firsts):
                firsts.append(i)
                self.members.append([])
            if len(self.members[place]) <= NEIGHBOURS:  # one may be left out
                self.members[place].append(i)
        size, self.n = len(self.idf), len(firsts)
        lengths = [len(fitted.examples[i][2]) for i in firsts]
        self.at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        self.terms = np.zeros(self.at[-1], np.int32)
        self.weights = np.zeros(self.at[-1])
        for i, a, b in zip(firsts, self.at[:-1].tolist(), self.at[1:].tolist(), strict=True):
            self.terms[a:b], self.weights[a:b] = self.unit(*fitted.examples[i][2:])
        seen = np.bincount(self.terms, minlength=size)
        often = np.argsort(-seen, kind="stable")[:DENSE]
        self.column = np.full(size, -1, np.int64)
        self.column[often] = np.arange(len(often))
        owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.at))
        dense = self.column[self.terms] >= 0
        self.matrix = np.zeros((len(often), self.n), np.float32)
        self.matrix[self.column[self.terms[dense]], owner[dense]] = self.weights[dense]
        order = np.flatnonzero(~dense)
        order = order[np.argsort(self.terms[order], kind="stable")]
        self.starts = np.searchsorted(self.terms[order], np.arange(size + 1))
        self.places, self.held = owner[order].astype(np.int64), self.weights[order].astype(np.float32)
        self.query = np.zeros(size)

    def unit(
        self, terms: Sequence[int], counts: Sequence[int], rest: float = 0.0
    ) -> tuple[np.ndarray, np.ndarray]:
        """A vector of length 1, or less for the words in ``rest``, which meet no example."""
        held = np.asarray(terms, np.int64)
        raw = (1 + np.log(np.asarray(counts, np.float64))) * self.idf[held]
        norm = math.sqrt(float((raw * raw).sum()) + rest * float(self.idf[-1]) ** 2)
        return held, raw / (norm or 1.0)

    def nearest(
        self, terms: np.ndarray, weights: np.ndarray, leave: int = -1
    ) -> list[tuple[float, int]]:
        """The ``NEIGHBOURS`` best examples by cosine, then number, each with its cosine."""
        return self.search([(terms, weights)], [leave])[0]

    def search(
        self, queries: list[tuple[np.ndarray, np.ndarray]], leave: list[int] | None = None
    ) -> list[list[tuple[float, int]]]:
        """The nearest examples of each vector."""
        if not self.n:
            return [[] for _ in queries]
        dense = np.zeros((len(queries), len(self.matrix)), np.float32)
        for row, (terms, weights) in zip(dense, queries, strict=True):
            column = self.column[terms]
            row[column[column >= 0]] = weights[column >= 0]
        out = []
        left = leave or [-1] * len(queries)
        for sums, (terms, weights), without in zip(dense @ self.matrix, queries, left, strict=True):
            low, high = self.starts[terms], self.starts[terms + 1]
            size = high - low
            many = size > SHORT
            for a, b, w in zip(
                low[many].tolist(), high[many].tolist(), weights[many].astype(np.float32), strict=True
            ):
                sums[self.places[a:b]] += w * self.held[a:b]
            size[many] = 0
            at = np.arange(int(size.sum())) + np.repeat(low - np.cumsum(size) + size, size)
            sums += np.bincount(self.places[at], self.held[at] * np.repeat(weights, size), self.n)
            out.append(self._best(sums, terms, weights, without))
        return out

    def _best(
        self, sums: np.ndarray, terms: np.ndarray, weights: np.ndarray, leave: int
    ) -> list[tuple[float, int]]:
        """The best by cosines in double precision, of all that ``sums`` leaves possible."""
        worst = 0.0
        if self.n > NEIGHBOURS + 1:  # one more, as one may be left out
            worst = np.partition(sums, self.n - NEIGHBOURS - 1)[self.n - NEIGHBOURS - 1] - ROUNDING
        near = np.flatnonzero((sums >= worst) & (sums > 0))
        size = self.at[near + 1] - self.at[near]
        ends = np.cumsum(size)
        at = np.arange(int(size.sum())) + np.repeat(self.at[near] - ends + size, size)
        self.query[terms] = weights
        products = self.query[self.terms[at]] * self.weights[at]
        self.query[terms] = 0
        cosines = np.round(np.bincount(np.repeat(np.arange(len(near)), size), products, len(near)), 12)
        best: list[tuple[float, int]] = []
        last = 0.0
        for j in np.argsort(-cosines, kind="stable").tolist():
            c = float(cosines[j])
            if c <= 0 or (len(best) >= NEIGHBOURS and c < last):
                break
            best += [(-c, i) for i in self.members[near[j]] if i != leave]
            last = c
        return [(-c, i) for c, i in sorted(best)[:NEIGHBOURS]]

    def vote(self, near: list[tuple[float, int]]) -> float:
        for_one = sum(c for c, i in near if self.labels[i])
        return (for_one + PRIOR * self.fitted.overall) / (sum(c for c, _ in near) + PRIOR)


def calibration(votes: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """Mean vote and share of label 1 in up to ``BINS`` bins, never falling.

    Adjacent bins that would fall are merged.
    """
    out: list[list[float]] = []  # sum of votes, ones, rows
    for i in range(BINS):
        part = votes[len(votes) * i // BINS : len(votes) * (i + 1) // BINS]
        if part:
            out.append([sum(v for v, _ in part), sum(y for _, y in part), len(part)])
            while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
                last = out.pop()
                out[-1] = [a + b for a, b in zip(out[-1], last, strict=True)]
    return [(v / n, (k + 0.5) / (n + 1)) for v, k, n in out]


def calibrated(vote: float, levels: list[tuple[float, float]]) -> float:
    if not levels:
        return vote
    if vote <= levels[0][0]:
        return levels[0][1]
    for (a, low), (b, high) in zip(levels, levels[1:], strict=False):
        if vote <= b:
            return low + (high - low) * (vote - a) / (b - a) if b > a else high
    return levels[-1][1]


_INDEXES: dict[str, Index] = {}


def _index(key: str, fitted: Broadcast) -> Index:
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(fitted.value)
    return _INDEXES[key]


def _votes(key: str, fitted: Broadcast) -> Callable[[Iterator], Iterator]:
    """The vote on each example without itself, and its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, fitted)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                numbers = batch.column("number").slice(start, BLOCK).to_pylist()
                queries = [index.unit(*index.fitted.examples[i][2:]) for i in numbers]
                votes = [index.vote(near) for near in index.search(queries, numbers)]
                labels = [int(index.labels[i]) for i in numbers]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(votes, pa.float64()), pa.array(labels, pa.int32())], ["vote", "label"]
                )

    return run


def _score(
    key: str, fitted: Broadcast, levels: list[tuple[float, float]]
) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, fitted)
        model = index.fitted
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                held, counts = _lists(part.column("held")), _lists(part.column("counts"))
                rest = part.column("rest").to_pylist()
                found = index.search([index.unit(*q) for q in zip(held, counts, rest, strict=True)])
                scores = [
                    calibrated(index.vote(near), levels) if len(h) or r else model.without
                    for near, h, r in zip(found, held, rest, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(scores, pa.float64()),
                        pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                        pa.array([[model.examples[i][0] for _, i in near] for near in found],
                                 pa.list_(pa.int64())),
                        pa.array([[round(c, 9) for c, _ in near] for near in found],
                                 pa.list_(pa.float64())),
                        pa.array([[model.terms[t] for t in h[h < model.strong]] for h in held],
                                 pa.list_(pa.string())),
                    ],
                    ["doc_id", "score", "predicted", "neighbours", "cosines", "terms"],
                )

    return run


def fit(docs: DataFrame, labelled: DataFrame) -> tuple[Fitted, DataFrame, str, Broadcast]:
    """The fitted part, the term vector of every document, and the key and broadcast of the
    fitted part.

    ``labelled`` has ``doc_id, label``.
    """
    spark = docs.sparkSession
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    chosen = cut(sample(labelled), "sample")
    learned = cut(texts.join(F.broadcast(chosen), "doc_id"), "learned")  # SAMPLE narrow rows at most
    terms, gain, strong = vocabulary(learned)
    vectors = cut(
        texts.mapInArrow(
            _vectors(terms), "doc_id long, held array<int>, counts array<int>, rest double"
        ),
        "vectors",
    )
    total = vectors.count()
    held = vectors.select("held").mapInArrow(_document_counts, "t int, n long")
    seen = np.zeros(len(terms) + 1)
    terms = terms[:strong]  # the others are known by number from here on
    counted = held.groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    seen[counted["t"].to_numpy()] = counted["n"].to_numpy()
    seen[-1] = 1
    idf = (np.log((1 + total) / (1 + seen)) + 1) * np.append(gain, 1.0)
    rows = vectors.join(F.broadcast(chosen), "doc_id")
    blank, ones, every = rows.agg(
        F.count_if(F.size("held") == 0),
        F.count_if((F.size("held") == 0) & (F.col("label") == 1)),
        F.avg(F.col("label").cast("double")),
    ).first()
    found = (
        rows.where(F.size("held") > 0).groupBy("doc_id", "label", "held", "counts").agg(F.count(F.lit(1)))
        .drop("count(1)").toArrow().combine_chunks()
    )
    lists = [[x for c in found[n].chunks for x in _lists(c)] for n in ("held", "counts")]
    examples = list(zip(found["doc_id"].to_pylist(), found["label"].to_pylist(), *lists, strict=True))
    examples.sort(key=lambda e: (e[0], e[2].tolist(), e[3].tolist()))
    fitted = Fitted(
        terms, idf, examples, ones / blank if blank else 0.0, every or 0.0, strong=strong
    )
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(fitted)
    numbers = spark.range(len(examples)).withColumnRenamed("id", "number")
    votes = numbers.mapInArrow(_votes(key, sent), "vote double, label int").collect()  # SAMPLE rows at most
    levels = calibration(sorted((r.vote, r.label) for r in votes))
    return fitted._replace(levels=levels), vectors, key, sent


def score(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``doc_id, score, predicted`` of every document, with its evidence: the nearest
    examples, their cosines and the terms that go with the label clearly."""
    fitted, vectors, key, sent = fit(docs, labelled)
    return vectors.mapInArrow(_score(key, sent, fitted.levels), SCHEMA)
