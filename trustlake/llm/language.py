"""Language identification by cross-parsing.

For each language a suffix automaton holds a bounded sample of labelled text. A
text is parsed greedily into phrases, each the longest string that occurs in the
sample. The fewer phrases, normalised by what it costs to point into the sample,
the closer the language.

The parse starts anew every ``WINDOW`` letters, so the windows of many texts are
walked side by side as arrays; whole texts are read. Letters are lower-cased and
runs of anything else count as one space.

The sample takes ``PIECES`` pieces of ``PIECE`` characters for each language, from
distinct texts dealt by a hash, for the ``LANGUAGES`` most frequent languages at most.
A language with fewer texts than that has them again, in the same order. It is a
fitted model; its size does not grow with the input. Every language has all letters
of its sample as symbols of their own; any other letter is a phrase by itself.

Defined results
    null text, no letters  ``und`` with score 0
    nothing learned        ``und`` with score 0 for all
    equal costs            the first language by name
    one language learned   that language with score 1
    null doc_id            classified like any other row
    empty table            no rows
    further columns        not read by ``identify``; passed on by ``keep_identified``
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlake.llm.common import slices

WINDOW = 256
PIECES = 96
PIECE = 256
LANGUAGES = 64
# An automaton with more symbols than that is held as sorted steps, not as a dense table.
DENSE = 64
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def sample(labelled: DataFrame, pieces: int = PIECES, piece: int = PIECE) -> dict[str, str]:
    """Bounded text for each language of ``text, lang``.

    Rows are cut to their piece, and equal ones counted, before they are ranked; ranking
    keeps at most ``pieces`` rows of a language in any task. A copy of a text is ranked
    after all first occurrences, so copies only fill what distinct texts leave.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    top = (
        usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    )
    dealt = usable.select("lang", "text", F.xxhash64("text").alias("h")).select(
        "lang",
        "h",
        F.substr(
            "text",
            F.pmod("h", F.greatest(F.lit(1), F.length("text") - piece)).cast("int") + 1,
            F.lit(piece),
        ).alias("piece"),
    )
    distinct = dealt.groupBy("lang", "h", "piece").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("lang").orderBy("h", "piece")
    chosen = (
        distinct.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= pieces)
        .join(F.broadcast(top), "lang", "left_semi")
    )
    found: dict[str, list[tuple[str, int]]] = {}
    for row in chosen.orderBy("lang", "rank").collect():  # pieces * LANGUAGES rows at most
        found.setdefault(row.lang, []).append((row.piece, row.copies))
    texts = {}
    for lang, rows in found.items():
        repeats = [p for k in range(1, pieces) for p, copies in rows if copies > k]
        texts[lang] = [*(p for p, _ in rows), *repeats][:pieces]
    return {lang: "\n".join(parts) for lang, parts in texts.items()}


class Model:
    """Automata as tables. Symbol 0 is a space, 1 a letter that no sample holds.

    An entry is the next state, times the number of symbols. Where the automaton
    has no step, a phrase ends: the entry is the state after the symbol as the
    first of a new phrase, with bit 0 set.

    Texts are encoded once, by all letters of all samples; ``own`` has for each language
    the numbers of its own letters, with 1 for those that its sample lacks.
    """

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        letters = {lang: sorted(set(_LETTER.findall(texts[lang].lower()))) for lang in self.langs}
        common = sorted(set().union(*letters.values()))
        kind = np.uint8 if len(common) <= 254 else np.uint32
        self.classes = np.zeros(0x110000, kind)
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for m in _LETTER.finditer(everything):
            self.classes[ord(m[0])] = 1
        for i, c in enumerate(common):
            self.classes[ord(c)] = i + 2
        self.own: list[np.ndarray] = []
        self.tables: list[np.ndarray | Steps] = []
        self.bits = []
        for lang in self.langs:
            own = np.ones(len(common) + 2, np.int64)
            own[0] = 0
            own[[self.classes[ord(c)] for c in letters[lang]]] = np.arange(len(letters[lang])) + 2
            symbols, _ = self.encode([texts[lang]])
            self.own.append(own)
            self.tables.append(automaton(own[symbols].tolist(), len(letters[lang]) + 2))
            self.bits.append(float(np.log2(len(symbols) + 1)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, runs of space as one, and where each text begins."""
        low = [t.lower() for t in texts]
        at = np.concatenate(([0], np.cumsum([len(t) for t in low])))
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.classes[points]
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        keep[at[:-1][at[:-1] < len(keep)]] = True
        count = np.concatenate(([0], np.cumsum(keep)))
        return symbols[keep], count[at]

    def phrases(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language."""
        sizes = np.diff(at)
        lanes = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(sizes)), lanes)
        first = np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = at[:-1][text] + (np.arange(len(text)) - first) * WINDOW
        length = np.minimum(at[1:][text] - start, WINDOW)
        order = np.argsort(-length, kind="stable")
        text, start, length = text[order], start[order], length[order]
        padded = np.concatenate((symbols, np.zeros(WINDOW, symbols.dtype)))
        steps = padded[start[None, :] + np.arange(WINDOW)[:, None]]
        active = np.searchsorted(-length, -np.arange(WINDOW), "left")
        out = np.zeros((len(self.langs), len(sizes)), np.int64)
        for k, (table, own) in enumerate(zip(self.tables, self.own, strict=True)):
            state = np.zeros(len(text), np.int64)
            count = np.ones(len(text), np.int64)
            for row, n in zip(steps, active.tolist(), strict=True):
                if not n:
                    break
                now = state[:n]
                now += own[row[:n]]
                found = table[now]
                ends = found & 1
                count[:n] += ends
                np.subtract(found, ends, out=now)
            out[k] = np.bincount(text, count, len(sizes))
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        real = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not real or not self.langs:
            return out, scores
        symbols, at = self.encode([texts[i] for i in real])
        cost = self.phrases(symbols, at) * np.array(self.bits)[:, None] / np.diff(at)
        best = np.argmin(cost, axis=0)
        low = np.sort(cost, axis=0)
        margin = 1 - low[0] / low[1] if len(self.langs) > 1 else np.ones(len(real))
        for i, k, s in zip(real, best.tolist(), margin.tolist(), strict=True):
            out[i], scores[i] = self.langs[k], s
        return out, scores


class Steps:
    """A table of few steps among many symbols: the entries that are no phrase ends, sorted,
    and for each symbol the entry of all others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, alone: np.ndarray):
        order = np.argsort(keys)
        # A last key beyond all others, so that every search ends at a key.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(values[order], 0)
        self.ends = alone + 1

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.keys, at)
        return np.where(self.keys[place] == at, self.values[place], self.ends[at % len(self.ends)])


def automaton(symbols: list[int], width: int) -> np.ndarray | Steps:
    """The suffix automaton of a sequence of numbers below ``width``, as the table that
    ``Model`` describes."""
    steps, link, size = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
        last = new
    # Entries are even, as bit 0 marks the end of a phrase.
    width += width % 2
    # The state after a symbol alone, a phrase having ended before it. A symbol that the
    # sample lacks leads to one more state, from which every symbol begins a phrase.
    alone = np.full(width, len(steps) * width, np.int64)
    for c, q in steps[0].items():
        alone[c] = q * width
    if width > DENSE:
        entries = [(s * width + c, q * width) for s, out in enumerate(steps) if s for c, q in out.items()]
        entries += list(enumerate(alone.tolist()))  # no phrase ends at the first symbol of a text
        keys, values = np.array(entries, np.int64).T
        return Steps(keys, values, alone)
    table = np.tile(alone + 1, (len(steps) + 1, 1))
    table[0] = alone
    for s, out in enumerate(steps):
        for c, q in out.items():
            table[s, c] = q * width
    return table.ravel()


_MODELS: dict[int, Model] = {}


def _model(texts: dict[str, str]) -> Model:
    key = hash(tuple(sorted(texts.items())))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(texts)
    return _MODELS[key]


def _identify(texts: dict[str, str]) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            langs, scores = _model(texts).classify(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        _identify(texts), "doc_id long, lang_pred string, score double"
    )


def keep_identified(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """The documents, with all their columns, whose text has a learned language.

    Where nothing was learned, every text with a letter stays.
    """
    mark = f"_text_{uuid.uuid4().hex[:8]}"
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, mark):
            values = part.column(mark).to_pylist()
            if texts:
                keep = [lang != UNKNOWN for lang in _model(texts).classify(values)[0]]
            else:
                keep = [bool(t and _LETTER.search(t)) for t in values]
            names = [n for n in part.schema.names if n != mark]
            yield part.select(names).filter(pa.array(keep, pa.bool_()))

    return docs.withColumn(mark, docs["text"]).mapInArrow(run, schema)
