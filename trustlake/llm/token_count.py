"""Token counts under a unigram vocabulary, without the tokens.

All vocabulary matches in a word come from one Aho-Corasick walk. A Viterbi pass
over its ends carries the best score and the number of pieces, nothing else. Of
equal scores the piece that begins first wins, and a character that is no piece
itself may stand alone at the least score of the vocabulary less ten, as in the
tokenizers that use such vocabularies. Unknown characters count as their bytes
(``byte_fallback``), or else a run of them as one piece.

A text is read as a space mark before its first character and for each space. No
piece holds a mark after another character, so words are scored alone, and the
counts of frequent words are remembered. For a vocabulary with such pieces the
text is taken in one.

Defined results
    null or empty text  0 pieces, score 0
    null doc_id         kept as it is
    repeated rows       one row each
    empty table         no rows
    further columns     not read
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from trustlake.llm.common import slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Words whose counts a worker remembers.
REMEMBERED = 500_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, n_tokens long, score double"


class Vocabulary(NamedTuple):
    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool


def load(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model or of a tokenizer's JSON file."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        return Vocabulary(
            tuple((p, float(s)) for p, s in model["vocab"]), bool(model.get("byte_fallback"))
        )
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in ids]
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not special[i]]
    return Vocabulary(tuple(pieces), any(sp.is_byte(i) for i in ids))


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.byte_fallback
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in vocabulary.pieces:
            scores[piece] = score
        for piece, score in scores.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        whole = SPACE not in scores or any(inner.search(p) for p in scores)
        self.chunks = re.compile(r"(?s).+" if whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # A line break that is in no longer piece separates what stands around it,
        # unless it may join a run of unknown characters.
        alone = self.bytes or "\n" in scores
        self.lines = not whole and alone and not any("\n" in p and p != "\n" for p in scores)
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        size = len(text)
        best, count, loose = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        reached = 0  # ends below are settled

        def settle(end: int, alone: bool, score: float, start: int) -> None:
            """Take the best match, or the character alone if it is no piece."""
            if not alone:
                single = best[end - 1] + self.unknown
                if start < 0 or single > score:
                    best[end], loose[end] = single, True
                    if self.bytes:
                        count[end] = count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        count[end] = count[end - 1] + (not loose[end - 1] or end == 1)
                    return
            best[end], count[end] = score, count[start] + 1

        now, alone, score, start = 0, False, 0.0, -1
        for last, (length, value) in self.matches.iter(text):
            if last + 1 != now:
                if now:
                    settle(now, alone, score, start)
                for end in range(now + 1, last + 1):
                    settle(end, False, 0.0, -1)
                now, alone, score, start = last + 1, False, 0.0, -1
            value += best[now - length]
            if start < 0 or value > score:
                score, start = value, now - length
            alone = alone or length == 1
        if now:
            settle(now, alone, score, start)
        for end in range(now + 1, size + 1):
            settle(end, False, 0.0, -1)
        return count[size], best[size]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        known, total, score = self.known, 0, 0.0
        for line in text.split("\n") if self.lines else (text,):
            for chunk in self.chunks.findall(line):
                found = known.get(chunk)
                if found is None:
                    found = self.word(chunk)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    if len(chunk) < 64:
                        known[chunk] = found
                total += found[0]
                score += found[1]
        if self.lines and (breaks := text.count("\n")):
            one = self.word("\n")
            total += breaks * one[0]
            score += breaks * one[1]
        return total, score


_COUNTERS: dict[int, Counter] = {}


def _count(vocabulary: Vocabulary) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(vocabulary)
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(vocabulary)
        for part in slices(batches, "text"):
            found = [_COUNTERS[key].count(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                ["doc_id", "n_tokens", "score"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens, score`` of every document."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_count(vocabulary), SCHEMA)
