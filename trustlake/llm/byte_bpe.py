"""Byte-level BPE: texts to token ids by a table of merge ranks, and back.

A text is split by a pattern, and each match that is no token itself is merged
on its own. The parts of a pre-token are a linked list over its bytes. A queue
holds the pairs of neighbours that may merge in buckets by rank; bitmaps of several
levels say which are filled, so the lowest is found by taking the first set bit of
each. The lists of many pre-tokens go through one queue together, in arrays: of the
64 ranks of a bucket each pre-token merges its lowest, at all positions from left to
right, but for stale entries, whose pair has changed meanwhile. A pre-token of n
bytes takes n log n steps, however long it is. Ids of short ones are remembered.

A merge never makes a pair of a lower rank, if every token comes out whole of its
own bytes by rising ranks, as in a vocabulary that was learned by merging: that
pair would have merged before. So all positions of a rank may merge at once. The
step that merges checks it, and refuses other tables.

Defined results
    null or empty text  no ids, decoded to nothing
    null doc_id         kept as it is
    repeated rows       one row each
    very long texts     whole; matches are taken in blocks, ids are one binary value
    very long matches   merged as any other
    ties of rank        the leftmost pair merges first
    unknown ids         ``decode`` ends with an error that names the id
    empty table         no rows
    further columns     not read by ``encode``; passed on by ``decode``, but for one named decoded
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Pre-tokens whose ids a worker remembers, and the longest such.
REMEMBERED = 300_000
SHORT = 32
# Bytes of texts that a task takes up at once, matches of which it holds and merges
# at once, and matches or ids of one text that it takes at once.
STEP = 2 << 20
HELD = 1 << 20
BLOCK = 1 << 18
ENCODED = "doc_id long, n_tokens long, ids binary"


class Ranks(NamedTuple):
    """``tokens`` in the order of their ids, None for ids without one; ``pattern`` splits texts."""

    tokens: tuple[bytes | None, ...]
    pattern: str


def load(path: str, pattern: str) -> Ranks:
    """A rank file: lines of a token in base64 and its id. All single bytes are tokens."""
    with open(path, "rb") as file:
        found = {int(b): base64.b64decode(a) for a, b in (line.split() for line in file if line.strip())}
    tokens = tuple(found.get(i) for i in range(max(found) + 1))
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError(f"{path}: a single byte has no rank")
    return Ranks(tokens, pattern)


@cache
def _members(category: str) -> tuple[tuple[int, int], ...]:
    """The ranges of characters in a category, as the tiktoken library has them.

    Versions of Unicode differ, and so do libraries; its own matcher is asked.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    asked = tiktoken.Encoding(
        "bytes", pat_str=category, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}
    )
    found = np.array([*map(ord, bytes(asked.encode_ordinary(every)).decode())])
    first = np.flatnonzero(np.append(True, np.diff(found) != 1))
    last = np.append(first[1:], len(found)) - 1
    return tuple(zip(found[first].tolist(), found[last].tolist(), strict=True))


_CLASS = re.compile(r"\\p\{[LN]\}|\\s|\\S|\[\^?|\]|\\.|.", re.S)
_ABOVE = re.compile("[\U00010000-\U0010ffff]")


def spelled(pattern: str, limit: int = 0x10FFFF) -> str:
    """The pattern in the syntax of the standard library, for texts with characters up to ``limit``.

    Letters, numbers and white space are written out as ranges. Raises
    ``ValueError`` for other classes.
    """

    def ranges(category: str) -> str:
        return "".join(f"\\U{a:08x}-\\U{min(b, limit):08x}" for a, b in _members(category) if a <= limit)

    out, inside = [], False
    for part in _CLASS.findall(pattern):
        if part == r"\S" and not inside:
            out.append(f"[^{ranges(chr(92) + 's')}]")
        elif part in (r"\p{L}", r"\p{N}", r"\s"):
            out.append(ranges(part) if inside else f"[{ranges(part)}]")
        elif part[0] == "\\" and part[1:] and part[1].isalnum():
            raise ValueError(f"class {part} of {pattern} is not known here")
        else:
            inside = part[0] == "[" or (inside and part != "]")
            out.append(part)
    return "".join(out)


class Queue:
    """Positions by merge rank: buckets of 64 ranks, found by bitmaps of several levels.

    A level has 64 buckets for what shares all higher digits (base 64) of the rank
    at hand; a bitmap says which are filled. The bucket with the first set bit is
    dealt out to the level below; one of the lowest level is handed out. What is
    pushed must not be below the bucket that was handed out last.
    """

    def __init__(self, ranks: np.ndarray, positions: np.ndarray, top: int):
        self.shifts = [6, *range(12, max(12, top.bit_length()), 6)]
        self.bits = [0] * len(self.shifts)
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.shifts]
        self.rank = 0
        self.push(ranks, positions)

    def _put(self, level: int, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Add a run, sorted by rank."""
        if len(ranks):
            filled = np.bincount((ranks >> self.shifts[level]) & 63, minlength=64) > 0
            self.bits[level] |= int.from_bytes(np.packbits(filled, bitorder="little").tobytes(), "little")
            self.held[level].append((ranks, positions))

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        for level, shift in enumerate(self.shifts):
            end = int(np.searchsorted(ranks, ((self.rank >> shift + 6) + 1) << shift + 6))
            self._put(level, ranks[:end], positions[:end])
            ranks, positions = ranks[end:], positions[end:]

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and positions of the lowest bucket, stale ones too; nothing if nothing is left."""
        level = next((level for level, bits in enumerate(self.bits) if bits), -1)
        ranks = positions = np.zeros(0, np.int64)
        while level >= 0:
            bits, shift = self.bits[level], self.shifts[level]
            digit = (bits & -bits).bit_length() - 1  # find the first set bit
            self.bits[level] = bits & bits - 1
            end = (self.rank >> shift + 6 << 6 | digit) + 1 << shift
            runs, rest = [], []
            for run in self.held[level]:  # of each run the head is in the bucket
                at = int(np.searchsorted(run[0], end))
                if at:
                    runs.append((run[0][:at], run[1][:at]))
                if at < len(run[0]):
                    rest.append((run[0][at:], run[1][at:]))
            self.held[level] = rest
            ranks, positions = runs[0] if len(runs) == 1 else map(np.concatenate, zip(*runs, strict=True))
            self.rank = end - (1 << shift)
            level -= 1
            if level >= 0:
                order = np.argsort(ranks, kind="stable")
                ranks, positions = ranks[order], positions[order]
                self._put(level, ranks, positions)
        return ranks, positions


class Merger:
    """Merges all pre-tokens of a batch at once, in one linked list without links between them."""

    def __init__(self, tokens: tuple[bytes | None, ...]):
        self.rank = {token: i for i, token in enumerate(tokens) if token is not None}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.ids = len(tokens)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.ids + b] = rank
        # One key above all others, so that every search ends inside.
        self.keys = np.array([*sorted(pairs), np.iinfo(np.int64).max])
        self.ranks = np.array([*(pairs[k] for k in sorted(pairs)), -1], np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where they don't merge or ``b`` is -1."""
        key = np.where(b < 0, -1, a * self.ids + b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = len(data)
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        token = np.append(self.single[data], -1)
        # The position after the last byte is nobody's part; it takes writes that lead nowhere.
        after, before = np.arange(1, size + 2), np.arange(-1, size)
        after[ends[lengths > 0] - 1] = before[starts[lengths > 0]] = after[size] = size
        piece = np.append(np.repeat(np.arange(len(pieces)), lengths), -1)
        pair = np.append(self.ranks_of(token[:size], token[after[:size]]), -1)
        alive = np.ones(size, bool)
        done = np.full(len(pieces), -1)  # the rank that each merged last
        turn, step = np.zeros(size + 1, np.int64), 0  # when a part was merged last
        live = np.flatnonzero(pair >= 0)
        queue = Queue(pair[live], live, self.ids)
        while True:
            ranks, p = queue.pop()
            if not len(p):
                break
            fresh = pair[p] == ranks  # stale entries are skipped
            ranks, p = ranks[fresh], p[fresh]
            if not len(p):
                continue
            # Each pre-token merges its lowest rank, from left to right.
            order = np.lexsort((p, ranks, piece[p]))
            ranks, p = ranks[order], p[order]
            own = piece[p]
            new = np.append(True, own[1:] != own[:-1])
            lowest = ranks[new][np.cumsum(new) - 1] == ranks
            if not lowest.all():
                queue.push(ranks[~lowest], p[~lowest])
                ranks, p = ranks[lowest], p[lowest]
            j = after[p]
            shared = p[1:] == j[:-1]
            if shared.any():  # of pairs that share a part, the leftmost merges first
                at = np.arange(len(p))
                first = np.maximum.accumulate(np.where(np.append(False, shared), 0, at))
                chosen = (at - first) & 1 == 0
                ranks, p, j = ranks[chosen], p[chosen], j[chosen]
            k = after[j]
            after[p], before[k], token[p], done[piece[p]] = k, p, ranks, ranks
            pair[j], alive[j] = -1, False
            step += 1
            turn[p] = turn[size] = step
            near = before[p]
            near = np.concatenate((p, near[turn[near] != step]))
            ranks = self.ranks_of(token[near], token[after[near]])
            pair[near] = ranks
            fits = ranks >= 0
            ranks, near = ranks[fits], near[fits]
            if (ranks < done[piece[near]]).any():
                raise ValueError("ranks are not in the order of merges")
            queue.push(ranks, near)
        out = token[:size][alive].astype("<u4").tobytes()
        count = np.append(0, np.cumsum(alive)) * 4
        return [out[a:b] for a, b in zip(count[starts].tolist(), count[ends].tolist(), strict=True)]


class Encoder:
    def __init__(self, ranks: Ranks, narrow: str, wide: str):
        self.merger = Merger(ranks.tokens)
        # Sets that end at U+FFFF are looked up faster.
        self.narrow, self.wide = re.compile(narrow), re.compile(wide)
        self.known: dict[str, bytes] = {}

    def settle(self, words: set[str]) -> None:
        """Make ``words`` known."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        rank, known = self.merger.rank, self.known
        new = [w for w in words if w not in known]
        pieces = [w.encode() for w in new]
        whole = [rank.get(p) for p in pieces]
        merged = iter(self.merger.merge([p for p, one in zip(pieces, whole, strict=True) if one is None]))
        for word, one in zip(new, whole, strict=True):
            known[word] = next(merged) if one is None else one.to_bytes(4, "little")

    def forget(self, words: set[str]) -> None:
        """Drop long ones of ``words``, as they hardly come again."""
        for word in words:
            if len(word) > SHORT:
                del self.known[word]

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, in blocks."""
        pattern = self.wide if _ABOVE.search(text) else self.narrow
        if len(text) <= BLOCK:
            yield pattern.findall(text)
            return
        matches = (m[0] for m in pattern.finditer(text))
        while block := list(islice(matches, BLOCK)):
            yield block

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytearray] = [bytearray() for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            words = set().union(*(block for _, block in held))
            self.settle(words)
            for i, block in held:
                out[i] += b"".join(map(self.known.__getitem__, block))
            self.forget(words)
            held.clear()

        for i, text in enumerate(texts):
            for block in self.blocks(text or ""):
                held.append((i, block))
                size += len(block)
                if size >= HELD:
                    flush()
                    size = 0
        flush()
        return [bytes(ids) for ids in out]


class Decoder:
    def __init__(self, ranks: Ranks):
        self.blob = np.frombuffer(b"".join(t or b"" for t in ranks.tokens), np.uint8)
        self.length = np.array([-1 if t is None else len(t) for t in ranks.tokens], np.int64)
        self.start = np.cumsum(np.maximum(self.length, 0)) - np.maximum(self.length, 0)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that the ids stand for."""
        out = bytearray()
        for at in range(0, len(ids or b""), 4 * BLOCK):
            block = np.frombuffer(ids[at : at + 4 * BLOCK], "<u4")
            bad = block >= len(self.length)
            length = self.length[np.where(bad, 0, block)]
            if (bad := bad | (length < 0)).any():
                raise ValueError(f"no token has id {block[bad][0]}")
            shift = self.start[block] - (np.cumsum(length) - length)
            out += self.blob[np.repeat(shift, length) + np.arange(length.sum())].tobytes()
        return bytes(out)


# What a worker built last for each direction, and the hash of the ranks it was built from.
_BUILT: dict[Callable, tuple[int, Encoder | Decoder]] = {}


def _coder(made: Callable, key: int, build: Callable[[], Encoder | Decoder]) -> Encoder | Decoder:
    """The coder of this worker, which its tasks share."""
    if _BUILT.get(made, (None,))[0] != key:
        _BUILT[made] = key, build()
    return _BUILT[made][1]


def _mapped(
    ranks: Ranks, column: str, build: Callable[[], Encoder | Decoder],
    made: Callable[[Encoder | Decoder, list], list[tuple[str, pa.Array]]],
) -> Callable[[Iterator], Iterator]:
    """Batches with ``column`` replaced by what is made of it, and all others kept."""
    key = hash(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(made, key, build)
        for batch in batches:
            # Some MB at once, as a batch of pre-tokens merges faster than each alone.
            size = max(1, batch.num_rows * STEP // max(1, batch.column(column).nbytes))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                new = made(coder, part.column(column).to_pylist())
                kept = [(name, part.column(name)) for name in part.schema.names if name != column]
                yield pa.RecordBatch.from_pydict(dict([*kept, *new]))

    return run


def _encoded(encoder: Encoder, texts: list[str | None]) -> list[tuple[str, pa.Array]]:
    ids = encoder.encode(texts)
    return [("n_tokens", pa.array([len(x) // 4 for x in ids], pa.int64())), ("ids", pa.array(ids, pa.binary()))]


def _decoded(decoder: Decoder, ids: list[bytes | None]) -> list[tuple[str, pa.Array]]:
    return [("decoded", pa.array([decoder.decode(x) for x in ids], pa.binary()))]


def encode(docs: DataFrame, ranks: Ranks) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document; ids as little-endian unsigned 32-bit integers."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    narrow, wide = spelled(ranks.pattern, 0xFFFF), spelled(ranks.pattern)
    return rows.mapInArrow(_mapped(ranks, "text", lambda: Encoder(ranks, narrow, wide), _encoded), ENCODED)


def decode(encoded: DataFrame, ranks: Ranks) -> DataFrame:
    """All columns but ``ids``, and ``decoded``: the bytes that the ids stand for."""
    rows = encoded.drop("decoded")
    schema = StructType([f for f in rows.schema.fields if f.name != "ids"]).add("decoded", "binary")
    return rows.mapInArrow(_mapped(ranks, "ids", lambda: Decoder(ranks), _decoded), schema)
