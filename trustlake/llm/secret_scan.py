"""Secrets in texts: fixed patterns, and literals assigned to sensitive names.

The patterns give spans of the kinds ``assign``, ``access`` and ``hex``. Then the
text is read as source or configuration: pairs of a name and a literal are
parsed, a name assigned to another name passes its literal on, and each literal
is scored by the most sensitive name that it reaches. Literals with a high score
that no ``assign`` span covers are added as spans of the kind ``literal``.

Offsets are code points, ends exclusive. A text is handled in time linear in its
length, in the task that scans it; nothing is shuffled.

Defined results
    null or empty text  no spans
    null doc_id         kept as it is
    repeated rows       one row each
    empty table         no rows
    further columns     not read
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trustlake.llm.common import slices

KINDS = ("assign", "access", "hex", "literal")
# Pattern, the group whose length counts, its least length.
BASE = (
    ("assign", re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
# A run of fewer hexadecimal digits is no match, so the search may ask for more.
_HEX = re.compile(r"[0-9a-f]{24,}")

# How much a word or a pair of words in a name says that the value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "api key": 1.0, "private key": 1.0, "access key": 1.0,
    "signing key": 1.0, "encryption key": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.7, "bearer": 0.8, "pin": 0.5, "salt": 0.5, "signature": 0.6,
}
THRESHOLD = 0.5
PLACEHOLDER = re.compile(
    r"(?:none|null|nil|true|false|undefined|changeme|example|your[\W_].*|<.*>|\$\{.*|\{\{.*|%\w"
    r"|(.)\1*|[*x.\-]+)\Z",
    re.I,
)

_NAME = re.compile(
    r"""(?<![\w.\-])(?P<name>[A-Za-z_][\w.\-]*+)["']?\]?[ \t]*+(?::=|=>|=|:)(?![=:])[ \t]*+""", re.A
)
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'')
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>|&]++""")
_IDENTIFIER = re.compile(r"[A-Za-z_][\w.]*\Z", re.A)
_JOIN = re.compile(r"[ \t]*+(?:\+|\.\.|&)[ \t]*+")
_TYPED = re.compile(r"[ \t]*+=(?!=)[ \t]*+")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

SCHEMA = (
    "doc_id long, spans array<struct<kind: string, start: long, end: long, "
    "name: string, score: double>>"
)
_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
    ("name", pa.string()), ("score", pa.float64()),
]))


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _WORD.findall(name)]
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return max((SENSITIVE.get(w, 0.0) for w in words + pairs), default=0.0)


def strength(literal: str, quoted: bool) -> float:
    """From 0 to 1: does this look like a secret rather than a word or a placeholder?"""
    if len(literal) < 6 or any(c.isspace() for c in literal) or PLACEHOLDER.match(literal):
        return 0.0
    if not quoted and (literal.isalpha() or literal.startswith(("/", "."))):
        return 0.0
    n = len(literal)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    kinds = sum((any(map(str.islower, literal)), any(map(str.isupper, literal)),
                 any(map(str.isdigit, literal)), not literal.isalnum()))
    return min(1.0, bits / 3.0) * (0.7 + 0.1 * kinds if kinds > 1 else 0.6)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for kind, pattern, group, least in BASE:
        search = _HEX if kind == "hex" else pattern
        for m in search.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    return found


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int, bool]], list[str]]]:
    """Each assigned name, the literals in its value, and the names in it."""
    for m in _NAME.finditer(text):
        literals, names, at = [], [], m.end()
        while True:
            if s := _STRING.match(text, at):
                literals.append((s.start() + 1, s.end() - 1, True))
            elif s := _BARE.match(text, at):
                typed = not literals and not names and _TYPED.match(text, s.end())
                if typed:  # name: type = value
                    at = typed.end()
                    continue
                if _IDENTIFIER.match(s[0]):
                    names.append(s[0])
                if not literals:
                    literals.append((s.start(), s.end(), False))
            else:
                break
            joined = _JOIN.match(text, s.end())
            if not joined:
                break
            at = joined.end()
        if literals:
            yield m["name"], literals, names


def literal_spans(text: str) -> list[tuple[int, int, str, float]]:
    """Literals with the most sensitive name that they reach, and their score."""
    if "=" not in text and ":" not in text:
        return []
    values: dict[str, list[tuple[int, int, bool]]] = {}
    users: dict[str, list[str]] = {}
    reach: dict[str, tuple[float, str]] = {}
    for name, literals, names in pairs(text):
        values.setdefault(name, []).extend(literals)
        for used in names:
            users.setdefault(used, []).append(name)
        if (s := sensitivity(name)) > 0:
            reach[name] = (s, name)
    if not reach:
        return []
    uses: dict[str, list[str]] = {}
    for used, by in users.items():
        if used in values:
            for name in by:
                uses.setdefault(name, []).append(used)
    # The most sensitive names first, so that each name is settled once.
    settled: dict[str, tuple[float, str]] = {}
    for name in sorted(reach, key=lambda n: (-reach[n][0], n)):
        todo = [name]
        while todo:
            if (x := todo.pop()) not in settled:
                settled[x] = reach[name]
                todo += uses.get(x, ())
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for name, (weight, source) in settled.items():
        for start, end, quoted in values.get(name, ()):
            score = weight * strength(text[start:end], quoted)
            if score >= THRESHOLD:
                best[start, end] = max(best.get((start, end), (0.0, "")), (score, source))
    return [(a, b, source, round(score, 6)) for (a, b), (score, source) in best.items()]


def spans(text: str) -> list[dict]:
    """All spans of a text, by start, then kind, then end."""
    base = base_spans(text)
    out = [(a, KINDS.index(kind), b, None, 1.0) for a, b, kind in base]
    covered = sorted((a, b) for a, b, kind in base if kind == "assign")
    i = 0
    for a, b, source, score in sorted(literal_spans(text)):
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        if i == len(covered) or covered[i][0] >= b:
            out.append((a, 3, b, source, score))
    return [
        {"kind": KINDS[k], "start": a, "end": b, "name": name, "score": score}
        for a, k, b, name, score in sorted(out, key=lambda x: x[:3])
    ]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        found = [spans(t) if t else [] for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(found, _SPANS)], ["doc_id", "spans"]
        )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` of every document."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan, SCHEMA)
