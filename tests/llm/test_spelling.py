"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter

import pytest

from trustlake.llm import spelling


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_pairs(words):
    return {frozenset((u, v)) for u in words for v in words if u < v and one_edit(u, v)}


def random_words(seed, letters, count, low=1, high=7):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choices(letters, k=rnd.randint(low, high))) for _ in range(count)})


@pytest.mark.parametrize("seed", range(12))
def test_composition(seed):
    words = random_words(seed, "abcé"[: 1 + seed % 4], 120)
    found = [frozenset(p) for p in spelling.Composition(words).pairs()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(words)


def test_acceptor_is_minimal():
    words = [a + b + "ing" for a in "klmn" for b in "eiou"]
    states, _ = spelling.minimised(sorted(words))
    assert len(states) == 6
    assert list(spelling.Composition([]).pairs()) == []


def test_very_long_words():
    word = "".join(random.Random(1).choices("abc", k=30_000))
    words = sorted([word, word[:9] + "z" + word[10:], word[:-1], "q" + word])
    assert {frozenset(p) for p in spelling.Composition(words).pairs()} == brute_pairs(words)


@pytest.mark.parametrize("most", [1, 20, 10_000])
def test_partitions(spark, most):
    """Pairs across partitions are found as those inside, at every size of partition."""
    words = random_words(most, "abcÿ", 400, 1, 6)
    table = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    found = spelling.near_pairs(table, most).collect()
    number = {w: i + 1 for i, w in enumerate(words)}
    assert all(number[r.a] == r.n_a and number[r.b] == r.n_b for r in found)
    pairs = [frozenset((r.a, r.b)) for r in found]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_pairs(words)


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in spelling.RUN.findall(text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1 :]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    form = {}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(found):
    out = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("most", [4, spelling.PARTITION])
def test_documents(spark, most):
    rnd = random.Random(7)
    stems = ["".join(rnd.choices("aeinrstÉ", k=rnd.randint(5, 8))) for _ in range(25)]

    def written():
        word = rnd.choice(stems[: rnd.randint(1, 25)])
        at = rnd.randrange(len(word))
        return rnd.choice((word, word, word.upper(), word[:at] + rnd.choice("aeÿ") + word[at + 1 :], word[:at] + word[at + 1 :]))

    docs = [(i, " ".join(written() for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    docs.append((500, "xaaaaa " * 3 + "xaaaab " * 6 + "xaaabb " * 12))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = rows_of(spelling.group_variants(table, most))
    assert found == brute(docs)
    assert any(root not in (word, form) for word, form, root, *_ in found)  # a chain of two


def test_edges(spark, edges, nothing):
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    assert rows_of(spelling.group_variants(edges)) == brute(docs)
    assert spelling.group_variants(nothing).collect() == []
    dropped = next(f"{w}" for w in random_words(1, "abcdefgh", 3000, 6, 6) if zlib.crc32(f":{w}".encode()) % 97 == 0)
    table = spark.createDataFrame([(None, f"{dropped} {dropped.upper()}×÷ {dropped}")] * 2, "doc_id long, text string")
    assert rows_of(spelling.group_variants(table)) == brute([(r.doc_id, r.text) for r in table.collect()])
