import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from trustlake.llm import near_dup
from trustlake.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(docs, size, percent=80):
    """Size of the set and least number of the component for each (number, text)."""
    sets = [shingle_set(text, size) for _, text in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    out = {}
    for i, doc in enumerate(docs):
        if not sets[i]:
            out[doc] = (0, doc[0])
            continue
        numbers = [d[0] for j, d in enumerate(docs) if find(j) == find(i) and d[0] is not None]
        out[doc] = (len(sets[i]), min(numbers, default=None))
    return out


def found(df, docs):
    by_mark = {}
    for r in df.collect():
        by_mark.setdefault((r.doc_id, r.n_shingles), set()).add(r.component_id)
    return by_mark


def check(spark, docs, size):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = found(near_dup.near_duplicates(df, size), docs)
    want = {}
    for (number, _), (n, component) in brute(docs, size).items():
        want.setdefault((number, n), set()).add(component)
    assert got == want


def cloud(seed, groups, copies, edits, words=60):
    """Groups of texts that differ from a base by random edits."""
    rng = random.Random(seed)
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(words)] = f"e{rng.randrange(5000)}"
            docs.append((len(docs), " ".join(text)))
    rng.shuffle(docs)
    return docs


def test_documents_equal_brute_force(spark, rows):
    check(spark, rows("select doc_id, text from documents"), 4)


def test_clouds_equal_brute_force(spark):
    check(spark, cloud(1, 4, 40, 6), 5)


def test_large_nodes(spark, monkeypatch):
    """Pivots, further branches and blocks find the same links."""
    monkeypatch.setattr(near_dup, "NODE", 8)
    monkeypatch.setattr(near_dup, "PER_PIVOT", 3)
    monkeypatch.setattr(near_dup, "DEPTH", 2)
    check(spark, cloud(2, 2, 45, 5), 5)


def test_large_groups_of_sets(monkeypatch):
    """Groups beyond the memory of one comparison become pairs of blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 10)
    members = [(bytes([i]), 4) for i in range(6)]
    blocks = list(near_dup._blocks(members))
    pairs = {p for b in blocks for p in combinations(sorted(b), 2)}
    assert pairs == set(combinations([bytes([i]) for i in range(6)], 2))


@pytest.mark.parametrize("matrix", [0, 16_000_000])
def test_comparers_agree(monkeypatch, matrix):
    import numpy as np

    monkeypatch.setattr(near_dup, "MATRIX", matrix)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 12, rng.integers(1, 9)).astype(np.uint64)) for _ in range(30)]
    compare = near_dup._comparer(sets, 80)
    for i in range(30):
        rest = np.array([j for j in range(30) if j != i])
        want = [
            100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j])) for j in rest
        ]
        assert compare(i, rest).tolist() == want


def test_edges(spark, edges, nothing):
    rows = near_dup.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for r in of[1]] == [(0, 1, True)]
    assert {r.component_id for r in of[5]} == {4} and of[4][0].kept
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in of[None]) == [
        (0, None, True), (1, 4, False),
    ]
    assert {r.component_id for r in of[9]} == {8, 9}
    kept = near_dup.drop_near_copies(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 0), (True, 1), (True, 2), (True, 3), (True, 4), (True, 7), (True, 8), (True, 9),
    ]
    assert near_dup.near_duplicates(nothing).collect() == []
    assert near_dup.drop_near_copies(nothing).collect() == []


def test_without_numbers(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (None, text + " x")], "doc_id long, text string")
    rows = near_dup.near_duplicates(docs).collect()
    assert [(r.component_id, r.kept) for r in rows] == [(None, True)] * 2


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(400, 400)]
    root = list(range(500))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {n: find(n) for link in links if link[0] != link[1] for n in link}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_texts_are_dealt_once(spark, monkeypatch):
    """What needs texts later, and what drops them, reads their buckets without a shuffle."""
    monkeypatch.setattr(near_dup, "cut", lambda df, name: df)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base, f"end{k}"]), k % 3) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `further column` int")
    texts = near_dup._Texts(docs)
    join = near_dup._Join(texts, 5, 80)
    gone = spark.createDataFrame([(3, None), (4, None)], "doc_id long, mark long").select(
        "doc_id", F.xxhash64(F.concat(F.lit(" ".join(base) + " end"), F.col("doc_id"))).alias("mark")
    )
    for df in (join.tokens(join.sets.select("digest")), left := texts.without(gone)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect())) == sorted(r for r in rows if r[0] not in (3, 4))
