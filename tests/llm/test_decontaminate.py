import random

import pytest

from trustlake.llm import decontaminate
from trustlake.llm.decontaminate import Matcher, find, normal
from trustlake.llm.queries import QUERIES


def brute(item, text):
    """Least edit distance of the item to a part of the text, and its first end."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[-1] + 1))
        before = now
    return min(before), before.index(min(before))


def test_distance_equals_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        item = "".join(rng.choices("ab", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc", k=rng.randint(0, 60)))
        got = decontaminate._myers(decontaminate._positions(item), len(item), text)
        best, end = brute(item, text)
        assert got[0] == best and (got[1] == end or best == len(item))


@pytest.mark.parametrize("seed", range(5))
def test_every_occurrence_within_budget_is_found(seed):
    rng = random.Random(seed)
    letters = "abcdefgh "
    items = [(i, "".join(rng.choices(letters, k=rng.randint(30, 120)))) for i in range(6)]
    matcher = Matcher(items, 0.1)
    for _ in range(60):
        k = rng.randrange(6)
        text = list(items[k][1])
        for _ in range(rng.randint(0, len(text) // 8)):
            at, kind = rng.randrange(len(text)), rng.randrange(3)
            if kind == 0:
                text[at] = rng.choice("xyz")
            elif kind == 1:
                text.insert(at, rng.choice("xyz"))
            elif len(text) > 1:
                del text[at]
        whole = "".join(rng.choices(letters, k=40)) + "".join(text) + "".join(rng.choices(letters, k=40))
        got = matcher.find(whole)
        for i, (_, item) in enumerate(items):
            best, _ = brute(normal(item), normal(whole))
            assert (i in got) == (best <= int(0.1 * len(item)))
            if i in got:
                distance, start, end = got[i]
                assert distance == best == brute(normal(item), normal(whole)[start:end])[0]


def test_planted_items(spark, rows):
    """Every document that holds a benchmark item, and no other."""
    sf = "/root/testdata/sf0.01"
    texts = dict(rows("select doc_id, text from documents", sf))
    items = dict(rows("select item_id, text from benchmark", sf))
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op6_decontaminate"](spark, sf).collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if normal(x) in normal(t)}
    assert exact and exact <= set(got)
    for (d, i), r in got.items():
        distance = brute(normal(items[i]), normal(texts[d])[r.start : r.end])[0]
        assert distance == r.distance <= len(items[i]) * decontaminate.RATE
        assert (r.distance == 0) == ((d, i) in exact)


def test_case_and_white_space():
    item = "What is the capital of France? Paris is."
    found = Matcher([(1, item)], 0.1).find("İ said: WHAT IS the\ncapital of\tFrance? PARIS is. Yes")
    assert found == {0: (0, 8, 8 + len(item))}


def test_edges(spark, edges, nothing):
    schema = "item_id long, text string, doc_id string"
    long_item = " ".join(f"word{i % 977}x{i % 31}" for i in range(5, 25))
    items = [(1, long_item, "x"), (1, long_item, "x"), (2, None, "x"), (3, "", "x"), (4, "one two", "x"),
             (None, long_item, "x")]
    items = spark.createDataFrame(items, schema)
    got = sorted((r.doc_id, r.item_id or 0, r.distance) for r in find(edges, items).collect())
    assert got == [(8, 0, 0), (8, 1, 0), (9, 0, 0), (9, 1, 0)]
    small = find(edges, items, block_chars=50)  # one item a block
    assert sorted((r.doc_id, r.item_id or 0, r.distance) for r in small.collect()) == got
    clean = decontaminate.drop_leaks(edges, items, block_chars=50)
    assert clean.columns == edges.columns
    assert sorted((r.doc_id or 0) for r in clean.collect()) == [0, 0, 1, 2, 3, 4, 5, 5, 7, 9]
    assert find(nothing, items).collect() == []
    none = items.where("false")
    assert find(edges, none).collect() == []
    assert decontaminate.drop_leaks(edges, none).count() == edges.count()
