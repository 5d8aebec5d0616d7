from collections import Counter

import pytest

from trustlake.llm import mixing


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def targets_of(spark, **shares):
    return {
        name: spark.createDataFrame(list(values.items()), f"{name} string, share double")
        for name, values in shares.items()
    }


def test_margins_are_met(spark):
    cells = cells_of(spark, [(s, l, t, 1 + 10 * i * j + k) for i, s in enumerate("abc")
                             for j, l in enumerate("xy") for k, t in enumerate("pq")])
    targets = targets_of(
        spark, source={"a": 0.2, "b": 0.3, "c": 0.5}, lang={"x": 1.0, "y": 3.0}, topic={"p": 0.5, "q": 0.5}
    )
    rows = mixing.rake(cells, targets, 40).collect()
    total = sum(r.tokens for r in rows)
    assert sum(r.tokens * r.weight for r in rows) == pytest.approx(total)
    for name, value, share in (("source", "a", 0.2), ("source", "c", 0.5), ("lang", "y", 0.75), ("topic", "p", 0.5)):
        assert sum(r.tokens * r.weight for r in rows if r[name] == value) == pytest.approx(share * total, rel=1e-4)


def test_values_without_target_and_targets_without_tokens(spark):
    cells = cells_of(spark, [("a", "x", "p", 10), ("b", "x", "p", 30), ("c", "x", "p", 5)])
    targets = targets_of(spark, source={"a": 1.0, "b": 1.0, "zz": 8.0})
    weight = {r.source: r.weight for r in mixing.rake(cells, targets, 3).collect()}
    assert weight == {"a": pytest.approx(2.25), "b": pytest.approx(0.75), "c": 0.0}


def test_raking_stops_when_settled(spark):
    """Independent margins agree after one round; further ones change nothing."""
    cells = cells_of(spark, [("a", "x", "p", 100), ("b", "x", "p", 900)])
    targets = targets_of(spark, source={"a": 0.5, "b": 0.5})
    weights = [{r.source: r.weight for r in mixing.rake(cells, targets, n).collect()} for n in (1, 2, 40)]
    assert weights == [{"a": 5.0, "b": pytest.approx(5 / 9)}] * 3


@pytest.mark.parametrize("fraction", [0.1, 0.5, 3.0])
def test_sample_meets_the_targets(spark, fraction):
    """Expected shares of all margins are those asked for, also where copies are needed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.chances(docs, fraction=fraction).collect()
    total = sum(r.tokens for r in rows)
    assert len(rows) == docs.count()
    assert sum(r.tokens * r.expected for r in rows) == pytest.approx(total * fraction)
    for name, power in mixing.TEMPER.items():
        held, asked = Counter(), Counter()
        for r in rows:
            held[r[name]] += r.tokens * r.expected
            asked[r[name]] += r.tokens
        aims = {v: n**power for v, n in asked.items() if n}
        for value, aim in aims.items():
            assert held[value] / (total * fraction) == pytest.approx(aim / sum(aims.values()), abs=1e-4)
    drawn = sum(r.tokens * r.copies for r in rows)
    spread = sum(r.tokens**2 * (r.expected % 1) * (1 - r.expected % 1) for r in rows) ** 0.5
    assert abs(drawn - total * fraction) <= 4 * spread + 1e-6
    assert all(int(r.expected) <= r.copies <= int(r.expected) + 1 for r in rows)
    kept = mixing.draw(docs, fraction=fraction).collect()
    assert {r.doc_id: r.copies for r in kept} == {r.doc_id: r.copies for r in rows if r.copies}


def test_edges(spark, edges, nothing):
    rows = mixing.chances(edges).collect()
    assert len(rows) == edges.count() and all(0 <= r.expected <= sum(r.tokens for r in rows) for r in rows)
    held = {(r.source, r.lang, r.topic) for r in rows if r.tokens}
    assert all(r.expected == 0 for r in rows if (r.source, r.lang, r.topic) not in held)
    assert {r.source for r in rows} == {"s", ""}
    twice = [r.copies for r in rows if r.doc_id == 5]
    assert len(twice) == 2 and len(set(twice)) == 1
    kept = mixing.draw(edges)
    extra = ["topic", "weight", "expected", "copies"]
    assert kept.columns == [c for c in edges.columns if c not in extra] + extra
    drawn = sorted((r.doc_id or 0, r.tokens) for r in rows if r.copies)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [d for d, _ in drawn]
    assert mixing.draw(nothing).collect() == []
    silent = edges.where("doc_id in (1, 2, 3)")
    assert [r.copies for r in mixing.chances(silent).collect()] == [0] * 3
