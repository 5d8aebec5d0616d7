import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trustlake.llm import toxicity
from trustlake.llm.queries import QUERIES


def fitted(seed, examples=300, terms=12):
    rng = random.Random(seed)
    rows = []
    for i in range(examples):
        held = sorted(rng.sample(range(terms + 1), rng.randint(1, 5)))
        rows.append((i, rng.randrange(2), held, [rng.randint(1, 4) for _ in held]))
    return toxicity.Fitted([f"t{i}" for i in range(terms)], [1 + rng.random() for _ in range(terms + 1)],
                           rows, 0.1, 0.5)


@pytest.mark.parametrize("seed", range(4))
def test_nearest_equals_brute_force(monkeypatch, seed):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    model = fitted(seed)
    index = toxicity.Index(model)
    dense = np.zeros((len(model.examples), 13))
    for i, (_, _, terms, counts) in enumerate(model.examples):
        held, weights = index.unit(terms, counts)
        dense[i, held] = weights
    rng = random.Random(seed + 100)
    for _ in range(60):
        terms = sorted(rng.sample(range(13), rng.randint(1, 4)))
        query = index.unit(terms, [rng.randint(1, 3) for _ in terms])
        cosines = np.round(dense[:, query[0]] @ query[1], 12)
        want = sorted((-c, i) for i, c in enumerate(cosines) if c > 0)[: toxicity.NEIGHBOURS]
        got = index.nearest(*query)
        assert [i for _, i in got] == [i for _, i in want]
        assert [c for c, _ in got] == pytest.approx([-c for c, _ in want])


def test_calibration_never_falls():
    rng = random.Random(3)
    votes = sorted((v := rng.random(), int(rng.random() < v)) for _ in range(500))
    levels = toxicity.calibration(votes)
    assert [b for _, b in levels] == sorted(b for _, b in levels)
    scores = [toxicity.calibrated(v / 100, levels) for v in range(101)]
    assert scores == sorted(scores) and 0 <= scores[0] and scores[-1] <= 1
    assert toxicity.calibration([]) == []


def test_held_out(spark, rows):
    sf = "/root/testdata/sf0.1"
    truth = dict(rows("select doc_id, toxic from labels", sf))
    got = QUERIES["op3_toxicity"](spark, sf).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum(r.predicted and truth[r.doc_id] for r in held)
    assert right >= 0.85 * sum(truth[r.doc_id] for r in held)
    assert right >= 0.95 * sum(r.predicted for r in held)


def test_edges(spark, edges, nothing):
    labels = [(4, 1), (4, 0), (5, None), (None, 1), (8, 0), (9, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, label long")
    rows = toxicity.score(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.sample(labels).orderBy("doc_id").collect() == [(4, 1), (8, 0), (9, 0)]
    none = labels.where("false")
    assert {(r.score, r.predicted) for r in toxicity.score(edges, none).collect()} == {(0.0, 0)}
    assert toxicity.score(nothing, labels).collect() == []


def test_terms_and_evidence(spark):
    filler = "some ordinary words of a text about nothing at all"
    docs = [(i, f"{filler} {'you stupid fool' if i % 2 else 'my dear friend'} {i}") for i in range(80)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "doc_id % 2 as label").where("doc_id < 60")
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(rows[i].predicted == i % 2 for i in range(80))
    assert "stupid" in rows[61].terms and rows[61].neighbours and rows[60].terms == []
    assert all(n % 2 for n in rows[61].neighbours[:5])


def test_every_text_with_words_is_searched(spark):
    nouns = ["river stone boat", "piano song choir", "bread oven flour", "saddle horse barn"]
    docs = [(i, f"{nouns[i // 2 % 4]} w{'abcdefghij'[i // 8]} {'you stupid fool' if i % 2 else ''}") for i in range(80)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "doc_id % 2 as label").where("doc_id < 64")
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(len(r.neighbours) == toxicity.NEIGHBOURS for r in rows.values())
    # A text without any term of the label has the texts of its own subject as neighbours.
    assert all(n // 2 % 4 == i // 2 % 4 and n % 2 == 0 for i in range(64, 80, 2) for n in rows[i].neighbours[:8])
    assert all(rows[i].terms == [] and not rows[i].predicted for i in range(64, 80, 2))


def test_vectors_look_a_word_and_its_beginning_up_together():
    """Counts of words, beginnings and other words, as they would be taken one by one."""
    terms = ["toxic*", "toxically", "plain", "abcde"]
    text = "Toxically toxicity plain plain other other other once abcde"
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [text, None]})
    [found] = toxicity._vectors(terms)(iter([batch]))
    assert found.column("held").to_pylist() == [[0, 1, 2, 3], []]
    assert found.column("counts").to_pylist() == [[2, 1, 2, 1], []]
    assert found.column("rest").to_pylist() == [pytest.approx(2 + (1 + np.log(3)) ** 2), 0.0]
