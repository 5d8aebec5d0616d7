"""The pipeline, stage by stage, against what brute force keeps."""

import re

import pytest

import corpus_pipeline
from trustlake.llm import decontaminate, mixing
from trustlake.llm.common import cut

from test_near_dup import brute

SF = "/root/testdata/sf0.001"
LETTER = re.compile(r"[^\W\d_]")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [df.collect() for df in out]


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "near_dedup", "decontamination", "mixing",
    ]


def test_language(stages):
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0] if LETTER.search(r.text or "")}


def test_exact(stages):
    last = {}
    for r in stages[1]:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in stages[2]} == set(last.values())


def test_near(stages):
    docs = [(r.doc_id, r.text) for r in stages[2]]
    want = {d for (d, _), (_, component) in brute(docs, 5).items() if d == component}
    assert {r.doc_id for r in stages[3]} == want


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items)
    exact = {r.doc_id for r in stages[3] if any(decontaminate.normal(t) in decontaminate.normal(r.text)
                                                for _, t in items)}
    gone = {r.doc_id for r in stages[3]} - {r.doc_id for r in stages[4]}
    assert exact <= gone == {r.doc_id for r in stages[3] if matcher.find(r.text)}


def test_mixing(spark, stages):
    docs = spark.createDataFrame(stages[4], spark.read.parquet(f"{SF}/documents.parquet").schema)
    drawn = {r.doc_id for r in mixing.chances(docs).collect() if r.copies}
    assert drawn == {r.doc_id for r in stages[5]} and drawn


def test_columns_and_run(spark, stages):
    columns = stages[0][0].__fields__
    assert all(s[0].__fields__ == columns for s in stages[1:5])
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stages[5])


def through(spark, docs):
    """The doc_ids after each stage, and the last stage's rows."""
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        seen.append(sorted(r.doc_id or 0 for r in docs.select("doc_id").collect()))
    return seen, docs


def test_edges(spark, edges, nothing):
    seen, drawn = through(spark, edges)
    assert seen[0] == [0, 4, 5, 5, 8, 9, 9]  # null, empty and unlettered texts go
    assert seen[1] == [5, 8, 9, 9] and seen[2] == seen[3] == [5, 8, 9]
    assert set(seen[4]) <= set(seen[3])
    more = ["topic", "weight", "expected", "copies"]
    assert drawn.columns == [c for c in edges.columns if c not in more] + more
    assert all(r.copies >= 1 for r in drawn.collect())
    seen, drawn = through(spark, nothing)
    assert seen == [[]] * 5
