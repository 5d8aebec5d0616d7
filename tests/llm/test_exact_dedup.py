from hashlib import sha256

from trustlake.llm.exact_dedup import DigestIndex, drop_copies

TWO = sha256(b"one two").digest()


def test_edges(spark, edges):
    rows = DigestIndex.scratch(spark).add(edges).collect()
    assert len(rows) == edges.count()
    of = {(r.doc_id, bytes(r.digest)): r for r in rows}
    assert of[4, TWO].keep_id == 5 and not of[4, TWO].kept and of[4, TWO].group_size == 4
    assert of[5, TWO].kept and not of[None, TWO].kept
    empty = sha256(b"").digest()
    assert of[1, empty].keep_id == 2 and of[2, empty].group_size == 3  # null text is empty
    assert not of[None, empty].kept


def test_drop_copies(spark, edges, nothing):
    kept = drop_copies(edges)
    assert kept.columns == edges.columns
    rows = kept.collect()
    assert sorted((r.doc_id, (r.text or "")[:7]) for r in rows) == [
        (2, ""), (3, " \n\t "), (5, "one two"), (7, "12345 6"), (8, "word0x0"), (9, "another"),
        (9, "word0x0"),
    ]
    assert drop_copies(nothing).collect() == []


def test_group_without_numbers(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    rows = DigestIndex.scratch(spark).add(docs).collect()
    assert all(r.kept and r.keep_id is None for r in rows)
    assert sorted(r.text for r in drop_copies(docs).collect()) == ["a", "b"]


def test_index_persists(spark):
    """A later batch is compared with what earlier ones left, and only news is appended."""
    index = DigestIndex.scratch(spark)
    schema = "doc_id long, text string"
    index.add(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema)).collect()
    again = DigestIndex(spark, index.name, index.path)
    second = again.add(spark.createDataFrame([(9, "a"), (8, "c"), (7, "c")], schema))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in second.collect()) == [
        (7, 8, False), (8, 8, True), (9, 2, False),
    ]
    assert sorted(r.keep_id for r in again.read().collect()) == [2, 3, 8]
    again.add(spark.createDataFrame([], schema))
    assert again.read().count() == 3


def test_plan_is_sort_merge_without_python(spark, edges):
    index = DigestIndex.scratch(spark)
    plan = index.add(edges)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan
    assert "Python" not in plan and "Arrow" not in plan
