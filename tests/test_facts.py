"""Facts of texts that are kept by content."""

import re
from dataclasses import replace

import pytest

from trustlake import constants as C
from trustlake.operators import code, metrics, readmes
from trustlake.plans import tables as t
from trustlake.sources import facts as kept
from trustlake.sources.facts import FactStore
from trustlake.sources.scratch import saved

SF = "/root/testdata/sf0.001"
FILES = "repo string, file string, branch string, status_code int, text string"


def store(spark, tmp_path):
    return FactStore(spark, str(tmp_path / "facts"), 4)


def readme(repo, text, branch="main", status=200, file="README.md"):
    return (repo, file, branch, status, text)


def learn(known, files):
    return known.learn(readmes.TEXTS, readmes.usable_files(files), readmes.FILE_KEY)


def test_a_text_is_judged_once(spark, tmp_path):
    known = store(spark, tmp_path)
    rows = [readme(f"o/r{i}", "MIT License" if i % 3 else f"about {i} accuracy 92%") for i in range(60)]
    rows += [readme("o/r1", "master text", "master"), readme("o/lost", "x", status=404), readme("o/none", None),
             readme("o/blank", ""), readme("o/other", "zz", file="notes.txt"), rows[0], rows[0]]
    files = spark.createDataFrame(rows, FILES)
    assert learn(known, files) == 1 + 20 + 1
    assert known.table(readmes.TEXTS).count() == 22
    assert learn(known, files) == 0
    changed = spark.createDataFrame([*rows[:-1], readme("o/r5", "changed, apache-2.0")], FILES)
    assert learn(known, changed) == 1
    # Another session finds the table by its place.
    assert FactStore(spark, known.root, 4).table(readmes.TEXTS).count() == 23


def test_facts_equal_those_from_texts(spark, tmp_path):
    known = store(spark, tmp_path)
    files = saved(t.repo_files(spark, SF), "files")
    learn(known, files)
    for build in (readmes.text_facts, readmes.readme_facts, readmes.claims):
        assert sorted(map(str, build(files, known).collect())) == sorted(map(str, build(files).collect()))
    sources = saved(t.code_files(spark, SF), "sources")
    parsed = known.learn(code.SOURCES, sources, code.FILE_KEY, code.scored_files(sources))
    assert 0 < parsed < sources.count()
    got, want = (sorted(map(str, code.code_quality(sources, k).collect())) for k in (known, None))
    assert got == want


def test_one_changed_readme(spark, tmp_path):
    """A second rating after one README changed judges one text and sees its effect."""
    landed = t.landed(spark, SF)
    landed = replace(landed, known=store(spark, tmp_path), repo_files=saved(landed.repo_files, "files"))
    first = metrics.learn(landed)
    assert first["texts"] > 100 and first["sources"] > 10
    assert metrics.learn(landed) == {"texts": 0, "sources": 0}
    repo = landed.repo_files.where("file = 'README.md' and branch = 'main' and status_code = 200").first().repo
    text = "case when repo = '{}' and file = 'README.md' then 'Licensed under MIT' else text end as text".format(repo)
    changed = replace(landed, repo_files=saved(landed.repo_files.selectExpr("repo", "file", "branch", "status_code", text), "files"))
    assert metrics.learn(changed) == {"texts": 1, "sources": 0}
    rated = metrics.rate(changed).collect()
    again = metrics.rate(replace(changed, known=None)).collect()
    assert sorted(map(str, rated)) == sorted(map(str, again))
    assert sorted(map(str, rated)) != sorted(map(str, metrics.rate(landed).collect()))


def test_other_rules_begin_a_new_table(spark, tmp_path, monkeypatch):
    known = store(spark, tmp_path)
    files = spark.createDataFrame([readme("o/a", "MIT")], FILES)
    assert learn(known, files) == 1 and learn(known, files) == 0
    before = kept.version()
    monkeypatch.setattr(C, "MAX_CODE_FILES", 8)
    assert kept.version() != before and learn(known, files) == 1


def test_rating_from_known_facts_judges_nothing(spark, tmp_path):
    """Only digests are taken from the landed texts, and the store is not moved to meet them."""
    known = store(spark, tmp_path)
    files = saved(t.repo_files(spark, SF), "files")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = readmes.text_facts(files, known)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "regexp" not in plan.lower() and "RLIKE" not in plan
    above = plan.split("Scan parquet spark_catalog.default.facts_")[0].rsplit("SortMergeJoin [digest", 1)[1]
    branch = above[above.rindex("\n") :]
    assert "Bucketed: true" in plan and "Exchange" not in branch


@pytest.mark.parametrize("rows", [[], [readme("o/a", None)]])
def test_nothing_to_learn(spark, tmp_path, rows):
    known = store(spark, tmp_path)
    files = spark.createDataFrame(rows, FILES)
    assert learn(known, files) == 0 and readmes.text_facts(files, known).collect() == []
    assert re.fullmatch("[0-9a-f]{12}", kept.version())
