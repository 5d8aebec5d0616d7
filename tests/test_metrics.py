"""Scores, gate, rating view and the ten metrics on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.operators import code, metrics, rating, readmes, reviews, scores, sizes

METRICS = list(C.METRIC_WEIGHTS)


def long_results(spark, results):
    """Long rows from {id: {metric: score | {device: score} | None}}."""
    rows = []
    for artifact, found in results.items():
        for metric, value in found.items():
            devices = value if isinstance(value, dict) else None
            rows.append(("model", artifact, metric, None if devices else value, devices, 1))
    return spark.createDataFrame(
        rows,
        "type string, id long, metric string, score double, device_scores map<string,double>, latency_ms long",
    )


def test_net_score(spark):
    cases = {
        1: (dict.fromkeys(METRICS, 1.0), 1.0),
        2: ({"license": 1.0, "bus_factor": 0.5}, 0.75),
        3: ({"license": -5.0, "bus_factor": 0.5}, 0.25),
        4: ({"license": None, "bus_factor": 1.0}, 1.0),
        5: ({"size_score": {"a": 0.2, "b": 0.8}}, 0.5),
        6: (dict.fromkeys(METRICS, None), 0.0),
        7: ({"unknown": 1.0}, 0.0),
    }
    df = scores.net_score(long_results(spark, {k: r for k, (r, _) in cases.items()}))
    assert {r.id: r.net_score for r in df.collect()} == {k: e for k, (_, e) in cases.items()}


def test_net_score_ties_follow_python(spark):
    import random

    rng = random.Random(5)
    cases = {i: {m: rng.randrange(1001) / 1000 for m in METRICS} for i in range(400)}

    def expected(found):
        net = used = 0.0
        for metric, weight in C.METRIC_WEIGHTS.items():
            net += found[metric] * weight
            used += weight
        return round(net / used, 3)

    df = scores.net_score(long_results(spark, cases).repartition(8))
    assert {r.id: r.net_score for r in df.collect()} == {k: expected(v) for k, v in cases.items()}


def test_gate(spark):
    good = dict.fromkeys(METRICS, 0.9)
    cases = {
        1: good,
        2: good | {"license": 0.1, "bus_factor": None},
        3: good | {"size_score": {"a": 0.2, "b": 0.6}},
        4: good | {"size_score": {"a": 0.4, "b": 0.6}},
        5: {m: 0.9 for m in METRICS if m != "license"},
    }
    got = {r.id: (r.admitted, r.failures) for r in scores.gate(long_results(spark, cases)).collect()}
    assert got == {
        1: (True, []),
        2: (False, ["bus_factor", "license"]),
        3: (False, ["size_score"]),
        4: (True, []),
        5: (False, ["license"]),
    }
    others = long_results(spark, {6: {"license": 0.0}}).withColumn("type", F.lit("dataset"))
    assert scores.gate(others).first().admitted


def test_rating_view(spark):
    results = {
        "license": [0.8, 12], "bus_factor": [None, 3], "ramp_up_time": 0.4, "reviewedness": "0.7",
        "code_quality": [], "size_score": [{"raspberry_pi": 0.5, "aws_server": 1}, 9],
    }
    stored = spark.createDataFrame(
        [("model", 1, "a", 0.5, json.dumps(results)), ("model", 2, "b", 0.1, '{"size_score": 0.5}'),
         ("model", 3, "c", 0.1, "not json"), ("code", 4, "d", 0.0, "{}")],
        "type string, id long, name string, net_score double, results string",
    )
    view = {r.id: r for r in rating.rating_view(stored).collect()}
    assert sorted(view) == [1, 2, 3]
    one = view[1]
    assert (one.license, one.license_latency, one.category, one.tree_score) == (0.8, 12, "model", 0.75)
    assert (one.bus_factor, one.bus_factor_latency) == (0.0, 3)
    assert (one.ramp_up_time, one.ramp_up_time_latency) == (0.4, 0)
    assert (one.reviewedness, one.code_quality, one.reproducibility) == (0.0, 0.0, 0.0)
    assert one.size_score.asDict() == {
        "raspberry_pi": 0.5, "jetson_nano": 0.0, "desktop_pc": 0.0, "aws_server": 1.0,
    }
    assert one.size_score_latency == 9
    assert view[2].size_score.asDict() == dict.fromkeys(C.DEVICES, 0.0)
    assert view[3].license == 0.0
    keys = {r.key for r in rating.subscores(rating.rating_view(stored)).collect()}
    assert keys == set(METRICS) - {"size_score"} | {"tree_score"}


def review_tables(spark, prs, review_rows, files):
    return (
        spark.createDataFrame(prs, "repo string, number long, updated_at timestamp, merged_at string"),
        spark.createDataFrame(review_rows, "repo string, number long"),
        spark.createDataFrame(files, "repo string, number long, filename string, additions long"),
    )


def test_reviewedness(spark):
    from datetime import datetime, timedelta

    day = datetime(2024, 1, 1)
    prs = [("ratio", 1, day, "yes"), ("ratio", 2, day, "yes"), ("binary", 1, day, "yes"),
           ("open", 1, day, None), ("open", 2, day, "yes"), ("none", 1, day, "yes")]
    revs = [("ratio", 1), ("ratio", 1), ("open", 2), ("none", 9)]
    files = [("ratio", 1, "a.py", 30), ("ratio", 2, "b.py", 70), ("binary", 1, "m.BIN", 100),
             ("binary", 1, "w.safetensors", 5), ("open", 1, "a", 50), ("open", 2, "b", 50)]
    # Forty PRs: the thirty newest are counted before unmerged ones are dropped.
    for n in range(40):
        prs.append(("many", n, day + timedelta(days=n), "yes" if n % 2 else None))
        files.append(("many", n, "f.py", 1))
        if n in (1, 39, 37, 35):
            revs.append(("many", n))
    got = {r.repo: r.score for r in reviews.reviewedness(*review_tables(spark, prs, revs, files)).collect()}
    assert got == {"ratio": 0.3, "binary": 0.0, "open": 1.0, "none": 0.0, "many": 0.2}


def test_size_scores(spark):
    gib = 1024**3
    rows = [
        ("huge", 0, "a.safetensors", str(80 * gib), None), ("huge", 1, "b.safetensors", str(80 * gib), None),
        ("ranged", 0, "model.bin", None, f"bytes 0-0/{2 * gib}"),
        ("small", 0, "model.bin", str(5 * 1024**2 - 1), None), ("docs", 0, "README.md", str(gib), None),
    ]
    siblings = spark.createDataFrame(
        rows, "model_id string, ord long, rfilename string, content_length string, content_range string"
    )
    got = {r.model_id: r.devices for r in sizes.size_scores(siblings).collect()}
    assert set(got) == {"huge", "ranged"}
    assert (got["huge"].raspberry_pi, got["huge"].aws_server) == (0.0, 0.0)
    assert got["ranged"].desktop_pc == 1.0


@pytest.mark.parametrize("block", [1, 3, 100])
def test_files_to_cap_equals_a_loop(spark, block):
    import random

    rng = random.Random(2)
    rows = [(m, o, rng.randint(1, 50)) for m in "ab" for o in rng.sample(range(60), 25)]
    files = spark.createDataFrame(rows, "model_id string, ord long, size_bytes long")
    expected = set()
    for model in "ab":
        total = 0
        for _, o, size in sorted(r for r in rows if r[0] == model):
            expected.add((model, o, size, total))
            total += size
            if total >= 300:
                break
    kept = sizes.files_to_cap(files, cap=300, block=block)
    assert {(r.model_id, r.ord, r.size_bytes, r.running_before) for r in kept.collect()} == expected


def test_branch_choice(spark):
    rows = [
        ("a", "README.md", "main", 200, "main"), ("a", "README.md", "master", 200, "master"),
        ("b", "README.md", "main", 404, "gone"), ("b", "README.md", "master", 200, "master"),
        ("c", "README.md", "main", 200, ""), ("c", "LICENSE", "main", 200, "MIT"),
        ("d", "other.txt", "main", 200, "x"),
    ]
    files = spark.createDataFrame(
        rows, "repo string, file string, branch string, status_code int, text string"
    )
    got = {(r.repo, r.file): r.text for r in readmes.pick_branch_text(files).collect()}
    assert got == {("a", "README.md"): "main", ("b", "README.md"): "master", ("c", "LICENSE"): "MIT"}


def test_claims_and_text_facts_agree(spark):
    rows = [
        ("o/a", "README.md", "main", 200, "  \n"), ("o/a", "README.md", "master", 200, "accuracy 92%"),
        ("o/a", "config.json", "main", 200, "acc 9"),
        ("o/b", "config.json", "main", 200, "accuracy 92%"), ("o/b", "model_index.json", "master", 200, "x"),
        ("o/c", "LICENSE", "main", 200, "accuracy 92%"), ("o/d", "README.md", "main", 500, "accuracy 92%"),
        ("o/e", "model_card.json", "main", 200, "accuracy 92%"), ("solo", "README.md", "main", 200, "MIT"),
        ("o/f", "README.md", "main", 200, "MIT, wikipedia and C4, filtered"),
    ]
    files = spark.createDataFrame(
        rows, "repo string, file string, branch string, status_code int, text string"
    )
    expected = {"o/a": 1.0, "o/b": 0.0, "o/f": 0.0, "solo": 0.0}
    assert {r.repo: r.score for r in readmes.claims(files).collect()} == expected
    facts = {r.model_id: r for r in readmes.text_facts(files).collect()}
    assert {k: r.claims for k, r in facts.items() if r.claims is not None} == expected
    assert facts["o/f"].license == 1.0 and sorted(facts["o/f"].trusted) == ["c4", "wikipedia"]
    assert facts["o/f"].quality_hits == 2 and facts["solo"].license is None
    assert facts["o/a"].blank is True


def model_frame(spark, **columns):
    """One row with all columns that the score expressions read."""
    defaults = {
        "model_id": "o/r", "has_info": True, "has_sha": True, "likes_score": 0.0, "has_card": False,
        "has_examples": False, "has_readme": False, "has_python": False, "total_bytes": None,
        "datasets": [], "blank": False, "trusted": [], "quality_hits": 0, "has_section": False,
        "python_signal": False, "code_url": "NULL", "dataset_url": "NULL", "popularity": 0.0,
        "freshness": 0.0, "license": None, "claims": None,
    }
    schema = (
        "model_id string, has_info boolean, has_sha boolean, likes_score double, has_card boolean, "
        "has_examples boolean, has_readme boolean, has_python boolean, total_bytes long, "
        "datasets array<string>, blank boolean, trusted array<string>, quality_hits int, "
        "has_section boolean, python_signal boolean, code_url string, dataset_url string, "
        "popularity double, freshness double, license double, claims double"
    )
    row = defaults | columns
    return spark.createDataFrame([tuple(row[f.split()[0]] for f in schema.split(", "))], schema)


def value(df, column):
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "columns, expected",
    [
        ({}, 0.0),
        ({"code_url": "u", "dataset_url": "u", "model_id": "https://x"}, 1.0),
        ({"code_url": None, "dataset_url": None}, 1.0),
        ({"code_url": "u"}, 0.5),
        ({"datasets": ["mnist"]}, 0.5),
        ({"datasets": ["mnist"], "has_python": True}, 1.0),
        ({"datasets": ["mnist"], "has_python": True, "has_info": None}, 0.0),
        ({"python_signal": True}, 0.5),
        ({"code_url": "u", "model_id": "https://x"}, 0.0),
        ({"code_url": "u", "model_id": None}, 0.0),
        ({"dataset_url": " NULL"}, 0.5),
    ],
)
def test_dataset_and_code(spark, columns, expected):
    assert value(model_frame(spark, **columns), metrics.dataset_and_code_value()) == expected


def test_dataset_and_code_strict(spark):
    strict = metrics.dataset_and_code_value(strict=True)
    for links in ({"code_url": None, "dataset_url": None}, {"code_url": "", "dataset_url": " NULL"}):
        assert value(model_frame(spark, **links), strict) == 0.0


@pytest.mark.parametrize(
    "columns, expected",
    [
        ({"trusted": ["bookcorpus", "wikipedia"], "quality_hits": 1}, 0.963),
        ({"trusted": ["imagenet", "coco"]}, 0.8),
        ({"trusted": ["cifar-10"], "quality_hits": 8}, 0.9),
        ({"datasets": ["mnist"]}, 0.6),
        ({"datasets": ["mine"]}, 0.4),
        ({"has_section": True, "quality_hits": 4}, 0.7),
        ({"quality_hits": 4}, 0.0),
        ({"trusted": ["coco"], "blank": True}, 0.0),
        ({"trusted": ["coco"], "blank": None}, 0.0),
        ({"model_id": None}, None),
    ],
)
def test_dataset_quality(spark, columns, expected):
    assert value(model_frame(spark, **columns), metrics.dataset_quality_value()) == expected


def test_ramp_up_and_bus_factor(spark):
    assert value(model_frame(spark), metrics.ramp_up_score()) == 0.18
    best = {"has_card": True, "likes_score": 1.0, "has_examples": True}
    assert value(model_frame(spark, **best), metrics.ramp_up_score()) == 1.0
    assert value(model_frame(spark, has_info=None), metrics.ramp_up_score()) is None
    assert value(model_frame(spark, model_id="https://x"), metrics.ramp_up_score()) is None
    popular = {"popularity": 0.5, "freshness": 0.5}
    assert value(model_frame(spark, **popular), metrics.bus_factor_score()) == 0.5
    assert value(model_frame(spark, has_info=None, **popular), metrics.bus_factor_score()) == 0.0


def test_license_and_claims_defaults(spark):
    assert value(model_frame(spark, license=0.5), metrics.license_metric()) == 0.5
    assert value(model_frame(spark, license=0.5, model_id="https://x"), metrics.license_metric()) == 0.0
    assert value(model_frame(spark, model_id=None), metrics.license_metric()) is None
    assert value(model_frame(spark), metrics.performance_score()) == 0.1
    assert value(model_frame(spark, model_id="solo", claims=1.0), metrics.performance_score()) == 0.0
    assert value(model_frame(spark, model_id=None), metrics.performance_score()) == 0.0


def test_code_quality(spark):
    good, bad = '"doc"\n', "def broken(:\n"
    rows = [("nine", i, "file", f"{i}.py", 200, good if i < 7 else bad) for i in range(9)]
    rows += [("skips", i, "file", f"{i}.py", 404 if i < 3 else 200, bad if i == 3 else good) for i in range(11)]
    rows += [("unread", 0, "file", "a.py", 500, None), ("other", 0, "file", "a.txt", 200, "x"),
             ("other", 1, "dir", "d.py", 200, good)]
    files = spark.createDataFrame(
        rows, "repo string, ord long, kind string, name string, status_code int, text string"
    )
    got = {r.repo: round(r.score, 6) for r in code.code_quality(files).collect()}
    assert got == {"nine": 1.0, "skips": round(6 / 7, 6), "unread": 0.0, "other": 0.5}


def test_rows_that_fail_are_alone(spark):
    """A metric that fails for 3 of 2000 models gives 1997 scores and 3 texts."""
    from types import SimpleNamespace

    models = spark.range(2000).selectExpr("'model' as type", "id", "case when id in (7, 700, 1999) then 'bad' else 'x' end as name")

    def score(batch):
        if (batch["name"] == "bad").any():
            raise KeyError("bad name")
        return batch["id"] / 2000

    landed = SimpleNamespace(models=models.repartition(3))
    chosen = {
        "some": metrics.RowMetric(score),
        "short": metrics.RowMetric(lambda batch: batch["id"].iloc[:-1]),
        "text": metrics.RowMetric(lambda batch: ["0.5" if i else "high" for i in batch["id"]], lambda x: x.models.limit(2)),
        "none": metrics.RowMetric(lambda batch: [float("nan")] * len(batch), lambda x: x.models.where("id < 3")),
    }
    rows = metrics.run_metrics(landed, chosen).collect()
    some = {r.id: r for r in rows if r.metric == "some"}
    assert len(some) == 2000 and {i for i, r in some.items() if r.error} == {7, 700, 1999}
    assert all(r.score == i / 2000 and r.error is None for i, r in some.items() if i not in (7, 700, 1999))
    assert some[7].score is None and some[7].error == "KeyError: 'bad name'"
    assert all(r.error == "ValueError: 0 scores for 1 rows" for r in rows if r.metric == "short")
    assert {(r.score, r.error is None) for r in rows if r.metric == "text"} <= {(0.5, True), (None, False)}
    assert [(r.score, r.error) for r in rows if r.metric == "none"] == [(None, None)] * 3


def test_rows_of_one_file_are_dealt_to_tasks(spark):
    """A metric in Python runs in many tasks, however few bytes its rows have."""
    from types import SimpleNamespace

    from pyspark import TaskContext

    models = spark.range(2000).selectExpr("'model' as type", "id").coalesce(1)
    task = metrics.RowMetric(lambda batch: [TaskContext.get().partitionId()] * len(batch))
    rows = metrics.run_metrics(SimpleNamespace(models=models), {"task": task}).collect()
    assert len(rows) == 2000 and len({r.score for r in rows}) > 4


def test_halves_that_must_fail_are_not_tried():
    import pandas as pd

    sizes = []

    def score(batch):
        sizes.append(len(batch))
        if (batch["id"] == 7).any():
            raise ValueError("seven")
        return batch["id"]

    batch = pd.DataFrame({"type": ["model"] * 8, "id": range(8)})
    (found,) = metrics._scored(score)(iter([batch]))
    assert list(found["error"].notna()) == [False] * 7 + [True] and list(found["score"][:7]) == list(range(7))
    assert sizes == [8, 4, 2, 1, 1]
