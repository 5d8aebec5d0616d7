"""Identifiers, URLs, rounding, sizes, guards and code facts."""

import ast
import hashlib
import math
import random
from datetime import datetime, timezone

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions import files, guard, ids, numeric, urls
from trustlake.operators import code


def test_artifact_id(evaluate):
    names = ["Test Model", "a", "é-x", "owner/repo", "", "\U0001f600"]
    expected = [int(hashlib.sha256(n.encode()).hexdigest(), 16) % C.ID_MODULUS for n in names]
    assert evaluate(ids.artifact_id, names) == expected


URLS = {
    "hf://google/gemma-3-270m": "google/gemma-3-270m",
    "hf://bert-base-uncased": "bert-base-uncased",
    "bert-base-uncased": "bert-base-uncased",
    "google/gemma-3-270m": "google/gemma-3-270m",
    "not_a_url_thing": "not_a_url_thing",
    "https://example.com/some/model": "https://example.com/some/model",
    "https://huggingface.co/bert-base-uncased": "bert-base-uncased",
    "https://huggingface.co/google/gemma-3-270m": "google/gemma-3-270m",
    "https://huggingface.co/google/gemma-3-270m/tree/main": "google/gemma-3-270m",
    "https://huggingface.co/google/gemma-3-270m/blob/main/file.txt": "google/gemma-3-270m",
    "https://huggingface.co/google/gemma-3-270m/resolve/main/m.safetensors": "google/gemma-3-270m",
    "https://huggingface.co/google/gemma-3-270m/files": "google/gemma-3-270m",
    "https://huggingface.co/datasets/google/x": "https://huggingface.co/datasets/google/x",
    "https://huggingface.co/google/gemma-3-270m/": "google/gemma-3-270m",
    "https://huggingface.co/": "https://huggingface.co/",
    "https://huggingface.co/google/gemma-3-270m/commits/main": "google/gemma-3-270m",
    " hf://google/gemma-3-270m ": "google/gemma-3-270m",
    "\thttps://huggingface.co/a/b?x=1#y\n": "a/b",
    "https://huggingface.co/tree/main": None,
}


def test_model_id(evaluate):
    assert evaluate(urls.model_id, list(URLS)) == list(URLS.values())


def test_github_repo(evaluate):
    values = [
        "https://github.com/o/r", "https://github.com/o/r.git", "http://www.github.com/o/r/tree/x",
        "https://github.com/o", "https://gitlab.com/o/r", "github.com/o/r", None,
        "https://github.com/o/.git",
    ]
    found = [r and (r.owner, r.repo) for r in evaluate(urls.github_repo, values)]
    assert found == [("o", "r"), ("o", "r"), ("o", "r"), None, None, None, None, None]


def test_repo_link_prefers_explicit_scheme_in_html(evaluate):
    html = 'github.com/a/b <a href="https://github.com/c/d.git">'
    (bare,) = evaluate(urls.repo_link, [html])
    (page,) = evaluate(lambda c: urls.repo_link(c, html=True), [html])
    assert (bare.owner, bare.repo) == ("a", "b")
    assert (page.owner, page.repo) == ("c", "d.git")


def test_link_pair(evaluate):
    pairs = evaluate(urls.link_pair, ["a, b", "NULL,NULL", "one", "a,b,c"])
    assert [tuple(p) for p in pairs] == [("a", " b"), ("NULL", "NULL"), (None, None), ("a", "b")]


def test_round3_equals_python(evaluate):
    rng = random.Random(1)
    values = [i / 16 for i in range(33)] + [0.0005, 0.0015, 0.0025, 2.675, 1.0005, -0.3445, -1.0]
    values += [rng.random() for _ in range(5000)]
    values += [sum(rng.randrange(1001) / 1000 for _ in range(10)) / 10 for _ in range(5000)]
    assert evaluate(numeric.round3, values, "double") == [round(v, 3) for v in values]
    assert evaluate(numeric.round3, [None], "double") == [None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 2), min_size=50, max_size=300))
def test_round3_property(evaluate, values):
    assert evaluate(numeric.round3, values, "double") == [round(v, 3) for v in values]


def test_nulls_stay_nulls(evaluate):
    assert evaluate(numeric.clamp01, [None, -1.0, 0.5, 3.0], "double") == [None, 0.0, 0.5, 1.0]
    assert evaluate(numeric.score_clamp, [None, -1.0, 0.5], "double") == [None, 0.0, 0.5]


def test_popularity_and_freshness(evaluate):
    assert evaluate(numeric.popularity, ["bad", None, "0", "999999"]) == [0.0, 0.0, 0.0, 1.0]
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    as_of = F.lit(now.isoformat()).cast("timestamp")
    dates = ["2024-01-01T00:00:00.000Z", "2025-01-01T00:00:00Z", "2023-01-01T00:00:00Z",
             "2023-07-02T12:00:00+00:00", "2020-01-01", "bad", "2024", None, "2024-13-45T00:00:00Z"]
    expected = [1.0, 1.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0]
    got = evaluate(lambda c: numeric.freshness(c, as_of), dates)
    assert all(math.isclose(g, e, abs_tol=2e-3) for g, e in zip(got, expected))


def test_trust_band(evaluate):
    bands = evaluate(numeric.trust_band, [0.0, 0.299, 0.3, 0.699, 0.7, 1.0, None], "double")
    assert bands == ["low", "low", "moderate", "moderate", "strong", "strong", None]


def test_weight_files(evaluate):
    names = ["a.bin", "A.SAFETENSORS", "x/model.json", "pytorch_model-1.txt", "README.md", "x.pt",
             "models/readme.txt", " b.gguf ", "weights/adapter_model", "a.binx", ""]
    assert evaluate(files.is_weight_file, names) == [
        True, True, True, True, False, True, False, True, True, False, False,
    ]


def test_size_bytes(spark):
    rows = [("10", None, 10), ("x", "bytes 0-0/99", 99), (None, "bytes 0-0/ 7 ", 7), ("0", "b/5", 0),
            (None, "bytes", None), (None, None, None), ("", "a/b/5", None)]
    df = spark.createDataFrame(rows, "l string, r string, e long")
    got = df.select(files.size_bytes("l", "r").alias("x"), "e").collect()
    assert all(r.x == r.e for r in got)


def test_device_buckets(evaluate):
    gib = 1024**3
    edges = [0.2, 0.5, 1, 2, 4, 8, 16, 32, 40, 60, 64, 80, 100, 120]
    sizes = [int(e * gib) for e in edges] + [int(e * gib) + 1 for e in edges]
    pi = [1.0, 0.6, 0.6, 0.4, 0.2] + [0.0] * 9 + [0.8, 0.6, 0.6, 0.4, 0.2] + [0.0] * 9
    nano = [1.0, 0.75, 0.5, 0.5, 0.25] + [0.0] * 9
    desktop = [1.0, 1.0, 1.0, 1.0, 0.8, 0.6, 0.4, 0.2, 0.2, 0.2] + [0.0] * 4
    server = [1.0] * 8 + [0.8, 0.6, 0.6, 0.4, 0.2, 0.0]
    scores = evaluate(files.device_scores, sizes, "long")
    # 0.2 GiB is no whole number of bytes: int() rounds down, the next byte is above.
    assert [s.raspberry_pi for s in scores] == pi
    assert [s.jetson_nano for s in scores][:14] == nano
    assert [s.desktop_pc for s in scores][:14] == desktop
    assert [s.aws_server for s in scores][:14] == server
    assert evaluate(files.device_scores, [0, None], "long") == [None, None]


def test_guard(evaluate):
    unsafe = ["(a+)+", "a{1,999999}", "(.*)*", "(a|aa)*", "(a)+?", "(foo|foobar)+", "(a|)*",
              "x{2,99999999999999999999999}", "(a?)?", "(x)* +"]
    safe = ["Ali", "alice", "ZZZ", "a{1,500}", "(a|b)*", "(foo|bar)+", "^a.*b$", "(ab)+"]
    assert all(evaluate(guard.unsafe_reason, unsafe))
    assert not any(evaluate(guard.unsafe_reason, safe))
    assert evaluate(guard.unsafe_reason, ["(a+)+{1,999}", "(a|aa)*{1,999}"]) == [
        C.REASON_NESTED, C.REASON_REPEAT,
    ]


CODE = {
    "def broken(:\n  pass": 0.0,
    '\ndef add(a, b):\n    """Add."""\n    return a + b\nx = add(1, 2)\n': 1.0,
    "import os\nx = 1\n": 0.975,
    "from os import path\nprint(path)\n": 0.975,  # the module is recorded, not the name
    "async def f():\n    pass\n": 1.0,  # only plain functions are counted
    "def f():\n    pass\n": (10 - 3 - 0.1) / 10,
    "eval('1')\n": 0.75,
    "eval('1')\n" * 5: 0.0,
    "": 1.0,
}


def test_code_score(evaluate):
    scores = evaluate(lambda c: code.code_score(code.code_facts(c)), list(CODE))
    assert all(math.isclose(s, e) for s, e in zip(scores, CODE.values()))


def test_long_code_is_penalised(evaluate):
    body = "\n".join(["    x = 1"] * 55)
    source = (
        "import os\ng = 0\ndef f():\n    global g\n" + body + "\n    eval('1')\na = '" + "x" * 130 + "'\n"
    )
    (facts,) = evaluate(code.code_facts, [source])
    assert (facts.functions, facts.undocumented, facts.long_functions) == (1, 1, 1)
    assert (facts.globals, facts.risky, facts.long_lines) == (1, 1, 1)
    assert facts.imports == ["os"] and facts.names == ["a", "eval", "g", "x"]
    size = len(ast.parse(source).body[2].body)
    assert math.isclose(facts.complexity, 1 + math.log(size))
    (score,) = evaluate(lambda c: code.code_score(code.code_facts(c)), [source])
    assert 0.0 <= score < 0.8


def test_nested_functions_count_branches_twice(evaluate):
    source = "def f():\n    'd'\n    def g():\n        'd'\n        if x and y:\n            pass\n"
    (facts,) = evaluate(code.code_facts, [source])
    assert facts.functions == 2 and facts.complexity == 4.0


def test_unanalysable_code_scores_half(evaluate):
    deep = "x = " + "(" * 150 + "1" + ")" * 150
    long_chain = "x = " + "-" * 100_000 + "1"
    facts = evaluate(code.code_facts, [deep, long_chain, "ok = 1"])
    assert facts[2].valid is True
    scores = evaluate(lambda c: code.code_score(code.code_facts(c)), [long_chain, "ok = 1"])
    assert scores[0] in (0.0, 0.5) and scores[1] == 1.0
