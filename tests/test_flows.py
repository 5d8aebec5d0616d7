"""Joins under skew, registry state, search, listing, health, sources, streams."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlake import schemas
from trustlake.operators import health, joins, listing, lookup, readmes, registry, search
from trustlake.plans import catalog, flows
from trustlake.sources import landing, readme_index, runs, scratch, sinks
from trustlake.streaming import health as stream_health


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_lookup_join_keeps_hot_and_missing_keys(spark, threshold):
    rng = random.Random(4)
    rows = [(i, None if rng.random() < 0.2 else "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}")
            for i in range(3000)]
    facts = spark.createDataFrame(rows, "n int, k string")
    table = spark.createDataFrame([("hot", 1), (None, 2)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    values = {"hot": 1} | {f"k{i}": i for i in range(40)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r.n: r.v for r in joins.lookup_join(facts, table, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {n: values.get(k) for n, k in rows}


def test_building_a_rating_starts_no_job(spark):
    from trustlake.operators.metrics import rate
    from trustlake.plans import tables

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    wide = rate(tables.landed(spark, "/root/testdata/sf0.001"))
    flows.decide(tables.registrations_of(tables.table(spark, "/root/testdata/sf0.001", "part")),
                 tables.landed(spark, "/root/testdata/sf0.001"))
    jobs = tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "net_score" in wide.columns
    # Reading the schema of a Parquet file is the only work.
    assert all("parquet" in (tracker.getStageInfo(s).name if tracker.getStageInfo(s) else "parquet")
               for j in jobs for s in tracker.getJobInfo(j).stageIds)


def record(artifact, name="n", seq=1, kind="model", net=0.5):
    return (kind, artifact, name, f"u{artifact}", None, "{}", net, seq)


RECORD = ("type string, id long, name string, model_url string, download_url string, "
          "results string, net_score double, seq long")


def test_change_log(spark, tmp_path):
    path = str(tmp_path / "log")

    def write(rows, op="put"):
        sinks.append_changes(spark.createDataFrame(rows, RECORD), path, op)

    def names():
        return {(r.type, r.id): r.name for r in sinks.read_current(spark, path).collect()}

    write([record(1, "a", 1), record(2, "b", 2), record(1, "c", 3, "code")])
    write([record(1, "a2", 4)])
    assert names() == {("model", 1): "a2", ("model", 2): "b", ("code", 1): "c"}
    keys = spark.createDataFrame([("model", 2, 5)], "type string, id long, seq long")
    sinks.append_changes(keys, path, "delete")
    assert names() == {("model", 1): "a2", ("code", 1): "c"}
    write([record(2, "b2", 6)])
    assert names()[("model", 2)] == "b2"
    compacted = sinks.compact(spark, path, str(tmp_path / "v2"))
    assert compacted.count() == 3
    marker = spark.createDataFrame([(7,)], "seq long")
    sinks.append_changes(marker, path, "reset")
    assert names() == {}
    write([record(9, "z", 8)])
    assert names() == {("model", 9): "z"}


def test_upsert(spark):
    stored = spark.createDataFrame([record(1, "a", 1), record(2, "b", 2)], RECORD)
    new = spark.createDataFrame([record(2, "b2", 3), record(3, "c", 4)], RECORD)
    merged = registry.upsert(stored, new)
    assert {r.id: r.name for r in merged.collect()} == {1: "a", 2: "b2", 3: "c"}
    assert registry.reset(stored).count() == 0


def test_get_artifacts(spark):
    rows = [record(1, "a"), record(2, ""), record(3, "c", kind="code")]
    keys = spark.createDataFrame([("model", 1), ("model", 2), ("model", 3), ("code", 3), ("model", 1)],
                                 "type string, id long")
    got = lookup.get_artifacts(spark.createDataFrame(rows, RECORD), keys)
    found = sorted((r.type, r.id, r.status, r.metadata and r.metadata.name) for r in got.collect())
    assert found == [("code", 3, "ok", "c"), ("model", 1, "ok", "a"), ("model", 1, "ok", "a"),
                     ("model", 2, "malformed", None), ("model", 3, "not_found", None)]


def test_cost_rounds_half_to_even(spark):
    sizes = [5_242_880, 524_288, 1_572_864, 2_621_440, 0]
    df = spark.createDataFrame([("model", i, s) for i, s in enumerate(sizes)], "type string, id long, length long")
    assert [r.total_cost for r in lookup.cost(df).orderBy("id").collect()] == [5, 0, 2, 2, 0]


def listing_table(spark):
    rows = [(t, i, f"{t}{i}") for t in ("model", "dataset", "code") for i in range(1, 41)]
    return spark.createDataFrame(rows, "type string, id long, name string")


def test_pages_cover_everything_once(spark):
    stored = listing_table(spark)
    seen, offset = [], 0
    while offset is not None:
        rows = flows.list_artifacts(stored, [("*", ["dataset", "model"])], offset).collect()
        rows.sort(key=lambda r: (r.type_rank, str(r.id)))
        seen += [(r.type, r.id) for r in rows]
        offset = rows[0].next_offset
    expected = [(t, int(i)) for t in ("dataset", "model") for i in sorted(map(str, range(1, 41)))]
    assert seen == expected
    assert flows.list_artifacts(stored, [("*", [])], "x").count() == 50
    ordered = listing.union_types(stored, ["dataset", "model"])
    later = listing.page_after(ordered, 0, 9).collect()
    assert [r.type for r in later] == ["model"] * 40


def test_listing_rejects_bad_requests(spark):
    stored = listing_table(spark)
    for queries in ([], [("", [])], [("*", ["image"])]):
        with pytest.raises(ValueError):
            flows.list_artifacts(stored, queries)


def test_search(spark):
    index = spark.createDataFrame(
        [("Alice model", "1", "model", 1), ("old", "2", "code", 2), ("new", "2", "code", 3)],
        "name string, id string, type string, seq long",
    )
    readmes = spark.createDataFrame(
        [("model", 1, "about ALICE"), ("code", 2, "alice too"), ("model", 7, "Alice"), ("model", 8, "Bob")],
        "type string, id long, text string",
    )
    rows = sorted((r.name, r.id, r.type, r.hit_source) for r in search.search(index, readmes, "alice").collect())
    assert rows == [("Alice model", "1", "model", "name"), ("Alice model", "1", "model", "readme"),
                    ("Unknown Name", "7", "model", "readme"), ("new", "2", "code", "readme")]
    assert search.search(index, readmes, "alice", dedupe=True).count() == 3
    assert search.search(index, readmes, "ZZZ").count() == 0
    for pattern in ("", "(a+)+", "a{1,999999}", "(a|aa)*"):
        with pytest.raises(ValueError):
            search.search(index, readmes, pattern)


@pytest.mark.filterwarnings("ignore:Possible")
@pytest.mark.parametrize(
    "pattern",
    [r"(?P<my_name>x+)y(?P=my_name)", "a(?#not seen)+b", r"\\Z", r"b\Z", "[[a&&b]+", "x{,2}y", "z{", "}", "[^]a]z",
     "(?i:A)b", r"\x41\u0042", r"[\b]", r"\bfoo\b", r"(a)(b)\2\1", r"\101", r"[\w-]+=", "a|", r"\$\^", "(?:ab)+?c",
     r"(?<=a)b", r"\Aa", r"[a\]]+", "[~^]", r"\d{2,3}%", r"é\w"],
)
def test_patterns_mean_what_python_means(spark, pattern):
    import re

    texts = ["xxyxx", "xyx", "aab", "ab\n", "ab", "\\Z", "[&a", "xxy", "y", "z{", "}", "bz", "]z", "aB", "AB", "\b",
             "a foo.", "abba", "A", "k-1=2", "", "$^", "ababc", "a]", "~", "12%", "Éa", "É"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r.n for r in df.where(search.matches("t", pattern)).collect()}
    assert got == {i for i, text in enumerate(texts) if re.search(pattern, text, re.I)}


@pytest.mark.parametrize("pattern", ["(", "a**", "(?x)a b", "(?a)x", r"\N{BULLET}", "(a)?(?(1)b|c)", r"\Qx"])
def test_patterns_without_equivalent_are_refused(spark, pattern):
    with pytest.raises(ValueError):
        search.check_pattern(spark.range(0), pattern)


def test_last_index_line_wins(spark, tmp_path):
    """A larger file that is appended later is read first, but its lines are the last."""
    import time

    schema = "name string, id string, type string, seq long"
    first = spark.createDataFrame([("old", "1", "model", 1)], schema)
    later = spark.createDataFrame([("x" * 500, str(i), "model", i) for i in range(2, 300)]
                                  + [("new", "1", "model", 999)], schema)
    for lines in (first, later):
        text = F.concat_ws(",", "name", "id", "type").alias("value")
        lines.select(text).coalesce(1).write.mode("append").text(str(tmp_path / "raw"))
        sinks.append_index(lines, str(tmp_path / "typed"))
        time.sleep(0.05)
    for index in (landing.read_name_index(spark, str(tmp_path / "raw")),
                  landing.read_index(spark, str(tmp_path / "typed"))):
        names = {r.id: r.name for r in search.last_names(index).collect()}
        assert names["1"] == "new" and len(names) == 299


def test_parts_of_an_append_keep_their_order(spark, tmp_path):
    """Tasks end in any order: the time of a part says nothing about its place in the append."""
    import os

    ids = ("11111111-1111-1111-1111-111111111111", "00000000-0000-0000-0000-000000000000")
    for name, text, time in (
        (f"part-00000-{ids[0]}-c000.txt", "a0,1,model", 50), (f"part-00001-{ids[0]}-c000.txt", "a1,1,model\nx,2,code", 40),
        (f"part-00000-{ids[1]}-c000.txt", "b0,2,code", 60), ("other.txt", "c0,3,code\nc1,3,code", 45),
    ):
        (tmp_path / name).write_text(text + "\n")
        os.utime(tmp_path / name, (1_700_000_000 + time,) * 2)
    rows = landing.read_name_index(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.name for r in rows] == ["a0", "a1", "x", "c0", "c1", "b0"]
    names = {r.id: r.name for r in search.last_names(landing.read_name_index(spark, str(tmp_path))).collect()}
    assert names == {"1": "a1", "2": "b0", "3": "c1"}


# --- sources -------------------------------------------------------------------------------


def test_registry_tree(spark, tmp_path):
    def put(path, text):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("artifacts/model/1/metadata.json", json.dumps(
        {"type": "model", "id": 1, "name": "a", "results": {"license": [0.5, 3]}, "net_score": 0.5}, indent=2))
    put("artifacts/code/2/metadata.json", '{"name": "b"')
    put("artifacts/code/3/metadata.json", '{"name": "c", "id": 3, "type": "code"}')
    put("artifacts/code/3/other.json", '{"name": "no", "id": 4, "type": "code"}')
    put("artifacts/model/1/README.md", "# Hé")
    put("artifacts/model/5/docs/README.md", "deep")
    put("artifacts/model/6/readme.md", "lower case")
    put("artifacts/model/7/README.md", b"\xff\xfe broken")
    put("artifacts/model/1/artifact.zip", b"12345")
    root = str(tmp_path)
    stored = {r.id: r for r in landing.read_registry(spark, root).collect()}
    assert sorted(stored) == [1, 3] and stored[3].net_score is None
    assert json.loads(stored[1].results) == {"license": [0.5, 3]}
    texts = {(r.type, r.id): r.text for r in landing.read_readme_tree(spark, root).collect()}
    assert texts == {("model", "1"): "# Hé", ("model", "5"): "deep"}
    sizes = landing.read_object_sizes(spark, root)
    assert [tuple(r) for r in sizes.collect()] == [("model", 1, 5)]
    assert "content" not in sizes._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def written(root):
    return [p for p in root.rglob("*") if p.is_file()]


def test_packed_objects(spark, tmp_path):
    """Sizes of objects of which many lie in one file."""
    keys = ["artifacts/model/1/artifact.zip", "type=code/id=-2/artifact.zip", "model/3/README.md"]
    rows = [(k, bytearray(b"\xff\n" * i)) for i, k in enumerate(keys)]
    root = tmp_path / "objects"
    sinks.pack_objects(spark.createDataFrame(rows, schemas.OBJECT).coalesce(1), str(root))
    sizes = landing.read_object_sizes(spark, str(root), tree=False).collect()
    assert sorted(map(tuple, sizes)) == [("code", -2, 2), ("model", 1, 0)]


def test_packed_records(spark, tmp_path):
    """Documents with several lines, among them one that is cut off."""
    texts = [json.dumps({"type": "model", "id": i, "name": "a\n\x1eb"}, indent=1) for i in range(5)]
    texts[2] = texts[2][:20]
    root = str(tmp_path / "records")
    sinks.pack_records(spark.createDataFrame([(x,) for x in texts], "value string").coalesce(1), root)
    rows = landing.read_registry(spark, root, tree=False).collect()
    assert sorted((r.id, r.name) for r in rows) == [(i, "a\n\x1eb") for i in (0, 1, 3, 4)]


def test_files_do_not_grow_with_artifacts(spark, tmp_path, monkeypatch):
    """Records and object sizes are read from few files, however many the artifacts."""
    monkeypatch.setattr(catalog, "scratch_dir", lambda spark, name: str(tmp_path / name))
    assert catalog.QUERIES["src_object_sizes"](spark, "/root/testdata/sf0.001").count() == 200
    assert len(catalog.QUERIES["src_registry"](spark, "/root/testdata/sf0.001").collect()) == 188
    assert all(len(written(tmp_path / name)) < 20 for name in ("objects", "records"))


def test_name_index_lines(spark, tmp_path):
    (tmp_path / "name_id.txt").write_text(" a , 1 , model \n\nno comma\na,b\nx,1,2,3\na,1,model\n\"q,2,code\n")
    rows = landing.read_name_index(spark, str(tmp_path / "name_id.txt")).orderBy("seq").collect()
    assert [(r.name, r.id, r.type) for r in rows] == [("a", "1", "model"), ("a", "1", "model"), ('"q', "2", "code")]


def test_model_info(spark, tmp_path):
    replies = [
        {"model_id": "o/a", "status_code": 200, "sha": "s", "downloads": 12, "likes": 3,
         "cardData": {"datasets": ["MNIST"]}, "siblings": [{"rfilename": "x"}, {"rfilename": "y"}]},
        {"model_id": "o/b", "status_code": 404, "cardData": {}},
        {"model_id": "o/c", "status_code": 200, "cardData": {"datasets": "not a list"}},
    ]
    (tmp_path / "hub.json").write_text("\n".join(map(json.dumps, replies)))
    info, siblings = landing.read_model_info(spark, str(tmp_path))
    got = {r.model_id: r for r in info.collect()}
    assert got["o/a"].downloads == "12" and got["o/a"].datasets == ["MNIST"] and got["o/a"].has_card
    assert not got["o/b"].has_card and got["o/c"].has_card and not got["o/c"].datasets
    assert [(r.ord, r.rfilename) for r in siblings.orderBy("ord").collect()] == [(0, "x"), (1, "y")]


def test_saved_uses_the_shared_folder(spark):
    df = scratch.saved(spark.range(3), "probe")
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]


# --- health --------------------------------------------------------------------------------

NOW = datetime(2024, 1, 1, 12, 0)


def test_health_report(spark):
    logs = [("a", NOW - timedelta(minutes=m), f"Error {m}", m) for m in range(1, 31)]
    logs += [("a", NOW - timedelta(minutes=5), "WARNING x", 100), ("a", NOW - timedelta(hours=2), "error", 101),
             ("b", NOW - timedelta(minutes=3), "fine", 102), ("c", NOW, "error elsewhere", 103)]
    logs = spark.createDataFrame(logs, "log_group string, ts timestamp, message string, event_id long")
    requests = [(NOW - timedelta(minutes=m, seconds=1), float(m)) for m in range(0, 59)]
    requests = spark.createDataFrame(requests, "ts timestamp, latency_ms double")
    report = flows.health_report(logs, requests, ["a", "b", "empty"], NOW).first()
    assert report.status == "DEGRADED"
    groups = {g.name: g for g in report.log_groups}
    assert groups["a"].summary.asDict() == {"total": 31, "errors": 30, "warnings": 1}
    assert [e.message for e in groups["a"].recent_errors] == [f"Error {m}" for m in range(1, 21)]
    assert groups["empty"].summary.total == 0 and groups["empty"].recent_errors == []
    api = report.api_gateway
    latest = [0.0, 1.0, 2.0, 3.0, 4.0]  # the period 11:55 to 12:00
    assert api.total_requests == 59 and api.avg_latency_ms == 2.0
    assert math.isclose(api.p95_latency_ms, np.percentile(latest, 95))


def test_health_without_data(spark):
    logs = spark.createDataFrame([], "log_group string, ts timestamp, message string, event_id long")
    requests = spark.createDataFrame([], "ts timestamp, latency_ms double")
    report = flows.health_report(logs, requests, ["a"], NOW).first()
    assert report.status == "DEGRADED"
    assert report.api_gateway.asDict() == {
        "avg_latency_ms": 0.0, "p95_latency_ms": 0.0, "p99_latency_ms": 0.0, "total_requests": 0,
    }
    fine = spark.createDataFrame([(NOW, 1.0)], "ts timestamp, latency_ms double")
    assert flows.health_report(logs, fine, ["a"], NOW).first().status == "OK"


@pytest.mark.parametrize("n, distinct", [(1, 5), (2, 5), (37, 9), (12_345, 40), (30_000, 10**9)])
@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.95, 0.99, 1.0])
def test_percentiles_are_exact(spark, n, distinct, fraction):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, distinct, n) / 7).tolist()
    requests = spark.createDataFrame([(NOW, v) for v in values], "ts timestamp, latency_ms double")
    got = health.latency_percentiles(requests, [fraction]).first().latency_ms
    assert math.isclose(got, np.percentile(values, fraction * 100), rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("values", [
    [5.0] * 4000, [1.0 + i * 2**-52 for i in range(3000)], [0.1] * 2000 + [1e300], [-3.5, -0.0, 0.0, 5e-324, -1e-310, 2.0],
    [float(2**i) for i in range(-40, 60)], [7.25 if i % 3 else float("inf") for i in range(50)], [1e-320, 3e-308, 1.0],
])
def test_percentiles_of_clustered_values(spark, values):
    """Constant, clustered and extreme values are told apart to the last bit, in bounded steps."""
    requests = spark.createDataFrame([(NOW, v) for v in [*values, None]], "ts timestamp, latency_ms double")
    fractions = [0.0, 0.25, 0.5, 0.95, 1.0]
    found = health.latency_percentiles(requests.where("latency_ms < 1e20 or latency_ms is null"), fractions)
    finite = [v for v in values if v < 1e20]
    got = {r.fraction: r.latency_ms for r in found.collect()}
    for f in fractions:
        assert got[f] == pytest.approx(np.percentile(finite, f * 100), rel=1e-15, abs=0)


def test_ordered_bits(evaluate):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
              float("inf"), float("-inf"), *np.exp(rng.uniform(-700, 700, 400)), *-np.exp(rng.uniform(-700, 700, 400)),
              *[2.0**i for i in range(-1074, 1024, 7)], *[np.nextafter(2.0**i, 0) for i in range(-1000, 1024, 9)]]
    values = [float(v) for v in values]
    got = evaluate(lambda c: health.ordered_bits(F.col(c)), values, "double")
    image = np.array([abs(v) for v in values]).view(np.int64)
    assert got == [int(-b if v < 0 else b) for b, v in zip(image, values, strict=True)]
    assert evaluate(lambda c: health.ordered_bits(F.col(c)), [float("nan"), None], "double")[0] > max(got)


def test_pages_by_ranks(spark):
    """Every page equals the one by sorting, at any offset."""
    rows = [(t, i * i % 100_003, f"{t}{i}") for t in ("model", "dataset", "code") for i in range(700)]
    stored = spark.createDataFrame(rows, "type string, id long, name string")
    ordered = listing.union_types(stored, ["dataset", "model", "dataset"])
    for offset in (0, 1, 49, 680, 1399, 2050, 2060, 2099, 2100, 9000):
        got, want = (sorted(map(str, listing.page(ordered, offset, deep=deep).collect())) for deep in (0, 10**9))
        assert got == want
    text = listing.page(ordered, 10**7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in text and "GlobalLimit" not in text


def streamed(spark, source, table, root, checkpoint, **options):
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_health.run_cells(stream, table, str(root), str(checkpoint), **options)


def test_stream_drops_nothing_on_replay(spark, tmp_path):
    rows = [("a", NOW + timedelta(minutes=m * 37 % 200), "error" if m % 3 else "ok", m) for m in range(200)]
    logs = spark.createDataFrame(rows, "log_group string, ts timestamp, message string, event_id long")
    source, root = str(tmp_path / "logs"), tmp_path / "cells"
    logs.repartition(5).write.parquet(source)
    streamed(spark, source, "counts", root, tmp_path / "one", merge_every=2)
    # Another checkpoint replays all batches; a later file holds lines of long ago.
    streamed(spark, source, "counts", root, tmp_path / "other", merge_every=2)
    late = logs.withColumn("ts", F.col("ts") - F.expr("interval 40 minutes"))
    late.coalesce(1).write.mode("append").parquet(source)
    streamed(spark, source, "counts", root, tmp_path / "one", merge_every=2)
    both = logs.unionAll(late)
    for cells, want in ((1, stream_health.window_counts(both)), (12, stream_health.hourly_counts(both))):
        got = stream_health.read_counts(spark, str(root), cells)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    hour = {r.window_start: r.total for r in stream_health.hourly_counts(both).collect()}
    start = datetime(2024, 1, 1, 12, 30)
    lines = [r.ts for r in both.collect()]
    assert hour[start] == sum(start <= ts < start + timedelta(hours=1) for ts in lines)
    files = [f for f in (root / "counts").rglob("*.parquet")]
    assert len(files) <= 3 * 8  # merged runs are gone


def test_streamed_latencies(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(NOW + timedelta(seconds=int(s)), float(v)) for s, v in zip(rng.integers(0, 9000, 1500), rng.lognormal(3, 1, 1500))]
    requests = spark.createDataFrame([*rows, (NOW, None)], "ts timestamp, latency_ms double")
    source, root = str(tmp_path / "requests"), tmp_path / "cells"
    requests.repartition(4).write.parquet(source)
    streamed(spark, source, "latencies", root, tmp_path / "check", merge_every=3)
    for cells, exact in ((1, True), (12, False)):
        found = stream_health.read_latencies(spark, str(root), cells).collect()
        assert len(found) >= 30
        for r in found:
            held = sorted(v for ts, v in rows if r.window_start <= ts < r.window_end)
            assert r.requests == len(held) and r.avg_latency_ms == pytest.approx(np.mean(held), abs=1e-5)
            if exact or len(held) <= stream_health.SKETCH:
                assert r.percentile_ms == held[math.ceil(0.95 * len(held)) - 1]
            else:
                assert 0.93 <= sum(v <= r.percentile_ms for v in held) / len(held) <= 0.97


def test_join_built(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "z")], "n int, k string")
    landed = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("c", 9)], "key string, v int")

    def build(wanted):
        sums = landed.groupBy(F.col("key").alias("k")).agg(F.sum("v").alias("v"))
        return wanted.join(sums, "k", "left")

    got = joins.join_built(facts, ["k"], build)
    assert {r.n: r.v for r in got.collect()} == {1: 3, 2: 3, 3: 5, 4: None, 5: None}


# --- runs of the stored registry --------------------------------------------------------------

DECIDED = ("type string, id long, name string, model_url string, status string, failures array<string>, "
           "results string, net_score double, error string, seq long")


def decided(spark, *names, start=1, kind="model"):
    rows = [(kind, 100 + len(n), n, f"https://huggingface.co/o/{n}", "created", [], "{}", 0.5, None, start + i)
            for i, n in enumerate(names)]
    return spark.createDataFrame(rows, DECIDED)


def readme_reply(spark, *rows):
    return spark.createDataFrame([(k, 200, [("x",), (name,)], None, None, text) for k, name, text in rows],
                                 schemas.README_REPLY)


def lines(spark, root):
    runs = flows.registry_runs(spark, root)
    return sorted((r.name, r.id) for r in runs.read("index").collect()), runs.read("changes").count()


def test_each_run_appends_once(spark, tmp_path):
    root, none = str(tmp_path / "registry"), readme_reply(spark)
    done = [flows.store(decided(spark, n), none, root, n[0]) for n in ("alpha", "be", "be", "gam")]
    assert done == [True, True, False, True]
    assert lines(spark, root) == ([("alpha", "105"), ("be", "102"), ("gam", "103")], 3)
    assert flows.search_stored(spark, root, "alpha").count() == 1
    manifest = {r.run: (r.at, r.rows) for r in flows.registry_runs(spark, root).manifest().collect()}
    assert manifest["g"] == (3, {"decisions": 1, "changes": 1, "index": 1, "readmes": 0, "texts": 0, "grams": 0})


@pytest.mark.parametrize("fails_at", ["decisions", "changes", "index", "readmes", "grams", "manifest"])
def test_killed_run_is_repeated(spark, tmp_path, monkeypatch, fails_at):
    """A run that ends before its row of the manifest is written has no effect; repeated, it has one."""
    root = str(tmp_path / "registry")
    replies = readme_reply(spark, ("huggingface.co/o/two", "README.md", "text of two"))
    flows.store(decided(spark, "one"), replies, root, "first")
    before = lines(spark, root)
    path = runs.Runs.path

    def broken(self, name, run):
        if name == fails_at:
            raise OSError("the disk is gone")
        return path(self, name, run)

    with monkeypatch.context() as patch:
        patch.setattr(runs.Runs, "path", broken)
        with pytest.raises(OSError):
            flows.store(decided(spark, "two", "three"), replies, root, "second")
    assert lines(spark, root) == before
    # What the first try left does not show, even if the second one decides otherwise.
    assert flows.store(decided(spark, "two"), replies, root, "second")
    assert lines(spark, root) == ([("one", "103"), ("two", "103")], 2)
    state = {r.name: r.readme for r in flows.stored_state(spark, root).collect()}
    assert state == {"two": "artifacts/model/103/README.md"}  # same id, the later run wins


def test_later_runs_win_and_compaction_keeps_order(spark, tmp_path):
    root = str(tmp_path / "registry")
    replies = readme_reply(spark, ("huggingface.co/o/aa", "README.md", "first"),
                           ("huggingface.co/o/bb", "README.md", "second"), ("huggingface.co/o/ccc", "docs/readme", "deep"))
    flows.store(decided(spark, "aa", "ccc", start=50), replies, root, "one")
    flows.store(decided(spark, "bb", start=1), replies, root, "two")  # the id of aa, at a lower place
    flows.store(decided(spark, "dddd"), replies, root, "three")
    flows.remove(spark.createDataFrame([("model", 104)], "type string, id long"), root, "four")

    def seen():
        found = flows.registry_runs(spark, root)
        return (sorted((r.id, r.name, r.index_name, r.readme) for r in flows.stored_state(spark, root).collect()),
                sorted((r.id, r.name) for r in found.read("index").collect()),
                sorted((r.path, r.text) for r in
                       readme_index.with_texts(found, readme_index.current(found.read("readmes"))).collect()))

    before = seen()
    assert before[0] == [(102, "bb", "bb", "artifacts/model/102/README.md"),
                         (103, "ccc", "ccc", "artifacts/model/103/docs/readme")]
    assert len(before[1]) == 4 and before[2][0] == ("artifacts/model/102/README.md", "second")
    assert flows.compact(spark, root, "base") and seen() == before
    flows.registry_runs(spark, root).vacuum()
    assert seen() == before and not (tmp_path / "registry/changes/run=one").exists()
    assert not flows.store(decided(spark, "aa"), replies, root, "one")  # done, though its rows moved
    flows.store(decided(spark, "zz"), replies, root, "five")
    assert [r.name for r in flows.stored_records(spark, root).where("id = 102").collect()] == ["zz"]
    flows.clear(spark, root, "six")
    assert flows.stored_records(spark, root).count() == 0
    flows.store(decided(spark, "again"), replies, root, "seven")
    flows.compact(spark, root, "base-2")
    assert [r.name for r in flows.stored_records(spark, root).collect()] == ["again"]
    assert {r.run for r in flows.registry_runs(spark, root).live().collect()} == {"base-2"}


def test_run_ids(spark, tmp_path):
    for run in ("", "a/b", "../x", "a b"):
        with pytest.raises(ValueError):
            flows.store(decided(spark, "a"), readme_reply(spark), str(tmp_path / "r"), run)
    found = flows.registry_runs(spark, str(tmp_path / "none"))
    assert found.read("index").count() == 0 and found.next_number() == 1


def test_readme_keys(evaluate):
    urls = ["https://github.com/o/r.git", "https://GitHub.com/o/r/tree/x", "https://github.com/o", "o/r", "hf://o/r",
            "https://huggingface.co/o/r/tree/main", "https://huggingface.co/datasets/o/d/x", "https://huggingface.co/",
            "https://gitlab.com/o/r", None]
    assert evaluate(readmes.readme_key, urls) == [
        "github.com/o/r", "github.com/o/r", None, None, None, "huggingface.co/o/r", "huggingface.co/datasets/o/d", None,
        None, None,
    ]


def test_readmes_of_all_types(spark, tmp_path):
    import base64

    root = str(tmp_path / "registry")
    code = base64.b64encode("# Héllo".encode()).decode()
    replies = spark.createDataFrame(
        [("github.com/o/c", 200, None, "README.rst", code[:5] + "\n" + code[5:], None),
         ("huggingface.co/datasets/o/d", 200, [("data.csv",), ("ReadMe.txt",)], None, None, "a data set"),
         ("huggingface.co/o/gone", 404, [("README.md",)], None, None, "lost")],
        schemas.README_REPLY,
    )
    rows = [("code", 1, "https://github.com/o/c.git"), ("dataset", 2, "https://huggingface.co/datasets/o/d"),
            ("model", 3, "https://huggingface.co/o/gone"), ("model", 4, "https://github.com/o/c")]
    made = spark.createDataFrame([(k, i, f"n{i}", u, "created", [], "{}", 0.0, None, i) for k, i, u in rows], DECIDED)
    flows.store(made, replies, root, "r")
    found = flows.registry_runs(spark, root)
    assert found.read("texts").count() == 2  # the same text is kept once
    found = readme_index.with_texts(found, found.read("readmes")).collect()
    assert sorted((r.type, r.id, r.path, r.text) for r in found) == [
        ("code", 1, "artifacts/code/1/README.rst", "# Héllo"),
        ("dataset", 2, "artifacts/dataset/2/ReadMe.txt", "a data set"),
        ("model", 4, "artifacts/model/4/README.rst", "# Héllo"),
    ]


def test_registrations_of_a_batch_are_ordered(spark, tmp_path):
    """Of registrations of a name in one batch the last by place is stored, in every run."""
    from trustlake.streaming import register

    rows = [("m", f"https://huggingface.co/o/u{i}") for i in range(40)]
    requests = spark.createDataFrame(rows, "name string, url string").coalesce(1)
    source, root = str(tmp_path / "in"), str(tmp_path / "registry")
    requests.write.parquet(source)
    stream = spark.readStream.schema(requests.schema).parquet(source)
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    seen = []

    def store(batch, run):
        seen.append(run)
        made = batch.repartition(7).select(
            F.lit("model").alias("type"), F.lit(1).cast("long").alias("id"), "name",
            F.col("url").alias("model_url"), F.lit("created").alias("status"),
            F.lit("{}").alias("results"), F.lit(0.5).alias("net_score"), "seq",
        )
        flows.store(made, readme_reply(spark, ("huggingface.co/o/u39", "README.md", "last")), root, run)

    for checkpoint in ("check", "other"):  # another checkpoint replays the batch under its id
        register.run_registrations(stream.select("*", place.alias("place")), store, str(tmp_path / checkpoint))
    assert seen == ["stream-0", "stream-0"]
    stored = flows.stored_state(spark, root).collect()
    assert [(r.model_url, r.index_name, r.readme) for r in stored] == [
        ("https://huggingface.co/o/u39", "m", "artifacts/model/1/README.md")
    ]
    assert flows.registry_runs(spark, root).read("index").count() == 40


def test_deletion_is_stored(spark, tmp_path):
    log = str(tmp_path / "log")
    sinks.append_changes(spark.createDataFrame([record(1), record(2)], RECORD), log)
    keys = spark.createDataFrame([("model", 2, 9), ("model", 7, 9)], "type string, id long, seq long")
    assert [r.id for r in sinks.delete_artifacts(keys, log).collect()] == [7]
    assert [r.id for r in sinks.read_current(spark, log).collect()] == [1]


def test_update_existence(spark):
    stored = spark.createDataFrame([record(1), record(2)], RECORD)
    updates = spark.createDataFrame(
        [("model", 1, "model", 1, "a"), ("model", 1, "model", 1, ""), ("code", 2, "model", 2, "b"),
         ("model", 9, "model", 9, "c")],
        "path_type string, path_id long, type string, id long, name string",
    )
    statuses = sorted(r.status for r in registry.validate_updates(updates, stored).collect())
    assert statuses == ["invalid", "invalid", "not_found", "ok"]
    assert sorted(r.id for r in registry.existing_updates(updates, stored).collect()) == [1, 1, 2]
    assert [r.id for r in registry.missing_updates(updates, stored).collect()] == [9]
