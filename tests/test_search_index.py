"""Trigrams of patterns and texts, and the searches that go by them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from trustlake.operators import search
from trustlake.operators import trigrams as tri
from trustlake.plans import flows
from trustlake.plans import tables as t
from trustlake.sources import readme_index

SF = "/root/testdata/sf0.001"
PATTERNS = [
    "alpha", "alp(ha|en)", "a.c", "x*", "licen[cs]e", "^alpha beta$", "(ab|cd){2}ef", "foo|barbaz|q", "Ünï alpha",
    "a(?=lph)lpha", "(?!alpha)beta", r"\balpha\b", r"alp\w+ta", "[0-9]{2,3}%", "(?:gam)?ma delta", "[^a]lpha", "[a-c]eta",
    "(alp)ha \\1", "STRASSE", "kelvin", "[k]elvin", "al{2,}", "(?i:Alpha)", "ha b", "delta|(?:alpha|beta) gamma",
]
WORDS = ["alpha", "beta", "gamma", "delta", "ALPHA", "licence", "License", "Kelvin", "ſmall", "Straße", "abcdef",
         "cdabef", "12%", "x", "barbaz", "foo", "alppp", "ma", "İı", "ÜnÏ", "\n", "allll"]


def texts_of(seed, count, longest=12):
    rnd = random.Random(seed)
    return [rnd.choice((" ", "", "-")).join(rnd.choices(WORDS, k=rnd.randint(0, longest))) for _ in range(count)]


def true_of(formula, grams):
    if formula is None or isinstance(formula, str):
        return formula is None or formula in grams
    return (all if formula[0] == "and" else any)(true_of(p, grams) for p in formula[1])


def random_pattern(rnd, depth=0):
    kind = rnd.randrange(9 if depth < 3 else 4)
    if kind < 3:
        return re.escape(rnd.choice(("alpha", "bet", "amm", "licen", "ma d", "def")))
    if kind == 3:
        return rnd.choice((".", "[a-e]", r"\w", "[ps]", "l", "[^x]"))
    inner = random_pattern(rnd, depth + 1)
    if kind == 4:
        return f"({inner}|{random_pattern(rnd, depth + 1)})"
    if kind == 5:
        return f"(?:{inner}){rnd.choice(('?', '{1,2}', '{2}', '+?'))}"
    return inner + random_pattern(rnd, depth + 1)


def test_formulas_are_true_of_every_match(spark):
    texts = texts_of(1, 600)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    grams = {r.n: set().union(*r.g) if r.g else set() for r in df.select("n", tri.trigrams(F.col("t")).alias("g")).collect()}
    rnd = random.Random(2)
    hits = 0
    for pattern in PATTERNS + [random_pattern(rnd) for _ in range(400)]:
        formula, cover = tri.required(pattern), tri.cover(tri.required(pattern))
        for n, text in enumerate(texts):
            if re.search(pattern, text, re.I):
                hits += 1
                assert true_of(formula, grams[n]), (pattern, text)
                assert cover is None or cover & grams[n], (pattern, text)
    assert hits > 5000
    assert tri.required("alpha") == ("and", frozenset({"alp", "lph", "pha"})) and tri.required("a.c") is None


def test_trigrams_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(tri, "BLOCK", 5)
    text = "the quick Krown fox\néè abc"
    df = spark.createDataFrame([(text,), ("ab",), ("",), (None,)], "t string")
    got = [r.g for r in df.select(tri.trigrams(F.col("t")).alias("g")).collect()]
    low = text.lower().replace("K", "k")
    assert set().union(*got[0]) == {low[i : i + 3] for i in range(len(low) - 2) if low[i : i + 3].isascii()}
    assert [sum(map(len, g or [])) for g in got[1:]] == [0, 0, 0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """READMEs of 300 artifacts in three runs, some stored again with another text."""
    runs = flows.registry_runs(spark, str(tmp_path_factory.mktemp("registry")))
    now = {}
    for k, run in enumerate(("a", "b", "c")):
        rows = []
        for i, text in enumerate(texts_of(k, 200)):
            artifact = (i * 7 + k * 100) % 300
            text = "one copy of many" if i % 3 == 0 else text
            path = f"artifacts/model/{artifact}/" + ("notes.txt" if artifact % 10 == 9 else "README.md")
            rows.append(("model", artifact, path, text, f"{i:05d}"))
            now[path] = (artifact, text)
        found = spark.createDataFrame(rows, "type string, id long, path string, text string, place string")
        runs.write(run, readme_index.indexed(runs, run, lambda found=found: found))
    return runs, {a: text for path, (a, text) in now.items() if path.endswith("README.md")}


@pytest.mark.filterwarnings("ignore:Possible")
def test_index_equals_scan(spark, stored):
    runs, texts = stored
    assert runs.read("texts").groupBy("digest").count().where("count > 1").isEmpty()
    for pattern in [p for p in PATTERNS if "(?i:" not in p][::2] + ["one copy", "nothing here"]:
        got = sorted(int(r.id) for r in readme_index.search_readmes(runs, pattern).collect())
        assert got == sorted(a for a, text in texts.items() if re.search(pattern, text, re.I)), pattern


def test_few_texts_are_read_for_a_rare_pattern(spark, stored):
    runs, _ = stored
    all_texts = runs.read("texts").count()
    rare = spark.createDataFrame([("model", 999, "artifacts/model/999/README.md", "a Zyxwvut of its own", "")],
                                 "type string, id long, path string, text string, place string")
    runs.write("rare", readme_index.indexed(runs, "rare", lambda: rare))
    found = readme_index.possible_texts(runs, "zyxw[uv]+t")
    assert found.count() == 1 and all_texts > 300
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert any("shard" in s for s in scans)
    assert [r.id for r in readme_index.search_readmes(runs, "zyxw[uv]+t").collect()] == ["999"]
    assert readme_index.possible_texts(runs, "a.c").count() == all_texts + 1


# --- tables of patterns -----------------------------------------------------------------------


def brute(docs, patterns):
    return sorted((d, p) for d, text in docs if text is not None for p, regex in patterns
                  if re.search(regex, text, re.I))


def rows_of(found):
    return sorted((r.d, r.pattern_id) for r in found.collect())


@pytest.mark.filterwarnings("ignore:Possible")
@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_pattern_tables(spark, threshold):
    docs = list(enumerate(texts_of(9, 150))) + [(1000 + i, "the same alpha beta") for i in range(100)] + [(2000, None)]
    good = [(i, p) for i, p in enumerate(PATTERNS)]
    bad = [(100, "(x+)+"), (101, "("), (102, ""), (103, "(?x)a"), (104, "(a|aa)*")]
    table = spark.createDataFrame(docs, "d int, text string").selectExpr("d", "text", "'y' as gram", "d as _n")
    patterns = spark.createDataFrame(good + bad, "pattern_id int, regex string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, threshold)
    try:
        found = search.multi_search(table, patterns)
        assert found.columns == ["d", "gram", "_n", "pattern_id"]
        assert rows_of(found) == brute(docs, good)
    finally:
        spark.conf.unset(name)


def test_ten_thousand_patterns(spark):
    names = [(r.seq, r.name) for r in t.artifacts(spark, SF).collect()]
    kinds = ("ring {}$", "^red widget {}", "(bolt|gear) {}[0-9]?", "x{}y", "l{}|widget {}")
    patterns = [(i, kinds[i % 5].replace("{}", str(i // 5))) for i in range(10_000)]
    found = search.multi_search(
        spark.createDataFrame(names, "d long, text string"),
        spark.createDataFrame(patterns, "pattern_id int, regex string"),
    )
    compiled = [(p, re.compile(regex, re.I)) for p, regex in patterns]
    assert rows_of(found) == sorted((d, p) for d, text in names for p, c in compiled if c.search(text))


def test_nothing_to_match(spark):
    docs = spark.createDataFrame([(1, "a")], "d int, text string")
    patterns = spark.createDataFrame([(1, "a")], "pattern_id int, regex string")
    assert search.multi_search(docs.limit(0), patterns).collect() == []
    assert search.multi_search(docs, patterns.where("false")).collect() == []
    twice = search.multi_search(docs.unionAll(docs), patterns)
    assert rows_of(twice) == [(1, 1), (1, 1)]


def test_each_pattern_meets_a_text_once(spark):
    """Patterns and texts that occur often are compared once; ids and rows come after."""
    texts = spark.range(300).selectExpr("id as d", "concat('blue ring ', id % 3) as text")
    patterns = spark.range(400).selectExpr("cast(id as int) as pattern_id", "concat(elt(1 + id % 2, 'ring ', '[a-z] '), id % 2) as regex")
    anchors = patterns.mapInPandas(search._anchors, search._ANCHOR)
    found = search.matched_texts(texts.select(search.digest("text").alias("_digest"), texts.text.alias("_text")), anchors)
    assert found.count() == found.distinct().count() == 2
    pairs = rows_of(search.multi_search(texts, patterns))
    assert pairs == sorted((d, p) for d in range(300) for p in range(400) if d % 3 == p % 2)


# --- postings ---------------------------------------------------------------------------------


def grams_in(text):
    low = "".join(tri.FOLDED.get(c, c) for c in text or "").lower()
    return {low[i : i + 3] for i in range(len(low) - 2) if low[i : i + 3].isascii()}


@pytest.mark.parametrize("size", [3, 7, 1 << 20])
def test_postings_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(tri, "SLICE", size)
    odd = ["", None, "ab", "the quick Krown fox\néè abc", "İSſ ıK", "x\0y\0z", "abab" * 9, "é" * 5, "ABC", "abc"]
    texts = [(i * 10**12 - 7, text) for i, text in enumerate(odd + texts_of(5, 30))]
    found = tri.postings(spark.createDataFrame(texts, "doc long, text string").repartition(2)).collect()
    got = {(r.gram, doc) for r in found for doc in r.docs}
    assert got == {(gram, doc) for doc, text in texts for gram in grams_in(text)}


def test_postings_are_stored_many_to_a_row(spark, stored):
    runs, _ = stored
    rows = runs.read("grams").where("run = 'a'")
    texts = {r.doc: r.text for r in runs.read("texts").where("run = 'a'").collect()}
    pairs = {(gram, doc) for doc, text in texts.items() for gram in grams_in(text)}
    assert {(r.gram, doc) for r in rows.collect() for doc in r.docs} == pairs
    assert rows.count() * 2 < len(pairs)


def test_compacted_postings_are_those_of_the_texts_that_stay(spark, tmp_path):
    runs = flows.registry_runs(spark, str(tmp_path))
    for run, text in (("a", "the first text"), ("b", "another one"), ("c", "the first text again")):
        path = "artifacts/model/1/README.md" if run != "b" else "artifacts/model/2/README.md"
        row = spark.createDataFrame([("model", 1, path, text, "")], "type string, id long, path string, text string, place string")
        runs.write(run, readme_index.indexed(runs, run, lambda row=row: row))
    flows.compact(spark, str(tmp_path), "base")
    held = {r.doc: r.text for r in runs.read("texts").collect()}
    assert sorted(held.values()) == ["another one", "the first text again"]
    got = {(r.gram, doc) for r in runs.read("grams").collect() for doc in r.docs}
    assert got == {(gram, doc) for doc, text in held.items() for gram in grams_in(text)}


# --- tables of many patterns ------------------------------------------------------------------


def test_words_decide_like_their_pattern():
    plain = {"alp(ha|en)": {"alpha", "alpen"}, "(red|blue|15) widget": {"red widget", "blue widget", "15 widget"},
             "bert|robertα?|bertha": None, "bert|bertha": {"bert"}, "[kK]elvin|\\bfoo": None, "(?-i:Foo|Bar)": None,
             "(?>a|ab)cde": None, "foo|ba": None, "(ring|bolt) 4$": None, "x{3}y|lic[ce]ns(e)?": {"xxxy", "liccns", "licens"}}
    for pattern, expected in plain.items():
        assert tri.words(pattern) == expected, pattern
    rnd, texts = random.Random(3), [t.replace("\n", " ") for t in texts_of(4, 300)]
    for pattern in PATTERNS + [random_pattern(rnd) for _ in range(600)]:
        words = tri.words(pattern)
        for text in texts if words else ():
            low = "".join(tri.FOLDED.get(c, c) for c in text).lower()
            assert any(w in low for w in words) == bool(re.search(pattern, text, re.I)), (pattern, text)


def test_crowded_trigrams_give_way_to_longer_pieces(spark):
    """Many patterns that share trigrams meet few texts: candidates do not grow with both."""
    patterns = spark.range(100_000, 102_000).selectExpr("cast(id as int) as pattern_id", "concat('^Small .* ', id) as regex")
    anchors = patterns.mapInPandas(search._anchors, search._ANCHOR)
    ties = search._ties(anchors)
    assert ties.count() == 2000 == ties.select("key").distinct().count()
    by_gram = ties.groupBy("gram").count()
    assert by_gram.where(F.col("count") > search.CROWD).isEmpty()
    assert not by_gram.where(F.length("gram") == tri.LONG).isEmpty()
    few = patterns.limit(10).mapInPandas(search._anchors, search._ANCHOR)
    assert {len(r.gram) for r in search._ties(few).collect()} == {tri.SIZE}


def test_words_are_looked_for_once(spark):
    """A word that many patterns share is one row for a text, and patterns that share texts come once."""
    patterns = spark.range(500).selectExpr("cast(id as int) as pattern_id", "concat('(red|blue|x', id, ') widget') as regex")
    again = spark.createDataFrame([(7, "red|blue"), (7, "blue wid|red wid")], "pattern_id int, regex string")
    table = patterns.unionAll(again)
    docs = [(0, "a RED widget"), (1, "red widget, blue widget"), (2, "X41 widget"), (3, "red"), (4, "none"), (5, "red widget, Blue widget")]
    texts = spark.createDataFrame(docs, "d int, text string")
    anchors = table.mapInPandas(search._anchors, search._ANCHOR)
    found = search.matched_texts(texts.select(search.digest("text").alias("_digest"), texts.text.alias("_text")), anchors)
    assert found.count() <= 6 * 7
    everything = [(r.pattern_id, r.regex) for r in table.collect()]
    assert rows_of(search.multi_search(texts, table)) == brute(docs, everything)


# --- what moves -------------------------------------------------------------------------------


def moved(df):
    """Columns of each exchange of rows in the plan."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [re.findall(r"(\w+)#", columns) for columns in re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)]


def test_texts_move_once_and_not_to_be_compacted(spark, tmp_path):
    runs = flows.registry_runs(spark, str(tmp_path))
    schema = "type string, id long, path string, text string, place string"
    rows = [("model", i, f"artifacts/model/{i}/README.md", f"text {i % 40} of many", "") for i in range(100)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", 2 * readme_index.SHARDS)
    try:
        for run, start in (("a", 0), ("b", 50)):
            found = spark.createDataFrame([(*r[:3], r[3] + ("" if r[1] % 2 else run), r[4]) for r in rows[start:]], schema)
            tables = readme_index.indexed(runs, run, lambda found=found: found)
            if run == "b":
                assert sum("text" in columns for columns in moved(tables["texts"]())) == 1
            runs.write(run, tables)
            assert moved(tables["grams"]()) == []
        folds = readme_index.compacted(runs, "base")
        columns = moved(folds["texts"](runs.sharded("texts")))
        assert columns and not any("text" in c for c in columns)
        texts = {"".join(r[3] + ("" if r[1] % 2 else "b" if r[1] >= 50 else "a")) for r in rows}
        assert {r.text for r in runs.sharded("texts").collect()} >= texts
        runs.compact("base", folds)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(r.text for r in runs.read("texts").collect()) == sorted(texts)
    lies = runs.written("texts", "base").select("shard", "doc", F.input_file_name().alias("file"))
    assert lies.where(readme_index._shard(F.col("doc")) != F.col("shard")).isEmpty()
    assert lies.select("shard").distinct().count() == lies.select("file").distinct().count()
