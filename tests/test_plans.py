"""The physical plans that the operators count on."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from trustlake.functions import text as T
from trustlake.functions.ids import artifact_id
from trustlake.operators import code, health, listing, metrics, reviews, sizes
from trustlake.plans import flows
from trustlake.plans import tables as t
from trustlake.sources import landing
from trustlake.sources.scratch import saved

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_inside_map_tasks(spark):
    logs, prs = t.logs(spark, SF), t.prs(spark, SF)
    files = code.python_files(t.code_files(spark, SF))
    for df, k in (
        (health.recent_errors(logs), 20),
        (reviews.recent_prs(prs), 30),
        (code.first_readable(files), 7),
    ):
        assert re.search(rf"WindowGroupLimit .*row_number\(\), {k}, Partial", plan(df))


def test_log_predicates_reach_the_scan(spark):
    stored = saved(t.logs(spark, SF), "logs").inputFiles()[0].rsplit("/", 1)[0]
    start, end = datetime(2024, 1, 3), datetime(2024, 1, 4)
    logs = landing.read_logs(spark, stored, start, end, ["g1", "g2"]).select("message")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: (\S+)", plan(logs))
    for part in ("GreaterThanOrEqual(ts", "LessThanOrEqual(ts", "In(log_group"):
        assert part in pushed[1]
    assert "event_id" not in pushed[2]


def test_name_lookup_is_a_pushed_constant(spark):
    stored = saved(t.artifacts(spark, SF), "artifacts")
    found = listing.listing(listing.lookup_by_name(stored, "x", ["model"]))
    key = spark.range(1).select(artifact_id(F.lit("x"))).first()[0]
    assert f"EqualTo(id,{key})" in plan(found)
    assert "results" not in re.search(r"ReadSchema: (\S+)", plan(found))[1]


def test_pages_are_top_k(spark):
    page = flows.list_artifacts(saved(t.artifacts(spark, SF), "artifacts"), [("*", [])], 100)
    assert "TakeOrderedAndProject(limit=151, offset=100" in plan(page)


def test_sums_combine_before_the_shuffle(spark):
    siblings = saved(t.siblings(spark, SF), "siblings")
    files = saved(t.pr_files(spark, SF), "files")
    for df in (
        sizes.total_weight(siblings),
        metrics.listing_facts(siblings),
        reviews.pr_additions(files),
        health.log_counts(t.logs(spark, SF), t.LOG_GROUPS),
    ):
        assert "partial_" in plan(df).split("Exchange", 1)[1]


def test_texts_are_not_shuffled_by_the_metrics(spark):
    """Between the landed files and the joins only narrow facts travel."""
    files = saved(t.repo_files(spark, SF), "files")
    facts = metrics.readmes.text_facts(files)
    exchange = re.search(r"Exchange hashpartitioning\(model_id.*\n\s*\+- (.*)", plan(facts))
    assert "Aggregate" in exchange[1]
    output = exchange[1].split("output=")[-1]
    assert "text#" not in output


def test_no_cross_joins(spark):
    wide = metrics.rate(t.landed(spark, SF))
    report = flows.health_report(
        t.logs(spark, SF), t.api_requests(spark, SF), t.LOG_GROUPS, t.HEALTH_AS_OF
    )
    for df in (wide, report):
        assert "CartesianProduct" not in plan(df) and "NestedLoopJoin" not in plan(df)


def test_prs_are_ranked_once_and_reviews_combine_before_the_shuffle(spark):
    tables = (t.prs(spark, SF), saved(t.pr_reviews(spark, SF), "reviews"), t.pr_files(spark, SF))
    scores = plan(reviews.reviewedness(*tables))
    assert scores.count("+- Window [") == 1
    assert len(re.findall(r"Join .*LeftSemi", scores)) == 1


def test_listings_are_read_by_generated_code(spark):
    """No lambda, which would be interpreted for each of the files."""
    facts = plan(metrics.listing_facts(saved(t.siblings(spark, SF), "siblings")))
    assert "lambda" not in facts and "weight_bytes" in facts


def test_license_words_are_found_without_a_rewritten_text(spark):
    rows = spark.createDataFrame([("mit",)], "text string")
    assert "regexp_replace" not in plan(rows.select(T.license_score("text")))
