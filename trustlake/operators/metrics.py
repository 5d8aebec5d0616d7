"""The ten trust metrics over tables of models and landed inputs.

Each metric is a Column over narrow facts. Facts are derived where their table
is scanned (``info_facts``, ``listing_facts``, ``text_facts``, ``page_links``),
so that texts and listings never travel through a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions import files as files_fn
from trustlake.functions import numeric as N
from trustlake.functions import text as T
from trustlake.functions import urls as U
from trustlake.operators import code, readmes, reviews, sizes
from trustlake.operators.joins import join_built, lookup_join
from trustlake.operators.scores import gate_failures, with_net_score
from trustlake.sources.facts import FactStore

KEY = ["type", "id"]


@dataclass(frozen=True)
class Landed:
    """Input tables of a rating run.

    models      type, id, name, model_url, code_url, dataset_url
    info        model_id, status_code, sha, downloads, likes, last_modified,
                tags, has_card, datasets
    siblings    model_id, ord, rfilename, content_length, content_range
    repo_files  repo, file, branch, status_code, text
    pages       model_id, html
    prs         repo, number, updated_at, merged_at   (closed PRs)
    reviews     repo, number
    pr_files    repo, number, filename, additions
    code_files  repo, ord, kind, name, status_code, text
    responses   type, id, body
    as_of       timestamp column that stands for "now"
    known       facts of texts that were judged before; ``learn`` brings them up to date
    """

    models: DataFrame
    info: DataFrame
    siblings: DataFrame
    repo_files: DataFrame
    pages: DataFrame
    prs: DataFrame
    reviews: DataFrame
    pr_files: DataFrame
    code_files: DataFrame
    responses: DataFrame
    as_of: Column
    strict_links: bool = False
    known: FactStore | None = None


def learn(landed: Landed) -> dict[str, int]:
    """Judge and parse what landed and is not in ``landed.known``; how many texts of each kind."""
    files, sources = readmes.usable_files(landed.repo_files), landed.code_files
    return {
        "texts": landed.known.learn(readmes.TEXTS, files, readmes.FILE_KEY),
        "sources": landed.known.learn(code.SOURCES, sources, code.FILE_KEY, code.scored_files(sources)),
    }


# --- facts -----------------------------------------------------------------------------


def with_model_id(models: DataFrame) -> DataFrame:
    return models.withColumn("model_id", U.model_id("model_url"))


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest row of each key: copies collapse on the map side."""
    rest = [c for c in df.columns if c not in keys]
    greatest = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row"))
    return greatest.select(*keys, "_row.*")


def info_facts(info: DataFrame, as_of: Column) -> DataFrame:
    """Facts from hub metadata; failed fetches leave no row."""
    facts = info.where(F.col("status_code") == 200).select(
        "model_id",
        F.lit(True).alias("has_info"),
        (F.coalesce("sha", F.lit("")) != "").alias("has_sha"),
        N.likes_score("likes").alias("likes_score"),
        F.coalesce("has_card", F.lit(False)).alias("has_card"),
        F.coalesce(files_fn.has_examples_tag("tags"), F.lit(False)).alias("has_examples"),
        N.popularity("downloads").alias("popularity"),
        N.freshness("last_modified", as_of).alias("freshness"),
        F.transform(F.coalesce("datasets", F.array().cast("array<string>")), F.lower).alias(
            "datasets"
        ),
    )
    return one_per_key(facts, ["model_id"])


def listing_facts(siblings: DataFrame) -> DataFrame:
    """Facts from file listings, one pass, combined on the map side."""
    name = F.lower("rfilename")
    files = sizes.with_weight_bytes(siblings).select("model_id", "weight_bytes", name.alias("_name"))
    return files.groupBy("model_id").agg(
        sizes.counted_bytes().alias("total_bytes"),
        F.max(F.col("_name") == "readme.md").alias("has_readme"),
        F.max(F.col("_name").endswith(".py")).alias("has_python"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    link = U.repo_link("html", html=True)
    links = pages.select(
        "model_id", F.concat_ws("/", link["owner"], link["repo"]).alias("page_repo")
    )
    return one_per_key(links, ["model_id"])


def with_review_repo(models: DataFrame) -> DataFrame:
    """Adds ``review_repo``: the code repository named by the model URL or, for
    hub models, by the model's page (``page_repo``).
    """
    link = U.repo_link("model_url")
    direct = F.when(link.isNotNull(), F.concat_ws("/", link["owner"], link["repo"]))
    by_page = F.when(F.col("model_url").contains(C.HUB_HOST), F.nullif("page_repo", F.lit("")))
    return models.withColumn("review_repo", F.coalesce(direct, by_page))


def code_repo(url: Column | str = "code_url") -> Column:
    repo = U.github_repo(url)
    return F.when(repo.isNotNull(), F.concat_ws("/", repo["owner"], repo["repo"]))


# --- scores as Columns over facts ------------------------------------------------------


def _url_shaped() -> Column:
    return U.is_url("model_id")


def ramp_up_score() -> Column:
    documented = F.coalesce("has_readme", F.lit(False)) | F.col("has_card")
    score = (
        F.when(documented, 1.0).otherwise(0.3) * 0.6
        + F.col("likes_score") * 0.4
        + F.when(F.col("has_examples"), 0.1).otherwise(0.0)
    )
    return F.when(F.col("has_info") & ~_url_shaped(), N.let(N.clamp01(score), N.round3))


def bus_factor_score() -> Column:
    score = N.let(F.col("popularity") * 0.6 + F.col("freshness") * 0.4, N.round3)
    return F.when(F.col("has_info") & ~_url_shaped(), score).otherwise(0.0)


def license_metric() -> Column:
    known = F.when(_url_shaped(), 0.0).otherwise(F.coalesce("license", F.lit(0.0)))
    return F.when(F.col("model_id").isNotNull(), known)


def performance_score() -> Column:
    fetchable = F.instr("model_id", "/") > 0
    return F.when(fetchable, F.coalesce("claims", F.lit(C.NO_FILES_SCORE))).otherwise(0.0)


def device_struct() -> Column:
    usable = F.col("has_info") & F.col("has_sha") & ~_url_shaped()
    return F.when(usable, files_fn.device_scores("total_bytes"))


def _present(link: Column, strict: bool) -> Column:
    """Links that were never extracted (null) count as present unless strict."""
    if strict:
        return ~F.coalesce(U.strip(link), F.lit("")).isin("", "NULL")
    return F.coalesce(link != "NULL", F.lit(True))


def dataset_and_code_value(strict: bool = False) -> Column:
    code_linked = _present(F.col("code_url"), strict)
    data_linked = _present(F.col("dataset_url"), strict)
    has_info = F.coalesce("has_info", F.lit(False))
    has_code = (
        code_linked
        | (has_info & F.coalesce("has_python", F.lit(False)))
        | F.coalesce("python_signal", F.lit(False))
    )
    has_data = data_linked | (has_info & F.coalesce(F.size("datasets") > 0, F.lit(False)))
    return (
        F.when(code_linked & data_linked, 1.0)
        .when(F.col("model_id").isNull() | _url_shaped(), 0.0)
        .otherwise(has_code.cast("double") * 0.5 + has_data.cast("double") * 0.5)
    )


def dataset_quality_value() -> Column:
    none = F.array().cast("array<string>")
    entries = F.filter(F.coalesce("datasets", none), lambda d: d != "")
    listed = F.array_intersect(F.array(*map(F.lit, C.TRUSTED_DATASETS)), entries)
    trusted = F.array_union("trusted", listed)
    described = (F.size(entries) > 0) | F.col("has_section")
    score = T.dataset_quality_score(trusted, "quality_hits", described)
    readable = ~F.coalesce("blank", F.lit(True))
    return F.when(F.col("model_id").isNotNull(), F.when(readable, score).otherwise(0.0))


def reproducibility_value(lenient: bool = False) -> Column:
    content = T.response_content("body")
    return F.when(content.isNotNull(), T.status_code(content, lenient))


# --- metric tables ---------------------------------------------------------------------


def result_rows(
    df: DataFrame, metric: str, score: Column, devices: Column | None = None, more: Sequence[str] = ()
) -> DataFrame:
    """Long result rows of one metric. Computed scores have no latency of their
    own: metrics are fused into shared stages.
    """
    device_map = sizes.as_map(devices) if devices is not None else F.lit(None)
    return df.select(
        *KEY,
        F.lit(metric).alias("metric"),
        score.cast("double").alias("score"),
        device_map.cast("map<string,double>").alias("device_scores"),
        F.lit(0).cast("long").alias("latency_ms"),
        *more,
    )


Facts = Callable[[Landed], DataFrame]


def _joined(landed: Landed, *facts: Facts) -> DataFrame:
    """Models with the given facts, one row per model.

    Facts are first brought together per distinct model id, where no key is hot.
    """

    def build(ids: DataFrame) -> DataFrame:
        tables = [fact(landed) for fact in facts]
        return reduce(lambda df, table: df.join(table, "model_id", "left"), tables, ids)

    return join_built(with_model_id(landed.models), ["model_id"], build)


def _info(landed: Landed) -> DataFrame:
    return info_facts(landed.info, landed.as_of)


def _listing(landed: Landed) -> DataFrame:
    return listing_facts(landed.siblings)


def _readmes(landed: Landed) -> DataFrame:
    return readmes.readme_facts(landed.repo_files, landed.known)


def _claims(landed: Landed) -> DataFrame:
    return readmes.claims(landed.repo_files, landed.known).toDF("model_id", "claims")


def _texts(landed: Landed) -> DataFrame:
    return readmes.text_facts(landed.repo_files, landed.known)


def _pages(landed: Landed) -> DataFrame:
    return page_links(landed.pages)


def ramp_up_time(landed: Landed) -> DataFrame:
    return result_rows(_joined(landed, _info, _listing), "ramp_up_time", ramp_up_score())


def bus_factor(landed: Landed) -> DataFrame:
    return result_rows(_joined(landed, _info), "bus_factor", bus_factor_score())


def license_score(landed: Landed) -> DataFrame:
    return result_rows(_joined(landed, _readmes), "license", license_metric())


def performance_claims(landed: Landed) -> DataFrame:
    return result_rows(_joined(landed, _claims), "performance_claims", performance_score())


def size_score(landed: Landed) -> DataFrame:
    facts = _joined(landed, _info, _listing)
    return result_rows(facts, "size_score", F.lit(None), device_struct())


def dataset_and_code_score(landed: Landed) -> DataFrame:
    facts = _joined(landed, _info, _listing, _readmes)
    score = dataset_and_code_value(landed.strict_links)
    return result_rows(facts, "dataset_and_code_score", score)


def dataset_quality(landed: Landed) -> DataFrame:
    facts = _joined(landed, _info, _readmes)
    return result_rows(facts, "dataset_quality", dataset_quality_value())


def _code_scores(landed: Landed, models: DataFrame) -> DataFrame:
    """Adds ``code_quality`` to models with a ``code_repo``."""

    scores = code.code_quality(landed.code_files, landed.known).toDF("code_repo", "code_quality")
    found = lookup_join(models, scores, ["code_repo"])
    return found.withColumn(
        "code_quality", F.coalesce("code_quality", F.lit(C.NO_CODE_SCORE))
    )


def code_quality(landed: Landed) -> DataFrame:
    models = landed.models.withColumn("code_repo", code_repo())
    return result_rows(_code_scores(landed, models), "code_quality", F.col("code_quality"))


def _review_scores(landed: Landed, models: DataFrame) -> DataFrame:
    """Adds ``reviewedness`` to models with a ``review_repo``."""

    scores = reviews.reviewedness(landed.prs, landed.reviews, landed.pr_files)
    found = lookup_join(models, scores.toDF("review_repo", "reviewedness"), ["review_repo"])
    return found.withColumn("reviewedness", F.coalesce("reviewedness", F.lit(-1.0)))


def reviewedness(landed: Landed) -> DataFrame:
    models = with_review_repo(_joined(landed, _pages))
    return result_rows(_review_scores(landed, models), "reviewedness", F.col("reviewedness"))


def _reproducibility(landed: Landed) -> DataFrame:
    """Scores of landed replies; their texts stay in the scan stage."""
    scored = landed.responses.select(*KEY, reproducibility_value().alias("reproducibility"))
    return one_per_key(scored, KEY)


def reproducibility(landed: Landed) -> DataFrame:
    facts = landed.models.join(_reproducibility(landed), KEY, "left")
    return result_rows(facts, "reproducibility", F.col("reproducibility"))


# --- registry of metrics ---------------------------------------------------------------

Metric = Callable[[Landed], DataFrame]


@dataclass(frozen=True)
class RowMetric:
    """A user's metric in Python: the scores of a batch of rows, one for each.

    ``rows`` has type and id and what ``score`` reads; the models by default. A batch
    that fails is tried again by halves, down to the rows that fail by themselves.
    Rows are dealt evenly to tasks, as their bytes say nothing of the time they take.
    """

    score: Callable[[pd.DataFrame], pd.Series]
    rows: Callable[[Landed], DataFrame] = lambda landed: landed.models


def _scored(score: Callable[[pd.DataFrame], pd.Series]) -> Callable:
    """Batches to type, id, score and error."""

    def attempt(batch: pd.DataFrame, fails: bool = False) -> tuple[list, list]:
        """``fails``: the batch is the rest of one that failed, without what did not."""
        try:
            if fails and len(batch) > 1:
                raise ValueError
            found = [None if x is None else float(x) for x in score(batch.reset_index(drop=True))]
            if len(found) != len(batch):
                raise ValueError(f"{len(found)} scores for {len(batch)} rows")
            return [None if x is None or math.isnan(x) else x for x in found], [None] * len(batch)
        except Exception as failure:
            if len(batch) == 1:
                return [None], [f"{type(failure).__name__}: {failure}"[:1000]]
        half = len(batch) // 2
        left = attempt(batch.iloc[:half])
        right = attempt(batch.iloc[half:], fails=not any(left[1]))
        return left[0] + right[0], left[1] + right[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores, errors = attempt(batch)
                yield pd.DataFrame({
                    "type": batch["type"].to_numpy(), "id": batch["id"].to_numpy(),
                    "score": pd.Series(scores, dtype="float64"), "error": pd.Series(errors, dtype=object),
                })

    return run


def row_results(landed: Landed, metric: str, built: RowMetric) -> DataFrame:
    """Long result rows of a metric in Python, with the error of each row that failed."""
    kinds = built.rows(landed).select(*KEY)
    schema = f"type string, id {kinds.schema['id'].dataType.simpleString()}, score double, error string"
    rows = built.rows(landed)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(tasks).mapInPandas(_scored(built.score), schema)
    return result_rows(found, metric, F.col("score"), more=["error"])


METRICS: dict[str, Metric] = {
    "ramp_up_time": ramp_up_time,
    "bus_factor": bus_factor,
    "license": license_score,
    "performance_claims": performance_claims,
    "size_score": size_score,
    "dataset_and_code_score": dataset_and_code_score,
    "dataset_quality": dataset_quality,
    "code_quality": code_quality,
    "reviewedness": reviewedness,
    "reproducibility": reproducibility,
}


def run_metrics(landed: Landed, metrics: Mapping[str, Metric | RowMetric] = METRICS) -> DataFrame:
    """Long results of any set of metrics, built-in or a user's own.

    A metric is a function from ``Landed`` to rows (type, id, score), or a
    ``RowMetric``. One that cannot be built yields missing scores and says why in
    ``error``; so does each row for which a ``RowMetric`` fails. For the built-in ten,
    ``rate`` computes the same in one pass.
    """

    def rows(metric: str, build: Metric | RowMetric) -> DataFrame:
        none = F.lit(None).cast("string")
        try:
            if isinstance(build, RowMetric):
                return row_results(landed, metric, build)
            result = build(landed)
            if "device_scores" not in result.columns:
                result = result_rows(result, metric, F.col("score"))
            return result.withColumn("error", none)
        except Exception as failure:  # every model misses this score
            error = F.lit(f"{type(failure).__name__}: {failure}"[:1000])
            return result_rows(landed.models, metric, F.lit(None)).withColumn("error", error)

    return reduce(DataFrame.unionByName, [rows(m, build) for m, build in metrics.items()])


def model_facts(landed: Landed) -> DataFrame:
    """Models with all facts keyed by ``model_id``."""
    return _joined(landed, _info, _listing, _texts, _pages)


# Columns of the models that a rating passes on: the order of registrations.
CARRIED = ("seq",)


def rate(landed: Landed) -> DataFrame:
    """All ten metrics, wide: one row per model, plus net score and admission.

    Every landed table is scanned once. The heavy scans end in narrow tables of
    facts; models meet them in lookup joins, and scores, net score and gate are
    Columns over the result.
    """
    models = with_review_repo(model_facts(landed)).select(
        *KEY,
        "name",
        "model_url",
        *[c for c in CARRIED if c in landed.models.columns],
        code_repo().alias("code_repo"),
        "review_repo",
        ramp_up_score().alias("ramp_up_time"),
        bus_factor_score().alias("bus_factor"),
        license_metric().alias("license"),
        performance_score().alias("performance_claims"),
        device_struct().alias("devices"),
        dataset_and_code_value(landed.strict_links).alias("dataset_and_code_score"),
        dataset_quality_value().alias("dataset_quality"),
    )
    scored = (
        _review_scores(landed, _code_scores(landed, models))
        .join(_reproducibility(landed), KEY, "left")
        .withColumn("size_score", files_fn.device_mean("devices"))
        .drop("code_repo", "review_repo")
    )
    columns = {m: F.col(m) for m in C.METRIC_WEIGHTS}
    return (
        with_net_score(scored, columns, C.METRIC_WEIGHTS)
        .withColumn("failures", gate_failures(columns, C.ADMISSION_THRESHOLD))
        .withColumn("admitted", F.size("failures") == 0)
    )


def long_results(wide: DataFrame) -> DataFrame:
    """Long result rows of a wide rating; expanded in place, without a shuffle."""
    no_devices = F.lit(None).cast("map<string,double>")
    entries = []
    for metric in METRICS:
        is_size = metric == "size_score"
        entries.append(
            F.struct(
                F.lit(metric).alias("metric"),
                (F.lit(None) if is_size else F.col(metric)).cast("double").alias("score"),
                (sizes.as_map(F.col("devices")) if is_size else no_devices).alias("device_scores"),
                F.lit(0).cast("long").alias("latency_ms"),
            )
        )
    return wide.select(*KEY, F.inline(F.array(*entries)))


def results_json(wide: DataFrame) -> DataFrame:
    """Wide rating with ``results``: the JSON text stored in a record."""

    def entry(metric: str) -> Column:
        if metric == "size_score":
            score = F.coalesce(F.to_json("devices"), F.lit("null"))
        else:
            score = F.coalesce(F.col(metric).cast("string"), F.lit("null"))
        return F.concat(F.lit(f'"{metric}": ['), score, F.lit(", 0]"))

    body = F.concat_ws(", ", *[entry(m) for m in METRICS])
    return wide.withColumn("results", F.concat(F.lit("{"), body, F.lit("}")))
