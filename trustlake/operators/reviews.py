"""Pull-request operators behind the reviewedness metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.files import has_extension
from trustlake.functions.numeric import round3

PR = ["repo", "number"]


def recent_prs(prs: DataFrame, limit: int = C.RECENT_PRS) -> DataFrame:
    """The most recently updated closed PRs of each repository.

    Filtering on the row number lets Spark drop all but ``limit`` rows per
    repository inside every map task (WindowGroupLimit), so a repository with a
    third of all PRs shuffles ``limit`` rows per task like any other.
    """
    latest = Window.partitionBy("repo").orderBy(F.desc("updated_at"), F.desc("number"))
    return (
        prs.withColumn("_rank", F.row_number().over(latest))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def merged_prs(prs: DataFrame) -> DataFrame:
    return prs.where(F.coalesce(F.col("merged_at").cast("string"), F.lit("")) != "")


def source_files(files: DataFrame) -> DataFrame:
    """Changed files without binary ones."""
    return files.where(~has_extension("filename", C.BINARY_EXTENSIONS))


def reviewed_prs(reviews: DataFrame) -> DataFrame:
    return reviews.select(*PR).distinct()


def with_review_flag(prs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each PR once, with ``reviewed``. Reviews shrink to distinct keys first."""
    flagged = reviewed_prs(reviews).withColumn("reviewed", F.lit(True))
    return prs.join(flagged, PR, "left").withColumn(
        "reviewed", F.coalesce("reviewed", F.lit(False))
    )


def pr_file_changes(prs: DataFrame, files: DataFrame) -> DataFrame:
    """Changed files of the given PRs. A PR with very many files is a hot key."""
    return files.join(prs.select(*PR), PR, "left_semi").select(*files.columns)


def pr_additions(files: DataFrame) -> DataFrame:
    """Added source lines per PR. Sums combine on the map side, so one PR with
    very many files is no hot key in the joins that follow.
    """
    return source_files(files).groupBy(*PR).agg(F.sum("additions").alias("additions"))


def reviewedness(prs: DataFrame, reviews: DataFrame, files: DataFrame) -> DataFrame:
    """Share of recently merged lines that were reviewed, per repository.

    ``prs`` holds closed PRs. A repository with closed PRs but no counted lines
    scores 0; one without any row in ``prs`` is unknown and absent here.

    PRs are ranked once and cut to at most 30 per repository. Files of no merged one
    among them go before anything is summed, as Spark puts the join first. Reviews
    shrink to one row per PR where they are scanned; those of other PRs find no line.
    """
    merged = merged_prs(recent_prs(prs)).select(*PR)
    additions = pr_file_changes(merged, pr_additions(files))
    lines = with_review_flag(additions, reviews)
    sums = lines.groupBy("repo").agg(
        F.sum("additions").alias("total"),
        F.sum(F.when(F.col("reviewed"), F.col("additions"))).alias("reviewed"),
    )
    return (
        prs.select("repo").distinct().join(sums, "repo", "left")
        .select(
            "repo",
            F.when(F.col("total") > 0, F.coalesce("reviewed", F.lit(0)) / F.col("total"))
            .otherwise(0.0)
            .alias("share"),
        )
        .select("repo", round3("share").alias("score"))
    )
