"""Repository texts: branch and file choice, README selection, README facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions import text as T
from trustlake.functions.files import first_named
from trustlake.functions.numeric import let
from trustlake.functions.urls import authority, path_segments, strip
from trustlake.sources.facts import FactStore, Kind, digest


def rank_in(column: str, order: Sequence[str]) -> Column:
    """Position of a value in a list; null when it is not listed."""
    return F.nullif(
        F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0)
    )


def fetched(files: DataFrame) -> DataFrame:
    return files.where((F.col("status_code") == 200) & (F.length("text") > 0))


def pick_branch_text(files: DataFrame, candidates: Sequence[str] = C.REPO_FILES) -> DataFrame:
    """Text of each candidate file, from branch ``main``, else ``master``.

    Texts found on ``main`` pass straight through. Only the ``master`` texts are
    shuffled, against the bare keys of the ``main`` ones.
    """
    main, master = C.BRANCHES
    usable = fetched(files).where(F.col("file").isin(list(candidates)))
    first = usable.where(F.col("branch") == main)
    second = usable.where(F.col("branch") == master)
    fallback = second.join(first.select("repo", "file"), ["repo", "file"], "left_anti")
    return first.unionByName(fallback).select("repo", "file", "text")


def candidate_texts(
    repos: DataFrame, files: DataFrame, candidates: Sequence[str] = C.REPO_FILES
) -> DataFrame:
    """One row per repository and candidate; files not found read as ''."""
    wanted = repos.select("repo").withColumn(
        "file", F.explode(F.array(*map(F.lit, candidates)))
    )
    return wanted.join(
        pick_branch_text(files, candidates), ["repo", "file"], "left"
    ).withColumn("text", F.coalesce("text", F.lit("")))


def landed_readme(ids: DataFrame, files: DataFrame) -> DataFrame:
    """README text by model id, branch ``main`` only; '' whenever there is none,
    which includes ids that are not ``owner/repo``.
    """
    texts = fetched(files).where(
        (F.col("file") == "README.md") & (F.col("branch") == C.BRANCHES[0])
    ).select(F.col("repo").alias("model_id"), "text")
    return (
        ids.select("model_id")
        .join(texts, "model_id", "left")
        .withColumn(
            "text",
            F.when(F.instr("model_id", "/") == 0, "").otherwise(F.coalesce("text", F.lit(""))),
        )
    )


def first_nonblank(
    texts: DataFrame, priority: Sequence[str] = C.CLAIM_FILES, value: str = "text"
) -> DataFrame:
    """The first file, by priority, whose text is not blank."""
    ranked = texts.withColumn("_rank", rank_in("file", priority)).where(
        F.col("_rank").isNotNull() & (strip("text") != "")
    )
    return ranked.groupBy("repo").agg(
        F.min_by("file", "_rank").alias("file"), F.min_by(value, "_rank").alias(value)
    )


README_FACTS = (
    "blank", "license", "python_signal", "trusted", "quality_hits", "has_section",
)


def _with_scope(files: DataFrame) -> DataFrame:
    """Adds the data section and the lower-case text to search for data sets."""
    scope = F.lower(F.when(F.col("section") != "", F.col("section")).otherwise(F.col("text")))
    return files.withColumn("section", T.dataset_section("text")).withColumn("scope", scope)


def _readme_columns() -> dict[str, Column]:
    return {
        "blank": strip("text") == "",
        "license": T.license_score("text"),
        "python_signal": T.has_python_signal("text"),
        "trusted": T.words_found("scope", C.TRUSTED_DATASETS),
        "quality_hits": T.quality_hits("scope"),
        "has_section": F.col("section") != "",
    }


def judge_texts(files: DataFrame) -> DataFrame:
    """Adds the facts of each text (``TEXT_FACTS``)."""
    facts = _with_scope(files).withColumns(_readme_columns() | {"claims": T.has_claims("text")})
    return facts.drop("section", "scope")


# The facts of any text, wherever it lies (see ``sources.facts``).
TEXTS = Kind(
    "texts",
    "blank boolean, license double, python_signal boolean, trusted array<string>, "
    "quality_hits int, has_section boolean, claims boolean",
    judge_texts,
)
FILE_KEY = ("repo", "file", "branch")


def usable_files(files: DataFrame) -> DataFrame:
    return fetched(files).where(F.col("file").isin(list(C.REPO_FILES)))


def text_facts(files: DataFrame, known: FactStore | None = None) -> DataFrame:
    """All that the metrics need to know about texts, without the texts: one row
    per repository with the facts of its README (branch ``main``) and ``claims``.

    Each text is read and judged once, in the scan stage; or, with a store that
    has learned the files, only its digest is taken there. One narrow row per file
    is then combined per repository, on the map side first, so copies of a file
    cost nothing further. Columns that a caller drops are not computed.
    """
    is_readme = (F.col("file") == "README.md") & (F.col("branch") == C.BRANCHES[0])
    own_readme = is_readme & (F.instr("repo", "/") > 0)
    usable = usable_files(files)
    if known is None:
        facts, source = _readme_columns(), _with_scope(usable)
        blank, has_claims = strip("text") == "", T.has_claims("text")
    else:
        marked = usable.select(*FILE_KEY, digest().alias("digest"))
        source = known.facts(TEXTS, marked, "repo")
        facts = {name: F.col(name) for name in README_FACTS}
        blank, has_claims = F.col("blank"), F.col("claims")
    judged = source.select(
        F.col("repo").alias("model_id"),
        "file",
        rank_in("branch", C.BRANCHES).alias("branch_rank"),
        *[F.when(own_readme, fact).alias(name) for name, fact in facts.items()],
        F.when(
            F.col("file").isin(list(C.CLAIM_FILES)),
            F.struct(blank.alias("blank"), has_claims.alias("claims")),
        ).alias("judged"),
    )
    picks = [
        F.min_by(F.when(F.col("file") == f, F.col("judged")),
                 F.when(F.col("file") == f, F.col("branch_rank"))).alias(f"_pick{i}")
        for i, f in enumerate(C.CLAIM_FILES)
    ]
    combined = judged.groupBy("model_id").agg(
        *[F.max(name).alias(name) for name in README_FACTS], *picks
    )
    first = F.coalesce(
        *[
            F.when(~F.col(f"_pick{i}.blank"), F.col(f"_pick{i}.claims"))
            for i in range(len(C.CLAIM_FILES))
        ]
    )
    return combined.select(
        "model_id",
        *README_FACTS,
        first.cast("double").alias("claims"),
    )


def readme_facts(files: DataFrame, known: FactStore | None = None) -> DataFrame:
    """Facts of the READMEs alone, for repositories that have one."""
    return text_facts(files, known).select("model_id", *README_FACTS).where("blank is not null")


def claims(files: DataFrame, known: FactStore | None = None) -> DataFrame:
    """(repo, score): does the first non-blank file state measured results?"""
    scores = text_facts(files, known).select(
        F.col("model_id").alias("repo"), F.col("claims").alias("score")
    )
    return scores.where("score is not null")


def chosen_readme(on_code_host: Column, on_hub: Column) -> tuple[Column, Column]:
    """Name and text of the README that a landed reply leads to; null where there is none.

    Hub repositories: the first sibling whose name contains ``readme``. Code
    hosts: the decoded base64 ``content``, under its own name. A reply that cannot
    be decoded has none.
    """
    decoded = F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64"))
    name = F.when(on_code_host, F.coalesce("readme_name", F.lit("README"))).when(
        on_hub, first_named("siblings", "readme")
    )
    text = F.when(on_code_host, F.try_validate_utf8(decoded.cast("string"))).otherwise(F.col("text"))
    return name, text


def stored_readme(landed: DataFrame) -> DataFrame:
    """Which README is stored for a registered artifact. A reply that failed stores nothing."""
    host = F.col("host")
    name, text = chosen_readme(host.contains(C.CODE_HOST), host.contains(C.HUB_HOST))
    return landed.where(F.col("status_code") == 200).select(
        "type", "id", name.alias("path"), text.alias("text")
    ).where("path is not null and text is not null")


def readme_key(url: Column | str) -> Column:
    """The repository whose README belongs to an artifact: host and path, without
    ``.git`` on code hosts. Null for other hosts and for what is no URL.
    """

    def key(host: Column, parts: Column) -> Column:
        def at(number: int) -> Column:
            return F.try_element_at(parts, F.lit(number))

        code = F.concat_ws("/", F.lit(C.CODE_HOST), at(1), F.replace(at(2), F.lit(".git"), F.lit("")))
        length = F.when(at(1) == "datasets", 3).otherwise(2)
        hub = F.concat_ws("/", F.lit(C.HUB_HOST), F.array_join(F.slice(parts, F.lit(1), length), "/"))
        return F.when(host.contains(C.CODE_HOST), F.when(F.size(parts) > 1, code)).when(
            host.contains(C.HUB_HOST) & (F.size(parts) > 0), hub
        )

    host = F.lower(authority(url))
    return let(host, lambda h: let(path_segments(url), lambda parts: key(h, parts)))


def registered_readmes(records: DataFrame, replies: DataFrame) -> DataFrame:
    """The README of each registered record of any type that has one, under the
    name that its host gives it.

    ``records`` has type, id, model_url and place, ``replies`` one row per ``key``.
    The README is chosen where replies are scanned.
    """
    is_code = F.col("key").startswith(C.CODE_HOST)
    name, text = chosen_readme(is_code, ~is_code)
    found = replies.where(F.col("status_code") == 200).select("key", name.alias("name"), text.alias("text"))
    wanted = records.select("type", "id", "place", readme_key("model_url").alias("key"))
    rows = wanted.where("key is not null").join(found.where("name is not null and text is not null"), "key")
    path = F.concat_ws("/", F.lit("artifacts"), "type", "id", "name")
    return rows.select("type", "id", "place", path.alias("path"), "text")

