"""URL and repository-reference Column builders.

The authority and the path of a URL are cut out with regular expressions
instead of ``parse_url``: references that are not URLs at all (``owner/name``)
then simply have an empty authority.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.numeric import col, let

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(C.WHITESPACE))


def authority(url: Column | str) -> Column:
    return F.regexp_extract(col(url), AUTHORITY, 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), PATH, 1)


def path_segments(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda part: part != "")


def model_id(url: Column | str) -> Column:
    """Normalise a hub reference to ``owner/name`` or ``name``.

    References to other hosts, to hub data sets and to the hub's root come back
    unchanged; a hub URL with no repository before ``tree``, ``blob`` and so on
    has no id (null).
    """
    kept_out = f"/(?:{'|'.join(C.NON_REPO_SEGMENTS)})/.*$"

    def hub_id(ref: Column, segments: Column) -> Column:
        # Leading and trailing "/" let one pattern cut at the first non-repo segment.
        slashed = F.concat(F.lit("/"), F.array_join(segments, "/"), F.lit("/"))
        repo_path = F.regexp_replace(slashed, kept_out, "/")
        repo = F.regexp_extract(repo_path, "^/([^/]+(?:/[^/]+)?)", 1)
        whole = (F.size(segments) == 0) | (F.try_element_at(segments, F.lit(1)) == "datasets")
        return F.when(whole, ref).otherwise(F.when(repo != "", repo))

    def reference_id(ref: Column) -> Column:
        return (
            F.when(ref.startswith("hf://"), F.substring_index(F.substr(ref, F.lit(6)), "/", 2))
            .when(~ref.startswith("http"), ref)
            .when(~authority(ref).endswith(C.HUB_HOST), ref)
            .otherwise(let(path_segments(ref), lambda segments: hub_id(ref, segments)))
        )

    return let(strip(url), reference_id)


def is_url(reference: Column | str) -> Column:
    return col(reference).startswith("http")


def detect_source(url: Column | str) -> Column:
    """``huggingface`` or ``github`` by substring; null for anything else."""
    value = col(url)
    return F.when(value.contains(C.HUB_HOST), "huggingface").when(
        value.contains(C.CODE_HOST), "github"
    )


def repo_type(url: Column | str) -> Column:
    """Struct (repo_type, repo_id) of a hub URL."""
    trimmed = F.btrim(path(url), F.lit("/"))
    parts = F.split(trimmed, "/")
    is_dataset = F.element_at(parts, 1) == "datasets"
    return F.struct(
        F.when(is_dataset, "dataset").otherwise("model").alias("repo_type"),
        F.when(is_dataset, F.array_join(F.slice(parts, 2, 2), "/"))
        .otherwise(F.array_join(F.slice(parts, 1, 2), "/"))
        .alias("repo_id"),
    )


def github_repo(url: Column | str) -> Column:
    """Struct (owner, repo) of a code-host URL, one ``.git`` suffix removed.

    Null when the host is another one or the path has fewer than two segments.
    """
    segments = path_segments(url)
    repo = F.regexp_replace(F.try_element_at(segments, F.lit(2)), r"\.git\z", "")
    usable = authority(url).contains(C.CODE_HOST) & (F.size(segments) >= 2) & (repo != "")
    return F.when(
        usable,
        F.struct(
            F.try_element_at(segments, F.lit(1)).alias("owner"),
            repo.alias("repo"),
        ),
    )


def archive_repo(url: Column | str) -> Column:
    """Struct (owner, repo) as the archive downloader reads it: URL prefix only."""
    pattern = r"^https?://github\.com/([^/]+)/([^/]+)"
    return F.when(
        col(url).rlike(pattern),
        F.struct(
            F.regexp_extract(col(url), pattern, 1).alias("owner"),
            F.regexp_extract(col(url), pattern, 2).alias("repo"),
        ),
    )


def repo_link(text: Column | str, html: bool = False, strip_git: bool = False) -> Column:
    """Struct (owner, repo) of the first code-host link in a text, else null.

    In HTML a link with an explicit scheme wins over an earlier bare one.
    """
    value = col(text)

    def first(pattern: str) -> Column:
        repo = F.regexp_extract(value, pattern, 2)
        if strip_git:
            repo = F.regexp_replace(repo, r"\.git\z", "")
        return F.when(
            value.rlike(pattern),
            F.struct(F.regexp_extract(value, pattern, 1).alias("owner"), repo.alias("repo")),
        )

    bare = first(C.REPO_LINK)
    return F.coalesce(first("https?://" + C.REPO_LINK), bare) if html else bare


def raw_file_url(model: Column | str, branch: Column | str, file: Column | str) -> Column:
    return F.concat(
        F.lit(f"https://{C.HUB_HOST}/"), col(model), F.lit("/raw/"), col(branch), F.lit("/"), col(file)
    )


def archive_url(owner: Column | str, repo: Column | str, branch: Column | str) -> Column:
    return F.concat(
        F.lit(f"https://{C.CODE_HOST}/"), col(owner), F.lit("/"), col(repo),
        F.lit("/archive/refs/heads/"), col(branch), F.lit(".zip"),
    )


def hub_api_url(kind: Column | str, repo_id: Column | str) -> Column:
    """``kind`` is ``model`` or ``dataset``."""
    return F.concat(F.lit(f"https://{C.HUB_HOST}/api/"), col(kind), F.lit("s/"), col(repo_id))


def link_pair(text: Column | str) -> Column:
    """Struct (code_url, dataset_url) of ``"code, dataset"``; not trimmed.

    Fewer than two parts leave both empty.
    """
    parts = F.split(col(text), ",")
    enough = F.size(parts) >= 2
    return F.struct(
        F.when(enough, F.try_element_at(parts, F.lit(1))).alias("code_url"),
        F.when(enough, F.try_element_at(parts, F.lit(2))).alias("dataset_url"),
    )
