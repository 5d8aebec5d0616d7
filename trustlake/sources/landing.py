"""Readers: landed files to the tables that the operators work on."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake import schemas
from trustlake.functions.urls import strip
from trustlake.operators.health import between


def read_registry(
    spark: SparkSession, root: str, tree: bool = True, name: str = "metadata.json"
) -> DataFrame:
    """Stored records; unreadable documents are skipped, missing fields are null.

    ``tree``: one ``<type>/<id>/<name>`` per artifact, as archived; the driver lists
    every file. Otherwise any number of files as ``sinks.pack_records`` writes them,
    whose documents may have several lines.
    """
    reader = (
        spark.read.schema(schemas.RECORD + ", _corrupt string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
    )
    if tree:
        reader = (
            reader.option("multiLine", True)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", name)
        )
    else:
        reader = reader.option("lineSep", schemas.RECORD_END)
    return reader.json(root).where(F.col("_corrupt").isNull()).drop("_corrupt")


def parse_name_index(lines: DataFrame) -> DataFrame:
    """``name,id,type`` lines in column ``value``. There is no quoting: a line
    counts only if it has exactly two commas.
    """
    parts = F.split(strip("value"), ",")
    rest = [c for c in lines.columns if c != "value"]
    return (
        lines.select(parts.alias("p"), *rest)
        .where(F.size("p") == 3)
        .select(
            strip(F.col("p")[0]).alias("name"),
            strip(F.col("p")[1]).alias("id"),
            strip(F.col("p")[2]).alias("type"),
            *rest,
        )
    )


# The name that all parts of one append share.
APPEND = r"/part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^/]*\z"


def read_name_index(spark: SparkSession, path: str) -> DataFrame:
    """Index lines of raw text files with ``seq``, their order of appending: the time
    of the append, then its parts by name, then the place in the file. Files may be
    read in any order, and parts of one append may be written in any.

    An append is as old as its oldest file; other files are appends of their own.
    """
    name = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(
        "value",
        F.coalesce(F.nullif(F.regexp_extract(name, APPEND, 1), F.lit("")), name).alias("_append"),
        F.col("_metadata.file_modification_time").alias("_time"),
        name.alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    # A row for each append.
    begun = lines.groupBy("_append").agg(F.min("_time").alias("_begun"))
    seq = F.struct(
        F.col("_begun").alias("time"), F.col("_append").alias("append"), F.col("_path").alias("path"),
        F.col("_block").alias("block"), F.col("_line").alias("line"),
    )
    return parse_name_index(lines.join(begun, "_append").select("value", seq.alias("seq")))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index lines of the table written by ``sinks.append_index``."""
    return spark.read.schema(schemas.INDEX_LINE).parquet(path)


def read_readme_tree(spark: SparkSession, root: str) -> DataFrame:
    """README blobs ``artifacts/<type>/<id>/…/README.md``; the name is matched
    exactly, and files that are not UTF-8 are skipped.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "README.md")
        .load(root)
    )
    key = r"/artifacts/([^/]+)/([^/]+)/(?:.*/)?README\.md\z"
    return (
        files.select("path", F.col("content").cast("string").alias("text"))
        .where(F.is_valid_utf8("text"))
        .select(
            F.regexp_extract("path", key, 1).alias("type"),
            F.regexp_extract("path", key, 2).alias("id"),
            "path",
            "text",
        )
    )


def read_readmes(spark: SparkSession, root: str) -> DataFrame:
    """READMEs from the table written by ``sinks.store_readmes``."""
    return spark.read.schema(schemas.README).parquet(root).where(
        F.col("path").endswith("/README.md") | (F.col("path") == "README.md")
    )


def parse_model_info(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(info, siblings) from hub replies of schema ``HUB_REPLY``."""
    card = F.col("cardData")
    empty_card = F.coalesce(F.trim(card), F.lit("")).isin("", "null", "{}", "[]", "false", '""')
    info = replies.select(
        "model_id",
        "status_code",
        "sha",
        "downloads",
        "likes",
        F.col("lastModified").alias("last_modified"),
        "tags",
        (~empty_card).alias("has_card"),
        F.from_json(F.get_json_object(card, "$.datasets"), "array<string>").alias("datasets"),
    )
    siblings = (
        replies.where(F.col("status_code") == 200)
        .select("model_id", F.posexplode("siblings").alias("ord", "f"))
        .select("model_id", F.col("ord").cast("long").alias("ord"), "f.*")
    )
    return info, siblings


def read_model_info(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_model_info(spark.read.schema(schemas.HUB_REPLY).json(path))


def read_pr_activity(
    spark: SparkSession, prs: str, reviews: str, files: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prs, reviews, pr_files); failed requests contribute no rows."""

    def replies(path: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).json(path).where(F.col("status_code") == 200)

    return (
        replies(prs, schemas.PR_REPLY).select("repo", F.inline("prs")),
        replies(reviews, schemas.REVIEW_REPLY)
        .select("repo", "number", F.explode("reviews").alias("r"))
        .select("repo", "number", F.col("r.id").alias("review_id")),
        replies(files, schemas.FILE_REPLY).select("repo", "number", F.inline("files")),
    )


def read_code_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of root listings, in listing order, with landed text. A listing
    that failed leaves no row; an empty one leaves one row without a file.
    """
    listings = spark.read.schema(schemas.CODE_LISTING).json(path)
    return (
        listings.where(F.col("status_code") == 200)
        .select("repo", F.posexplode_outer("entries").alias("ord", "e"))
        .select(
            "repo",
            "ord",
            F.col("e.type").alias("kind"),
            F.col("e.name").alias("name"),
            F.col("e.path").alias("path"),
            F.col("e.status_code").alias("status_code"),
            F.col("e.text").alias("text"),
        )
    )


def read_logs(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Log lines of some groups in a closed time range; both predicates are
    pushed to the scan.
    """
    logs = between(spark.read.parquet(path), start, end)
    return logs if groups is None else logs.where(F.col("log_group").isin(list(groups)))


def read_api_requests(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    return between(spark.read.parquet(path), start, end).select("ts", "latency_ms")


def read_object_sizes(
    spark: SparkSession, root: str, name: str = "artifact.zip", tree: bool = True
) -> DataFrame:
    """(type, id, length) of stored archives.

    ``tree``: a file per archive, whose name is a glob. Only the file status is read:
    the content column is pruned. The driver lists every file. Otherwise archives by
    key, packed by ``sinks.pack_objects``, any number in a file.
    """
    key = r"(?:^|/)(?:type=)?([^/=]+)/(?:id=)?([^/=]+)/[^/]+\z"
    if tree:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        archives = files.option("pathGlobFilter", name).load(root)
    else:
        packed = spark.read.schema(schemas.OBJECT).parquet(root)
        archives = packed.where(F.substring_index("key", "/", -1) == name).select(
            F.col("key").alias("path"), F.octet_length("content").cast("long").alias("length")
        )
    return archives.select(
        F.regexp_extract("path", key, 1).alias("type"),
        F.regexp_extract("path", key, 2).cast("long").alias("id"),
        "length",
    )
