"""Writers: the change log, the name index, READMEs, packed objects and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustlake import schemas
from trustlake.operators.registry import as_changes, current_view
from trustlake.sources.scratch import saved


def append_changes(records: DataFrame, path: str, op: str = "put") -> None:
    """Append records, keys to delete, or a reset marker to the log at ``path``.

    Every file gets all columns of a change, so that readers need no footers to
    know the schema.
    """
    changes = as_changes(records, op)
    columns = [
        (F.col(f.name) if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in _change_schema().fields
    ]
    changes.select(*columns).write.mode("append").partitionBy("type").parquet(path)


def delete_artifacts(keys: DataFrame, path: str) -> DataFrame:
    """Append deletions of the keys (type, id, seq) that are stored in the log at
    ``path``; returns those that are not.
    """
    stored = read_current(keys.sparkSession, path).select("type", "id")
    missing = saved(keys.join(stored, ["type", "id"], "left_anti"), "missing")
    append_changes(keys.join(missing, ["type", "id"], "left_anti"), path, "delete")
    return missing


def _change_schema() -> StructType:
    return StructType.fromDDL(schemas.CHANGE)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return current_view(spark.read.schema(schemas.CHANGE).parquet(path))


def compact(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Write the current view as a new log at ``version`` and return it.

    The log that is read is left alone, so a failed run changes nothing.
    """
    append_changes(read_current(spark, path).sort("type", "id"), version)
    return read_current(spark, version)


def append_index(lines: DataFrame, path: str) -> None:
    """Append index lines (name, id, type) with their ``seq``, which alone orders
    them; nothing is rewritten or deduplicated.
    """
    columns = StructType.fromDDL(schemas.INDEX_LINE).fields
    lines.select(*[F.col(f.name).cast(f.dataType) for f in columns]).write.mode("append").parquet(path)


def store_readmes(readmes: DataFrame, path: str) -> None:
    """Append READMEs (type, id, path, text), one directory per type."""
    readmes.write.mode("append").partitionBy("type").parquet(path)


def pack_objects(objects: DataFrame, path: str) -> None:
    """Append stored objects (key, content), many to a file."""
    objects.select("key", "content").write.mode("append").parquet(path)


def pack_records(documents: DataFrame, path: str) -> None:
    """Append stored documents (value), many to a file."""
    documents.select("value").write.mode("append").option("lineSep", schemas.RECORD_END).text(path)
