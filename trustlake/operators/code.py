"""Static analysis of landed Python files and the code-quality metric."""

from __future__ import annotations

import ast
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.sources.facts import FactStore, Kind, digest

FACTS_SCHEMA = (
    "valid boolean, functions int, undocumented int, long_functions int, complexity double, "
    "globals int, risky int, imports array<string>, names array<string>, long_lines int"
)


def _fact_reader(risky_calls: tuple[str, ...], columns: list[str]):
    """The pandas function behind ``code_facts``. It is built in a closure, so
    that it is shipped to the executors by value.
    """
    branching = (ast.If, ast.For, ast.While, ast.Try, ast.BoolOp)

    def facts(source: str) -> dict:
        """Counts read off the syntax tree of one file."""
        out = dict(
            valid=False, functions=0, undocumented=0, long_functions=0, complexity=0.0,
            globals=0, risky=0, imports=[], names=[],
            long_lines=sum(len(line) > 120 for line in source.splitlines()),
        )
        try:
            nodes = list(ast.walk(ast.parse(source)))
        except SyntaxError:
            return out
        imports, names = set(), set()
        for node in nodes:
            if isinstance(node, ast.FunctionDef):
                undocumented = ast.get_docstring(node) is None
                size = len(node.body)
                out["functions"] += 1
                out["undocumented"] += undocumented
                out["long_functions"] += size > 50
                # Branches are counted once per enclosing function.
                out["complexity"] += (
                    undocumented
                    + (math.log(size) if size > 50 else 0)
                    + sum(isinstance(inner, branching) for inner in ast.walk(node))
                )
            elif isinstance(node, ast.Global):
                out["globals"] += len(node.names)
            elif isinstance(node, ast.Call):
                out["risky"] += getattr(node.func, "id", None) in risky_calls
            elif isinstance(node, ast.Import):
                imports.update(alias.asname or alias.name for alias in node.names)
            elif isinstance(node, ast.ImportFrom) and node.module:
                imports.add(node.module)
            elif isinstance(node, ast.Name):
                names.add(node.id)
        return out | dict(valid=True, imports=sorted(imports), names=sorted(names))

    def read(sources: pd.Series) -> pd.DataFrame:
        rows = []
        for source in sources:
            try:
                rows.append(facts(source))
            except Exception:  # not analysable, for example nested too deeply
                rows.append(dict.fromkeys(columns))
        return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in columns})

    return read


def code_facts(source: Column | str) -> Column:
    """Struct of syntax-tree counts per file; only parsing needs Python. Files
    that cannot be analysed have null facts.
    """
    names = [field.split()[0] for field in FACTS_SCHEMA.split(", ")]
    return F.pandas_udf(_fact_reader(C.RISKY_CALLS, names), FACTS_SCHEMA)(source)


def unused_imports(facts: Column) -> Column:
    return F.array_except(facts["imports"], facts["names"])


def code_score(facts: Column) -> Column:
    """Quality in [0, 1]: 0 for a syntax error, 0.5 where analysis failed."""

    def penalty(limit: float, count: Column, weight: float) -> Column:
        return F.least(F.lit(limit), count * F.lit(weight))

    undocumented = F.when(
        facts["functions"] > 0, facts["undocumented"] / facts["functions"] * 3.0
    ).otherwise(0.0)
    score = (
        F.lit(10.0)
        - undocumented
        - facts["long_functions"] * 0.5
        - penalty(4.0, facts["complexity"], 0.1)
        # Five points of risk for each call, half a point of score for each.
        - facts["risky"] * 5 * 0.5
        - penalty(2.0, F.size(unused_imports(facts)), 0.25)
        - penalty(1.0, facts["long_lines"], 0.05)
        - penalty(1.0, facts["globals"], 0.1)
    )
    return (
        F.when(facts["valid"].isNull(), C.NO_CODE_SCORE)
        .when(~facts["valid"], 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)) / 10.0)
    )


def python_files(files: DataFrame) -> DataFrame:
    return files.where((F.col("kind") == "file") & F.col("name").endswith(".py"))


def first_readable(files: DataFrame, limit: int = C.MAX_CODE_FILES) -> DataFrame:
    """The first readable files of each repository in listing order.

    Files that could not be read do not count. The row-number filter is applied
    inside each map task first, so a huge repository ships few texts.
    """
    listed = Window.partitionBy("repo").orderBy("ord")
    return (
        files.where(F.col("status_code") == 200)
        .withColumn("_rank", F.row_number().over(listed))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def analyzed(files: DataFrame) -> DataFrame:
    return files.withColumn("facts", code_facts("text")).drop("text")


# The facts of any Python source, wherever it lies (see ``sources.facts``).
SOURCES = Kind("sources", f"facts struct<{FACTS_SCHEMA.replace(' ', ':').replace(',:', ', ')}>",
               lambda files: files.withColumn("facts", code_facts("text")))
FILE_KEY = ("repo", "ord")


def scored_files(files: DataFrame) -> DataFrame:
    """The files that a score looks at, as (repo, ord, digest); only these travel."""
    narrow = python_files(files).select("repo", "ord", "status_code", digest().alias("digest"))
    return first_readable(narrow).select("repo", "ord", "digest")


def code_quality(files: DataFrame, known: FactStore | None = None) -> DataFrame:
    """(repo, score) from a listing with the landed text of its Python files.

    0.5 for a listing without Python files; 0 where there are some but none
    could be read. The mean is taken over at most seven files, added up in
    listing order. Repositories that were not listed have no row here. With a store
    that has learned the files, none is parsed here.
    """
    if known is None:
        parsed = analyzed(first_readable(python_files(files)).select("repo", "ord", "text"))
    else:
        parsed = known.facts(SOURCES, scored_files(files), "repo")
    per_repo = (
        parsed.withColumn("score", code_score(F.col("facts")))
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "score"))).alias("scores"))
    )
    total = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + s["score"])
    is_python = (F.col("kind") == "file") & F.col("name").endswith(".py")
    listings = files.groupBy("repo").agg(F.max(is_python).alias("has_python"))
    return listings.join(per_repo, "repo", "left").select(
        "repo",
        F.when(~F.col("has_python"), C.NO_CODE_SCORE)
        .when(F.col("scores").isNull(), 0.0)
        .otherwise(total / F.size("scores"))
        .alias("score"),
    )
