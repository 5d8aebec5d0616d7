"""Registry tables derived from the star-schema, event and text tables.

There is no artifact registry among the test tables, so every input of the
operators is derived from them row by row: artifacts from ``part``, listings
from ``lineitem``, pull requests from ``orders``, log lines from ``events``,
READMEs and source files from ``documents``, and so on. Two code repositories
are hot on purpose: a third of all pull requests and source files belong to
repository 0.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.ids import artifact_id
from trustlake.operators.metrics import Landed

AS_OF = "2024-02-01T00:00:00Z"
HEALTH_AS_OF = datetime(2024, 1, 15, 12, 0, 0)
LOG_GROUPS = [f"g{i}" for i in range(10)]  # g9 never logs
PATTERNS = [
    (1, "wid.et"),
    (2, "^small"),
    (3, "(bolt|gear) [0-9]+5$"),
    (4, "(a+)+"),
    (5, "apache"),
    (6, "licen[cs]e"),
    (7, "x{1,999}"),
    (8, "(th|the)+"),
    (9, "evaluation[a-z]*"),
    (10, "[0-9]{2,3}%"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Files that one micro-batch takes.
FILES_PER_TRIGGER = 1000


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream; the table is a directory or a single file.

    ``place`` is the file of a row and the block in it.
    """
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
    if table.inputFiles()[0].endswith(f"/{name}.parquet"):
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    else:
        stream = reader.parquet(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    )
    return stream.select("*", place.alias("place"))


def repo(number: str) -> str:
    """SQL expression: repository name of a number."""
    return f"concat('org', ({number}) % 97, '/model', {number})"


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, id, name, model_url, download_url, net_score, results, seq."""
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as p",
        "elt(cast(p_partkey % 3 as int) + 1, 'model', 'dataset', 'code') as type",
        "concat(p_name, ' ', p_partkey) as name",
        f"""case when p_partkey % 19 = 0 then ''
                 else concat('https://huggingface.co/', {repo('p_partkey')}) end as model_url""",
    )
    return parts.select(
        "type",
        artifact_id("name").alias("id"),
        "name",
        "model_url",
        F.expr("concat('https://store.example/', type, '/', p, '.zip')").alias("download_url"),
        F.expr("((p * 37) % 1001) / 1000.0D").alias("net_score"),
        F.expr(_results_expr()).alias("results"),
        F.col("p").alias("seq"),
    )


RESULT_FORMS = {
    # metric -> JSON of its result, by part key
    "ramp_up_time": "concat('[', (p % 11) / 10.0D, ', ', p % 90, ']')",
    "bus_factor": "concat('[null, ', p % 70, ']')",
    "performance_claims": "concat('', (p % 2))",
    "license": "case when p % 4 = 0 then '[]' else concat('[', (p % 3) / 2.0D, ']') end",
    "size_score": (
        "case when p % 5 = 0 then '0.5' else concat('[{\"raspberry_pi\": ', (p % 6) / 5.0D,"
        " ', \"jetson_nano\": 0.25, \"desktop_pc\": ', (p % 7) / 8.0D,"
        " ', \"aws_server\": 1.0}, ', p % 200, ']') end"
    ),
    "dataset_and_code_score": "concat('[0.5, ', p % 13, ']')",
    "dataset_quality": "concat('[', (p % 20) / 20.0D, ', 7]')",
    "code_quality": "'\"0.7\"'",
    "reviewedness": "concat('[', (p % 9) - 1, ', 3]')",
}


def _results_expr() -> str:
    """JSON object of all result forms; ``reproducibility`` is left out."""
    entries = ", ', ', ".join(f"'\"{m}\": ', {e}" for m, e in RESULT_FORMS.items())
    return f"concat('{{', {entries}, '}}')"


METRIC_SCORE = """case when (p + i) % 23 = 0 then cast(null as double)
                       when (p + i) % 29 = 0 then -1.0D
                       when (p * 3 + i) % 31 = 0 then 0.25D
                       else ((p * (7 + 2 * i)) % 501) / 1000.0D + 0.5D end"""


def metric_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long results of every part: ten rows each, the size score as a map."""
    metrics = ", ".join(f"'{m}'" for m in C.METRIC_WEIGHTS)
    devices = ", ".join(f"'{d}', {j}" for j, d in enumerate(C.DEVICES))
    rows = (
        table(spark, sf_dir, "part")
        .selectExpr("p_partkey as p", "elt(cast(p_partkey % 3 as int) + 1, 'model', 'dataset', 'code') as type")
        .selectExpr("p", "type", f"posexplode(array({metrics})) as (i, metric)")
        .selectExpr("p", "i", "type", "metric", f"{METRIC_SCORE} as s")
    )
    return rows.selectExpr(
        "type",
        "p as id",
        "metric",
        "case when metric <> 'size_score' then s end as score",
        f"""case when metric = 'size_score' and s is not null
                 then transform_values(map({devices}), (d, j) -> abs(s) - j / 8.0D) end
            as device_scores""",
        "cast(p % 100 as bigint) as latency_ms",
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models_of(table(spark, sf_dir, "part")).drop("p")


def models_of(parts: DataFrame, *more: str) -> DataFrame:
    """Registered models, one per part, with extracted links; ``p`` is the part key."""
    rows = parts.selectExpr("p_partkey as p", f"{repo('p_partkey')} as name", *more)
    return rows.select(
        "p",
        *more,
        F.lit("model").alias("type"),
        artifact_id("name").alias("id"),
        "name",
        F.expr(
            """case p % 8 when 2 then concat('https://github.com/', name, '.git')
                 when 3 then name
                 when 4 then concat(' hf://', name, ' ')
                 when 6 then concat('https://huggingface.co/', name, '/tree/main')
                 else concat('https://huggingface.co/', name) end"""
        ).alias("model_url"),
        F.expr(
            """case p % 5 when 0 then 'NULL' when 1 then null
                 when 2 then concat('https://github.com/', name, '.git')
                 when 3 then concat('https://github.com/', name, '/tree/x')
                 else concat('https://gitlab.com/', name) end"""
        ).alias("code_url"),
        F.expr(
            """case when p % 7 < 3 then 'NULL' when p % 7 < 5
                 then concat('https://data.example/', p) end"""
        ).alias("dataset_url"),
    )


def registrations_of(parts: DataFrame, *more: str) -> DataFrame:
    """artifact_type, source_url, name, code_url, dataset_url; some incomplete."""
    return models_of(parts, *more).selectExpr(
        *more,
        """case when p % 11 = 0 then '' when p % 12 = 0 then null when p % 13 = 0 then 'dataset'
             else type end as artifact_type""",
        "case when p % 17 = 0 then '' else model_url end as source_url",
        "case when p % 19 <> 0 then name end as name",
        "code_url",
        "dataset_url",
    )


def model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        f"{repo('p_partkey')} as model_id",
        "case when p_partkey % 17 = 0 then 404 else 200 end as status_code",
        "case when p_partkey % 41 <> 0 then concat('sha', p_partkey) end as sha",
        """case when p_partkey % 23 = 0 then 'n/a'
             else cast(p_size * 997 * (p_partkey % 50) as string) end as downloads""",
        "cast((p_partkey * 13) % 2000 as bigint) as likes",
        """case when p_partkey % 29 = 0 then 'yesterday' when p_partkey % 31 = 0 then null
             else concat(date_add(date'2022-12-01', cast(p_partkey % 500 as int)),
                         'T06:00:00.000Z') end as last_modified""",
        """case when p_partkey % 5 = 0 then array('pytorch', 'Example-code')
             when p_partkey % 7 = 0 then array('tutorials') else array('nlp') end as tags""",
        "p_partkey % 4 <> 3 as has_card",
        """case p_partkey % 6 when 0 then array('Wikipedia', 'c4') when 1 then array('MNIST')
             else cast(array() as array<string>) end as datasets""",
    )


def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each model: its lineitems in (order, line) order."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey as p",
        "l_orderkey as o",
        "l_linenumber as n",
        """cast(floor(l_extendedprice * case l_partkey % 5 when 0 then 10D when 1 then 100D
             when 2 then 1000D when 3 then 10000D else 100000D end) as bigint) as bytes""",
    )
    return rows.selectExpr(
        f"{repo('p')} as model_id",
        "o * 8 + n as ord",
        """case n when 1 then concat('model-0000', n, '.safetensors')
             when 2 then 'pytorch_model.bin'
             when 3 then case when p % 2 = 0 then 'README.md' else 'docs/readme.txt' end
             when 4 then case when p % 3 = 0 then 'train.py' else 'train.sh' end
             when 5 then 'weights/Model_x.txt'
             when 6 then 'consolidated.PTH' else 'notes.txt' end as rfilename""",
        """case when o % 11 = 0 then 'chunked' when o % 5 <> 0 then cast(bytes as string)
           end as content_length""",
        "case when o % 5 = 0 then concat('bytes 0-0/', bytes) end as content_range",
    )


PR_REPO = "case when {k} % 3 = 0 then 0 else cast(floor({k} / 40) as bigint) end"


def prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        f"{repo('(' + PR_REPO.format(k='o_orderkey') + ')')} as repo",
        "o_orderkey as number",
        "o_orderdate as updated_at",
        "case when o_orderstatus = 'F' then o_orderdate end as merged_at",
    )


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{repo('(' + PR_REPO.format(k='l_orderkey') + ')')} as repo",
        "l_orderkey as number",
        """concat('src/m', l_partkey, element_at(
             array('.py', '.md', '.Bin', '.py', '.safetensors', '.c', '.txt'), l_linenumber))
           as filename""",
        "cast(l_quantity as bigint) as additions",
    )


def pr_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr(
        f"{repo('(' + PR_REPO.format(k='l_orderkey') + ')')} as repo",
        "l_orderkey as number",
        "cast(l_linenumber as bigint) as review_id",
    )


README_TAIL = r"""case d % 9
  when 1 then '\n## Dataset\nTrained on Wikipedia and BookCorpus, deduplicated.\n# More\nSQuAD'
  when 2 then concat('\n# Intro\nx\n## Evaluation results\naccuracy of ', d % 100, '%\n')
  when 3 then '\nLicense: apache-2.0\n'
  when 4 then '\n```python\nfrom transformers import x\n```\nfiltered, balanced data\n'
  when 5 then '\n## License\nBSD-3-Clause\n## Training data\nImageNet and COCO, train/val split\n'
  when 6 then '\n| Metric | Accuracy |\n|---|---|\n| a | 91 |\n| b | 92.5 |\n'
  when 7 then concat('\nversion 2024-01-05 released, f1 ', d % 40, ' todo\n')
  when 8 then concat('\n---\nmodel-index:\n metrics:\n  - value: 0.', d, '\n')
  else case when d % 36 <> 9
    then '\nlicense: mit\n## Data\nWikipedia, BookCorpus\n## Evaluation\naccuracy 92%\n'
    else '\nLicensed under the OpenRAIL license\n' end end"""


def readme_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, text: every document with a README tail by document number."""
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("doc_id as d", "text as body")
        .selectExpr("d", f"concat(body, {README_TAIL}) as text")
    )


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, file, branch, status_code, text: up to three files per repository."""
    return readme_texts(spark, sf_dir).selectExpr(
        f"{repo('d')} as repo",
        """inline(filter(array(
             named_struct(
               'file', case when d % 8 = 7 then 'model_index.json' else 'README.md' end,
               'branch', case when d % 8 = 6 then 'master' else 'main' end,
               'status_code', case when d % 37 = 0 then 404 else 200 end,
               'text', text),
             case when d % 10 = 3 then named_struct('file', 'config.json', 'branch', 'main',
               'status_code', 200, 'text', '{"hidden": 768, "accuracy": "tbd"}') end,
             case when d % 16 = 6 then named_struct('file', 'README.md', 'branch', 'main',
               'status_code', 200, 'text', '  ') end
           ), f -> f is not null))""",
    )


README_KEY = "case when d % 8 = 2 then 'github.com/' else 'huggingface.co/' end"


def readme_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed replies about READMEs, one per repository; some failed, some are broken."""
    return readme_texts(spark, sf_dir).selectExpr(
        f"concat({README_KEY}, {repo('d')}) as key",
        "case when d % 37 = 0 then 404 else 200 end as status_code",
        """array(named_struct('rfilename', 'config.json'),
                 named_struct('rfilename', case when d % 9 = 0 then 'x' when d % 10 = 1
                                                then concat('docs/ReadMe_', d) else 'README.md' end))
           as siblings""",
        "case when d % 16 = 10 then 'README.rst' end as readme_name",
        """case when d % 8 = 2 then case when d % 24 = 2 then '%%%'
                else base64(cast(text as binary)) end end as content""",
        "text",
    )


def pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pattern_id, regex: a pattern for each customer; some are unsafe, some hold no letters."""
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as int) as pattern_id",
        """case c_custkey % 6 when 0 then concat('(ring|bolt) ', c_custkey % 100, '$')
             when 1 then concat('^Small .* ', c_custkey) when 2 then concat('gear [0-9]*', c_custkey % 10, 'x?$')
             when 3 then concat('(', c_custkey, '+)+') when 4 then concat('(red|blue|', c_custkey, ') widget')
             else concat('[0-9]{2}', c_custkey % 10) end as regex""",
    )


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        f"{repo('page_id')} as model_id",
        "url",
        f"""concat(html, case page_id % 3
              when 0 then concat('<p>github.com/foo/bar.git <a href="https://github.com/',
                                 {repo('floor(page_id / 2)')}, '">code</a>')
              when 1 then concat(' see github.com/', {repo('page_id')}, ' ')
              else '' end) as html""",
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files: a small program, then a document as comment lines."""
    return table(spark, sf_dir, "documents").selectExpr(
        f"{repo('(case when doc_id % 3 = 0 then 0 else floor(doc_id / 12) end)')} as repo",
        "doc_id as ord",
        "case when doc_id % 13 = 0 then 'dir' else 'file' end as kind",
        """case when doc_id % 5 = 0 then 'README.md' else concat('f', doc_id, '.py') end
           as name""",
        "case when doc_id % 11 = 0 then 404 else 200 end as status_code",
        r"""concat(case doc_id % 4
              when 0 then 'def f(x):\n    "Doc."\n    return x\n'
              when 1 then 'import os\nimport sys\n\ndef f(x):\n    if x:\n        return eval(x)\n    return sys.argv\n'
              when 2 then 'def broken(:\n'
              else 'def f():\n    "Doc."\n    global g\n    g = 1\n' end,
            '# ', replace(text, '\n', '\n# ')) as text""",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed replies, one per model: JSON with the content of an answer."""
    rows = (
        table(spark, sf_dir, "conversations")
        .where("role = 'assistant'")
        .selectExpr(
            f"{repo('conv_id * 6 + floor(turn / 2)')} as name",
            """concat(text, case conv_id % 4
                 when 0 then '\nFinal Response -- Status Code : 0.5'
                 when 1 then '\nFinal Response -- Status Code : 1'
                 when 2 then '\nFinal Response -- Status Code: 1' else '' end) as content""",
        )
    )
    message = F.struct(F.struct(F.col("content")).alias("message"))
    return rows.select(
        F.lit("model").alias("type"),
        artifact_id("name").alias("id"),
        F.to_json(F.struct(F.array(message).alias("choices"))).alias("body"),
    )


def landed(spark: SparkSession, sf_dir: str, strict_links: bool = False) -> Landed:
    return Landed(
        models=models(spark, sf_dir),
        info=model_info(spark, sf_dir),
        siblings=siblings(spark, sf_dir),
        repo_files=repo_files(spark, sf_dir),
        pages=html_pages(spark, sf_dir).select("model_id", "html"),
        prs=prs(spark, sf_dir),
        reviews=pr_reviews(spark, sf_dir),
        pr_files=pr_files(spark, sf_dir),
        code_files=code_files(spark, sf_dir),
        responses=responses(spark, sf_dir),
        as_of=as_of(),
        strict_links=strict_links,
    )


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, id, type, seq: part names, then repository names of documents, some
    of them indexed again under a new name.
    """
    parts = artifacts(spark, sf_dir).select(
        "name", F.col("id").cast("string").alias("id"), "type", "seq"
    )
    docs = (
        table(spark, sf_dir, "documents")
        .selectExpr("doc_id as d", f"{repo('doc_id')} as repo")
        .select(
            "repo",
            artifact_id("repo").cast("string").alias("id"),
            F.lit("model").alias("type"),
            F.expr(
                """explode(filter(array(
                     named_struct('name', repo, 'seq', 10000000000 + 2 * d),
                     case when d % 5 = 0 then named_struct('name', concat(repo, ' renamed'),
                       'seq', 10000000001 + 2 * d) end), e -> e is not null))"""
            ).alias("e"),
        )
        .select("e.name", "id", "type", "e.seq")
    )
    return parts.unionByName(docs)


def readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, id, text: stored READMEs; some belong to no indexed artifact."""
    return readme_texts(spark, sf_dir).select(
        F.lit("model").alias("type"),
        artifact_id(
            F.expr(f"case when d % 7 = 0 then concat('ghost', d) else {repo('d')} end")
        ).alias("id"),
        "text",
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(table(spark, sf_dir, "events"))


def log_lines(events: DataFrame) -> DataFrame:
    """log_group, ts, message, event_id; a third of all lines are in group g0."""
    return events.selectExpr(
        "case when event_id % 3 = 0 then 'g0' else concat('g', user_id % 9) end as log_group",
        "ts",
        """concat(case event_type when 'signup' then 'Warning signup' else event_type end,
                  ' ', props) as message""",
        "event_id",
    )


def api_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("ts", "value as latency_ms")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, id, length of stored archives; those of small parts have another id."""
    return (
        table(spark, sf_dir, "part")
        .selectExpr(
            "elt(cast(p_partkey % 3 as int) + 1, 'model', 'dataset', 'code') as type",
            "concat(p_name, ' ', p_partkey) as name",
            "cast(floor(p_retailprice * 12345) as bigint) as length",
            "case when p_size > 5 then 1 else -1 end as sign",
        )
        .select("type", (artifact_id("name") * F.col("sign")).alias("id"), "length")
    )
