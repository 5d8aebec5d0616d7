"""One query for each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm import (
    byte_bpe,
    decontaminate,
    html_text,
    language,
    mixing,
    near_dup,
    secret_scan,
    spelling,
    token_count,
    toxicity,
    url_filter,
    whitening,
)
from trustlake.llm.exact_dedup import DigestIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(modulus: int, held: int) -> Column:
    """Is this one of the held-out documents? Those without a number are not."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(number % modulus == held, F.lit(False))


def sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


@query(
    """
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
           doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window same as (partition by coalesce(text, ''))
    """
)
def op7_exact_dedup(spark, sf):
    decided = DigestIndex.scratch(spark).add(table(spark, sf, "documents"))
    return decided.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query()
def op9_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    texts = language.sample(docs.where(F.col("doc_id").isNotNull() & ~fold(4, 2)))
    found = language.identify(docs, texts)
    return found.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


@query()
def op10_secret_scan(spark, sf):
    found = secret_scan.scan(table(spark, sf, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS],
        sha256(joined(base)).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query()
def op8_minhash_near_dedup(spark, sf):
    found = near_dup.near_duplicates(table(spark, sf, "documents"), size=4)
    return found.drop("mark")


@query()
def op6_decontaminate(spark, sf):
    return decontaminate.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op3_toxicity(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.score(table(spark, sf, "documents"), labels.where(~fold(5, 0)))
    return found.select(
        "doc_id", fold(5, 0).alias("held_out"), "score", "predicted",
        F.array_join("neighbours", ",").alias("neighbours"), F.array_join("terms", ",").alias("terms"),
    )


@query()
def op1_token_counts(spark, sf):
    vocabulary = token_count.load(token_count.VOCABULARY)
    return token_count.count_tokens(table(spark, sf, "documents"), vocabulary)


@query()
def op2_html_text(spark, sf):
    return html_text.extract_text(table(spark, sf, "pages"))


HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, fetched over the thirty days from 2024-01-01."""
    return table(spark, sf, "pages").select(
        "page_id", "url",
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(page_id * 37 % 43200 as int))")
        .alias("fetched"),
    )


def list_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Dated entries: each event touches the hosts that share its user's number."""
    url = F.col("url")
    hosts = (
        captures(spark, sf).groupBy(url_filter.host(url).alias("host"))
        .agg(F.min(url_filter.canonical(url)).alias("first_url")).where("host is not null")
        .withColumn("number", F.conv(F.substr(F.md5(F.col("host").cast("binary")), F.lit(1), F.lit(4)), 16, 10)
                    .cast("long") % 512)
    )
    events = table(spark, sf, "events").withColumn("number", F.col("user_id") % 512)
    part = F.col("event_id") % 4
    return events.join(hosts, "number").select(
        F.element_at(F.array(*map(F.lit, ("host", "domain", "prefix", "url"))), (part + 1).cast("int"))
        .alias("kind"),
        F.when(part == 0, F.col("host"))
        .when(part == 1, F.regexp_replace("host", r"^[^.]*\.", ""))
        .when(part == 2, F.concat("host", F.lit("/en/")))
        .otherwise(F.col("first_url")).alias("pattern"),
        F.when(F.col("event_type").isin("error", "view"), "deny").otherwise("allow").alias("verdict"),
        F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add").alias("action"),
        F.col("ts").alias("at"),
    )


@query(
    f"""
    with captures as (
        select page_id, url,
               timestamp '2024-01-01' + to_minutes((page_id * 37 % 43200)::int) as fetched,
               nullif(regexp_replace(regexp_extract(lower(url), '{HOST}', 1), '\\.$', ''), '') as host,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) as tail,
               regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) as query
        from pages
    ), parsed as (
        select *, case when tail = '' then '/' else tail end as path, host || path || query as whole,
               string_split(host, '.') as labels, string_split(path, '/') as steps
        from captures
    ), asked as (
        select page_id, url, fetched, 'domain' as kind,
               array_to_string(labels[len(labels) - n + 1:], '.') as pattern, n as rank
        from parsed, lateral (select unnest(range(1, len(labels) + 1)) as n)
        union all select page_id, url, fetched, 'host', host, 1000000 from parsed
        union all
        select page_id, url, fetched, 'prefix', host || array_to_string(steps[1:n], '/') || '/', n + 2000000
        from parsed, lateral (select unnest(range(1, len(steps))) as n)
        union all select page_id, url, fetched, 'url', whole, 9000000 from parsed
    ), hosts as (
        select host, min(whole) as first_url, ('0x' || substr(md5(host), 1, 4))::bigint % 512 as number
        from parsed where host is not null group by host
    ), entries as (
        select case event_id % 4 when 0 then 'host' when 1 then 'domain' when 2 then 'prefix' else 'url' end
                   as kind,
               case event_id % 4 when 0 then host when 1 then regexp_replace(host, '^[^.]*\\.', '')
                   when 2 then host || '/en/' else first_url end as pattern,
               case when event_type in ('error', 'view') then 'deny' else 'allow' end as verdict,
               event_id % 3 <> 0 as added, ts as moment
        from events join hosts on user_id % 512 = number
    ), changes as (
        select kind, pattern, verdict, moment, bool_or(added) as listed from entries group by all
    ), turns as (
        select *, lag(listed, 1, false) over (partition by kind, pattern, verdict order by moment) as before
        from changes
    ), spans as (
        select *, lead(moment) over (partition by kind, pattern, verdict order by moment) as until
        from (select * from turns where listed <> before)
    ), found as (
        select a.*, s.verdict, count(*) over same as listed,
               row_number() over (partition by page_id, url, fetched order by rank desc, s.verdict = 'allow' desc,
                                  a.kind desc, a.pattern desc) as place
        from asked a join spans s using (kind, pattern)
        where s.listed and moment <= fetched and (until is null or fetched < until)
        window same as (partition by page_id, url, fetched)
    )
    select c.page_id, c.url, coalesce(f.verdict = 'deny', false) as blocked,
           coalesce(f.listed, 0) as listed, f.kind, f.pattern, f.verdict
    from captures c left join (select * from found where place = 1) f
      on c.page_id = f.page_id and c.url = f.url
    """
)
def op4_url_filter(spark, sf):
    return url_filter.evaluate(captures(spark, sf), list_entries(spark, sf)).drop("fetched")


def mixing_sql() -> str:
    topics = " ".join(
        f"when regexp_matches(t, '{pattern.replace(chr(39), chr(39) * 2)}') then '{name}'"
        for name, pattern in mixing.TOPICS
    )
    parts = [
        f"""texts as (
            select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as t
            from documents
        ), m as materialized (
            select doc_id, source, lang, case {topics} else 'prose' end as topic,
                   len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as tokens,
                   ('0x' || substr(md5(concat_ws('|', doc_id::varchar, md5(t))), 1, 12))::bigint
                       / 281474976710656.0::double as u
            from texts
        ), c0 as materialized (
            select source, lang, topic, sum(tokens)::double as tokens, case when sum(tokens) > 0 then 1.0 else 0.0 end::double as weight
            from m group by all
        ), total as (select sum(tokens) as t from c0)"""
    ]
    for name, power in mixing.TEMPER.items():
        parts.append(
            f"""a_{name} as materialized (
            select {name}, share / sum(share) over () * (select t from total) as aim
            from (select {name}, pow(sum(tokens), {power}) as share from c0 group by 1 having sum(tokens) > 0)
        )"""
        )
    k = 0
    for _ in range(mixing.ROUNDS):
        for name in mixing.TEMPER:
            k += 1
            parts.append(
                f"""c{k} as materialized (
            select c.source, c.lang, c.topic, tokens,
                   weight * case when now > 0 then coalesce(aim, 0) / now else 0 end as weight
            from c{k - 1} c
            join (select {name}, sum(tokens * weight) as now from c{k - 1} group by 1) using ({name})
            left join a_{name} using ({name})
        )"""
            )
    return f"""with {", ".join(parts)}
        select doc_id, source, lang, topic, m.tokens, round(weight, 6) as weight,
               round(weight * {mixing.FRACTION}, 6) as expected,
               (floor(weight * {mixing.FRACTION})
                + (u < weight * {mixing.FRACTION} - floor(weight * {mixing.FRACTION}))::int)::bigint as copies
        from m join c{k} using (source, lang, topic)"""


@query(mixing_sql())
def op5_mix_sources(spark, sf):
    found = mixing.chances(table(spark, sf, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("weight", "expected")})


def crc32_sql(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes, byte by byte over a table of remainders."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    digits = f"hex({text})"
    return f"""xor(list_reduce([4294967295] || list_transform(range(1, length({digits}) + 1, 2),
            lambda i: ('0x' || substr({digits}, i, 2))::bigint),
            lambda c, b: xor(c >> 8, list_extract({table}, (xor(c, b) & 255) + 1))), 4294967295)"""


@query(
    f"""
    with recursive runs as (
        select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents
    ), lowered as (
        select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w,
               count(*) as c
        from runs group by all
    ), keyed as (
        select *, coalesce(doc_id::varchar, '') || ':' || w as key from lowered
    ), hashed as materialized (
        select w, c, {crc32_sql("key")} as h from keyed
    ), drawn as (
        select case when h % {spelling.ONE_IN} = 0
                    then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word,
               c
        from hashed
    ), words as materialized (
        select word, sum(c)::bigint as n from drawn where length(word) >= {spelling.SHORTEST}
        group by word having sum(c) >= {spelling.RAREST}
    ), cuts as materialized (
        select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
        from words, lateral (select unnest(range(1, length(word) + 1)) as i)
    ), near as (
        select a.word, b.word as near, b.n as m
        from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
        union select a.word, b.word, b.n from cuts a join words b on a.rest = b.word
        union select b.word, a.word, a.n from cuts a join words b on a.rest = b.word
    ), best as (
        select word, count(*) as n_near, max(m) as m, arg_min(near, (-m, encode(near))) as near from near group by word
    ), forms as materialized (
        select w.word, n, coalesce(n_near, 0) as n_near, case when m >= 2 * n then near end as form,
               case when m >= 2 * n then m end as form_n
        from words w left join best using (word)
    ), chains as (
        select word, word as root from forms
        union all
        select c.word, f.form from chains c join forms f on c.root = f.word where f.form is not null
    ), ends as (
        select c.word, c.root from chains c join forms f on c.root = f.word where f.form is null
    )
    select word, form, root, n, n_near, form_n from forms join ends using (word)
    """
)
def op11_spelling_variants(spark, sf):
    return spelling.group_variants(table(spark, sf, "documents"))


@query()
def op12_whiten(spark, sf):
    vectors = table(spark, sf, "embeddings")
    fitted = whitening.fit(vectors)
    error = whitening.identity_error(vectors, fitted) if fitted else 0.0
    return whitening.whiten(vectors, fitted).withColumn("identity_error", F.lit(error))


@query()
def op13_byte_bpe(spark, sf):
    ranks = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(table(spark, sf, "documents"), ranks)
    decoded = byte_bpe.decode(encoded.withColumn("ids_sha256", sha256(F.col("ids"))), ranks)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", sha256(F.col("decoded")).alias("decoded_sha256"))
