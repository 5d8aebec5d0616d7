"""DuckDB SQL for every query of ``trustlake.plans.catalog``.

Each entry is one SELECT. Named tables of ``TABLES`` are put in front of it as
common table expressions, in the order in which they depend on each other. The
derived tables and all rules are written here a second time, in SQL; only
word lists, patterns and literal README tails are shared.
"""

from __future__ import annotations

import re

from trustlake import constants as C
from trustlake.plans import catalog
from trustlake.plans import tables as t

TABLES: dict[str, str] = {}
QUERIES: dict[str, str] = {}


# --- expressions -------------------------------------------------------------------------


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def estrings(sql: str) -> str:
    """Spark string literals with escapes, as DuckDB E-strings."""
    return re.sub(r"'((?:[^'\\]|\\.)*)'", r"E'\1'", sql)


def repo(n: str) -> str:
    return f"concat('org', ({n}) % 97, '/model', {n})"


def artifact_id(name: str) -> str:
    acc = "0::hugeint"
    for start in range(1, 65, 7):
        width = min(7, 65 - start)
        acc = f"({acc} * {16**width} + ('0x' || substr(sha256({name}), {start}, {width}))::hugeint) % {C.ID_MODULUS}"
    return f"({acc})::bigint"


def rint(x: str) -> str:
    return f"round_even({x}, 0)"


def round3(x: str) -> str:
    """Python's round(x, 3): half to even on the exact binary value."""
    p = f"(({x}) * 1e3)"
    split = f"(({x}) * 134217729e0)"
    high = f"({split} - ({split} - ({x})))"
    err = f"(({high} * 1e3 - {p}) + (({x}) - {high}) * 1e3)"
    return (
        f"((case when {p} - floor({p}) <> 0.5e0 then {rint(p)} when {err} > 0 then floor({p}) + 1 "
        f"when {err} < 0 then floor({p}) else {rint(p)} end) / 1e3)"
    )


def any_word(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def words_found(column: str, words) -> str:
    items = ", ".join(f"case when contains({column}, {text(w)}) then {text(w)} end" for w in words)
    return f"list_filter([{items}], lambda w: w is not null)"


def join_list(items: str) -> str:
    return f"coalesce(array_to_string({items}, '|'), '')"


# RE2 word boundaries know ASCII only: letters beyond it count as an "x".
def ascii_letters(column: str) -> str:
    return f"regexp_replace({column}, '[À-ÖØ-öø-ÿĀ-ſ]', 'x', 'g')"


def matches(column: str, pattern: str, options: str = "") -> str:
    return f"regexp_matches({column}, {text(pattern)}, {text(options)})" if options else (
        f"regexp_matches({column}, {text(pattern)})"
    )


def model_id(url: str) -> str:
    u = f"trim({url}, E' \\t\\n\\r')"
    host = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    path = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    seg = f"list_filter(string_split({path}, '/'), lambda s: s <> '')"
    drop = ", ".join(text(s) for s in C.NON_REPO_SEGMENTS)
    # Segments before the first one that does not belong to the repository.
    stop = f"list_min(list_filter(range(1, len({seg}) + 1), lambda i: list_contains([{drop}], {seg}[i])))"
    kept = f"{seg}[1:coalesce({stop} - 1, len({seg}))]"
    return f"""case when starts_with({u}, 'hf://') then array_to_string(string_split({u}[6:], '/')[1:2], '/')
        when not starts_with({u}, 'http') then {u}
        when not ends_with({host}, '{C.HUB_HOST}') then {u}
        when len({seg}) = 0 or {seg}[1] = 'datasets' then {u}
        when len({kept}) = 0 then null else array_to_string({kept}[1:2], '/') end"""


def link(column: str, html: bool, group: int) -> str:
    def first(pattern: str) -> str:
        return f"nullif(regexp_extract({column}, {text(pattern)}, {group}), '')"

    bare = first(C.REPO_LINK)
    return f"coalesce({first('https?://' + C.REPO_LINK)}, {bare})" if html else bare


def license_score(column: str) -> str:
    def hit(patterns) -> str:
        return matches(column, "|".join(patterns))

    return f"""case when {hit(C.LICENSE_RESTRICTIVE)} then 0e0 when {hit(C.LICENSE_UNCLEAR)} then 0.5e0
        when {hit(C.LICENSE_PERMISSIVE)} then case when {hit(C.LICENSE_COMPATIBLE)} then 1e0 else 0e0 end
        else 0e0 end"""


def marked(column: str) -> str:
    """A text with character 1 in front of every markdown heading."""
    return f"regexp_replace({column}, '(?m)^([ \\t]*#{{1,6}}[ \\t]+\\S)', chr(1) || '\\1', 'g')"


def section(column: str, heading: str, group: int = 2) -> str:
    """Body of the first section with such a heading, in a marked text."""
    pattern = (
        "(?ims)^\\x01?[ \\t]*#{1,6}[ \\t]*(" + heading + ")\\b[^\\n]*\\n([^\\x01]*)"
    )
    return f"regexp_extract({column}, {text(pattern)}, {group})"


def has_section(column: str, heading: str) -> str:
    pattern = "(?ims)^\\x01?[ \\t]*#{1,6}[ \\t]*(" + heading + ")\\b[^\\n]*\\n"
    return matches(column, pattern)


def device_ladder(device: str, gib: str) -> str:
    rungs = C.DEVICE_LADDERS[device]
    first = "<=" if device == "raspberry_pi" else "<"
    cases = [f"when {gib} {first} {rungs[0][0]}::double then {rungs[0][1]}::double"]
    cases += [f"when {gib} < {b}::double then {s}::double" for b, s in rungs[1:]]
    return "case " + " ".join(cases) + " else 0e0 end"


def last_error(limit: int) -> str:
    return f"row_number() over (partition by log_group order by ts desc, event_id desc) <= {limit}"


# --- derived tables ----------------------------------------------------------------------

TYPE = "['model', 'dataset', 'code'][(p_partkey % 3 + 1)::int]"

RESULT_FORMS = {
    "ramp_up_time": "concat('[', (p % 11) / 1e1, ', ', p % 90, ']')",
    "bus_factor": "concat('[null, ', p % 70, ']')",
    "performance_claims": "concat('', (p % 2))",
    "license": "case when p % 4 = 0 then '[]' else concat('[', (p % 3) / 2e0, ']') end",
    "size_score": (
        "case when p % 5 = 0 then '0.5' else concat('[{\"raspberry_pi\": ', (p % 6) / 5e0,"
        " ', \"jetson_nano\": 0.25, \"desktop_pc\": ', (p % 7) / 8e0,"
        " ', \"aws_server\": 1.0}, ', p % 200, ']') end"
    ),
    "dataset_and_code_score": "concat('[0.5, ', p % 13, ']')",
    "dataset_quality": "concat('[', (p % 20) / 2e1, ', 7]')",
    "code_quality": "'\"0.7\"'",
    "reviewedness": "concat('[', (p % 9) - 1, ', 3]')",
}
_ENTRIES = ", ', ', ".join(f"'\"{m}\": ', {e}" for m, e in RESULT_FORMS.items())

TABLES["parts"] = f"""select p_partkey as p, {TYPE} as type, concat(p_name, ' ', p_partkey) as name,
  p_name, p_retailprice, p_size from part"""
TABLES["artifacts"] = f"""select type, {artifact_id('name')} as id, name,
  case when p % 19 = 0 then '' else concat('https://huggingface.co/', {repo('p')}) end as model_url,
  concat('https://store.example/', type, '/', p, '.zip') as download_url,
  ((p * 37) % 1001) / 1e3 as net_score, concat('{{', {_ENTRIES}, '}}') as results, p as seq from parts"""

_METRIC_VALUES = ", ".join(f"({i}, '{m}')" for i, m in enumerate(C.METRIC_WEIGHTS))
TABLES["raw_results"] = f"""select p as id, type, m.i, m.metric,
  case when (p + i) % 23 = 0 then null when (p + i) % 29 = 0 then -1e0
    when (p * 3 + i) % 31 = 0 then 0.25e0 else ((p * (7 + 2 * i)) % 501) / 1e3 + 0.5e0 end as s
  from parts, (values {_METRIC_VALUES}) m(i, metric)"""
_DEVICE_MEAN = "((((abs(s) - 0e0) + (abs(s) - 0.125e0)) + (abs(s) - 0.25e0)) + (abs(s) - 0.375e0)) / 4e0"
TABLES["metric_results"] = f"""select type, id, metric, s,
  case when metric = 'size_score' then {_DEVICE_MEAN} else s end as score from raw_results"""

TABLES["models"] = f"""select p, p_size, 'model' as type, {artifact_id('name')} as id, name,
  case p % 8 when 2 then concat('https://github.com/', name, '.git') when 3 then name
    when 4 then concat(' hf://', name, ' ')
    when 6 then concat('https://huggingface.co/', name, '/tree/main')
    else concat('https://huggingface.co/', name) end as model_url,
  case p % 5 when 0 then 'NULL' when 1 then null when 2 then concat('https://github.com/', name, '.git')
    when 3 then concat('https://github.com/', name, '/tree/x')
    else concat('https://gitlab.com/', name) end as code_url,
  case when p % 7 < 3 then 'NULL' when p % 7 < 5 then concat('https://data.example/', p) end as dataset_url
  from (select p_partkey as p, p_size, {repo('p_partkey')} as name from part)"""

TABLES["model_info"] = f"""select {repo('p')} as model_id, p,
  case when p % 17 = 0 then 404 else 200 end as status_code,
  case when p % 41 <> 0 then concat('sha', p) end as sha,
  case when p % 23 = 0 then 'n/a' else (p_size * 997 * (p % 50))::varchar end as downloads,
  ((p * 13) % 2000)::bigint as likes,
  case when p % 29 = 0 then 'yesterday' when p % 31 = 0 then null
    else concat(strftime(date '2022-12-01' + (p % 500)::int, '%Y-%m-%d'), 'T06:00:00.000Z') end as last_modified,
  case when p % 5 = 0 then ['pytorch', 'Example-code'] when p % 7 = 0 then ['tutorials'] else ['nlp'] end as tags,
  p % 4 <> 3 as has_card,
  case p % 6 when 0 then ['Wikipedia', 'c4'] when 1 then ['MNIST'] else []::varchar[] end as datasets
  from parts"""
_AGE = f"greatest(0e0, (epoch_us(timestamp '2024-02-01') - epoch_us(try_cast(replace(replace(last_modified, 'T', ' '), 'Z', '') as timestamp))) / 1e6 / 86400e0)"
TABLES["info_scores"] = f"""select *,
  least(1e0, log10(1 + coalesce(try_cast(downloads as bigint), 0)) / 6e0) as popularity,
  greatest(0e0, least(1e0, log10(1 + likes) / 3e0)) as likes_score,
  case when regexp_matches(coalesce(last_modified, ''), '^[0-9]{{4}}-')
    then greatest(0e0, least(1e0, 1e0 - {_AGE} / 365e0)) else 0e0 end as freshness,
  len(list_filter(tags, lambda x: regexp_matches(lower(x), 'example|tutorial'))) > 0 as has_examples
  from model_info"""

TABLES["siblings"] = f"""select {repo('p')} as model_id, o * 8 + n as ord,
  case n when 1 then concat('model-0000', n, '.safetensors') when 2 then 'pytorch_model.bin'
    when 3 then case when p % 2 = 0 then 'README.md' else 'docs/readme.txt' end
    when 4 then case when p % 3 = 0 then 'train.py' else 'train.sh' end
    when 5 then 'weights/Model_x.txt' when 6 then 'consolidated.PTH' else 'notes.txt' end as rfilename,
  case when o % 11 = 0 then case when o % 5 = 0 then bytes end
       when o % 5 <> 0 then bytes when o % 5 = 0 then bytes end as size_bytes
  from (select l_partkey as p, l_orderkey as o, l_linenumber as n,
    floor(l_extendedprice * [10e0, 100e0, 1000e0, 10000e0, 100000e0][(l_partkey % 5 + 1)::int])::bigint as bytes
    from lineitem)"""
_EXT = "|".join(e[1:] for e in C.WEIGHT_EXTENSIONS)
_STEMS = "|".join(C.WEIGHT_STEMS)
IS_WEIGHT = (
    f"(regexp_matches(lower(rfilename), '\\.({_EXT})$') or "
    f"regexp_matches(lower(rfilename), '(^|/)({_STEMS})[^/]*$'))"
)
COUNTED = f"{IS_WEIGHT} and size_bytes >= {C.MIN_WEIGHT_BYTES}"
TABLES["listing_facts"] = f"""select model_id, (sum(size_bytes) filter (where {COUNTED}))::bigint as total_bytes,
  bool_or(lower(rfilename) = 'readme.md') as has_readme, bool_or(lower(rfilename) like '%.py') as has_python
  from siblings group by model_id"""

_PR_REPO = repo("(case when {k} % 3 = 0 then 0 else ({k} // 40) end)")
TABLES["prs"] = f"""select {_PR_REPO.format(k='o_orderkey')} as repo, o_orderkey as number,
  o_orderdate as updated_at, o_orderstatus = 'F' as merged from orders"""
TABLES["pr_files"] = f"""select {_PR_REPO.format(k='l_orderkey')} as repo, l_orderkey as number,
  concat('src/m', l_partkey, ['.py', '.md', '.Bin', '.py', '.safetensors', '.c', '.txt'][l_linenumber]) as filename,
  l_quantity::bigint as additions from lineitem"""
TABLES["pr_reviews"] = f"""select {_PR_REPO.format(k='l_orderkey')} as repo, l_orderkey as number,
  l_linenumber::bigint as review_id from lineitem where l_returnflag = 'R'"""
TABLES["recent_prs"] = f"""select * from prs
  qualify row_number() over (partition by repo order by updated_at desc, number desc) <= {C.RECENT_PRS}"""
_BINARY = "|".join(e[1:] for e in C.BINARY_EXTENSIONS)
TABLES["source_files"] = f"select * from pr_files where not regexp_matches(lower(filename), '\\.({_BINARY})$')"
TABLES["review_scores"] = f"""select repo, case when total > 0 then {round3('reviewed / total::double')} else 0e0 end as score
  from (select r.repo, sum(f.additions) filter (where r.merged) as total,
      coalesce(sum(f.additions) filter (where r.merged and v.number is not null), 0)::double as reviewed
    from recent_prs r
    left join (select distinct repo, number from pr_reviews) v on v.repo = r.repo and v.number = r.number
    left join source_files f on f.repo = r.repo and f.number = r.number group by r.repo)"""

TABLES["readme_texts"] = f"""select d, concat(body, {estrings(t.README_TAIL)}) as text
  from (select doc_id as d, text as body from documents)"""
TABLES["repo_files"] = f"""select {repo('d')} as repo,
    case when d % 8 = 7 then 'model_index.json' else 'README.md' end as file,
    case when d % 8 = 6 then 'master' else 'main' end as branch,
    case when d % 37 = 0 then 404 else 200 end as status_code, text from readme_texts
  union all select {repo('d')}, 'config.json', 'main', 200, '{{"hidden": 768, "accuracy": "tbd"}}'
    from readme_texts where d % 10 = 3
  union all select {repo('d')}, 'README.md', 'main', 200, '  ' from readme_texts where d % 16 = 6"""
TABLES["picked"] = """select repo, file, text from repo_files where status_code = 200 and length(text) > 0
  qualify row_number() over (partition by repo, file order by branch) = 1"""
TABLES["main_readmes"] = """select repo as model_id, text from repo_files
  where status_code = 200 and length(text) > 0 and file = 'README.md' and branch = 'main'"""

TABLES["license_texts"] = f"""select d, regexp_replace(case
    when regexp_extract(low, '(?im)^\\s*license\\s*:\\s*([^\\r\\n#]+)$', 1) <> ''
      then trim(regexp_extract(low, '(?im)^\\s*license\\s*:\\s*([^\\r\\n#]+)$', 1), E' \\t\\n\\r')
    when {has_section('mk', C.LICENSE_HEADING)} then lower(trim({section('mk', C.LICENSE_HEADING)}, E' \\t\\n\\r'))
    else low end, '[\\s_]+', '-', 'g') as license_text
  from (select d, lower(trim(text, E' \\t\\n\\r')) as low, {marked("trim(text, E' \\t\\n\\r')")} as mk from readme_texts)"""
_SEC1, _SEC2 = C.DATASET_HEADINGS
TABLES["data_sections"] = f"""select d, text, case when {has_section('mk', _SEC1)} then {section('mk', _SEC1)}
    else {section('mk', _SEC2)} end as section
  from (select d, text, {marked('text')} as mk from readme_texts)"""
TABLES["readme_facts"] = f"""select model_id, trim(text, E' \\t\\n\\r') = '' as blank, license, python_signal,
    {words_found('scope', C.TRUSTED_DATASETS)} as trusted, len({words_found('scope', C.QUALITY_WORDS)}) as quality_hits,
    section <> '' as has_section
  from (select m.model_id, m.text, coalesce(s.section, '') as section,
      lower(case when coalesce(s.section, '') <> '' then s.section else m.text end) as scope,
      coalesce({license_score(ascii_letters('l.license_text'))}, 0e0) as license,
      {any_word('lower(m.text)', C.PYTHON_SIGNALS)} as python_signal
    from main_readmes m
    left join (select {repo('d')} as model_id, text, section, d from data_sections) s on s.model_id = m.model_id and s.text = m.text
    left join license_texts l on l.d = s.d)"""

_NUM = text(C.NUMBER.replace("(?:", "(?:"))
TABLES["claim_texts"] = f"select d, {ascii_letters('lower(text)')} as low from readme_texts"
TABLES["parts_of"] = """select d, unnest(string_split(regexp_replace(low, '\\n(#{1,6}\\s)', chr(1) || '\\1', 'g'), chr(1))) as sec
  from claim_texts"""
TABLES["claim_sections"] = f"""select d, sec from parts_of
  where regexp_matches(regexp_extract(sec, '^[^\\n]*'), {text(C.CLAIM_HEADING)})"""
TABLES["scopes"] = """select d, sec from claim_sections
  union all select d, low from claim_texts where d not in (select d from claim_sections)"""


def numbers(source: str, column: str) -> str:
    """(d, s, start, token) for every number in ``source``."""
    gap = f"string_split_regex({column}, {_NUM})"
    tok = f"regexp_extract_all({column}, {_NUM})"
    before = (
        "coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0)"
        " + coalesce(list_sum(list_transform(toks[1:k - 1], lambda x: length(x))), 0)"
    )
    return f"""select d, s, ({before})::bigint as start, toks[k] as token from (
      select *, unnest(range(1, len(toks) + 1)) as k
      from (select d, {column} as s, {gap} as gaps, {tok} as toks from {source}))"""


_METRIC_RE = "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in C.METRIC_WORDS)


def near(source: str, column: str) -> str:
    """(d, s) of the texts with a number near a metric word."""
    return f"""select distinct d, s from ({numbers(source, column)})
      where regexp_matches(substr(s, greatest(start - 100, 0) + 1, start + 100 - greatest(start - 100, 0)), {text(_METRIC_RE)})
        and not regexp_matches(substr(s, greatest(start - 10, 0) + 1, start + 10 - greatest(start - 10, 0)), {text(C.DATE_OR_VERSION)})"""


def metric_table(column: str) -> str:
    tables = f"regexp_extract_all({column}, '\\n\\|.*\\|\\n\\|[-:\\s|]+\\|\\n(?:\\|.*\\|\\n)+')"
    header = "regexp_extract(x, '^\\n([^\\n]*)', 1)"
    return (
        f"len(list_filter({tables}, lambda x: regexp_matches({header}, {text(_METRIC_RE)})"
        f" and regexp_matches(substr(x, length({header}) + 2), {_NUM}))) > 0"
    )


def yaml_metric(low: str) -> str:
    return (
        f"(contains({low}, 'model-index') and contains({low}, 'metrics:') and "
        f"{matches(low, C.YAML_VALUE)})"
    )


TABLES["near_scopes"] = near("scopes", "sec")
TABLES["claim_docs"] = f"""select d from claim_texts where {yaml_metric('low')}
  union select s.d from scopes s where {matches('s.sec', C.NUMBER)} and not {any_word('s.sec', C.PLACEHOLDER_WORDS)}
    and ({metric_table('s.sec')} or exists (select 1 from near_scopes n where n.d = s.d and n.s = s.sec))"""
# The texts to judge: READMEs and model_index.json hold a document; config.json
# holds no claim.
_PRIORITY = "list_position([" + ", ".join(text(f) for f in C.CLAIM_FILES) + "], file)"
TABLES["claims"] = f"""select p.repo as model_id, case when p.file <> 'config.json' and c.d is not null then 1e0 else 0e0 end as claims
  from (select * from picked where trim(text, E' \\t\\n\\r') <> '' and {_PRIORITY} is not null
    qualify row_number() over (partition by repo order by {_PRIORITY}) = 1) p
  left join (select {repo('d')} as repo, d from claim_docs) c on c.repo = p.repo"""

TABLES["html_pages"] = f"""select {repo('page_id')} as model_id, url, concat(html, case page_id % 3
    when 0 then concat('<p>github.com/foo/bar.git <a href="https://github.com/', {repo('page_id // 2')}, '">code</a>')
    when 1 then concat(' see github.com/', {repo('page_id')}, ' ') else '' end) as html from pages"""
TABLES["page_links"] = f"""select model_id, {link('html', True, 1)} || '/' || {link('html', True, 2)} as page_repo
  from html_pages"""

_PROGRAMS = estrings(
    r"""case doc_id % 4
      when 0 then 'def f(x):\n    "Doc."\n    return x\n'
      when 1 then 'import os\nimport sys\n\ndef f(x):\n    if x:\n        return eval(x)\n    return sys.argv\n'
      when 2 then 'def broken(:\n'
      else 'def f():\n    "Doc."\n    global g\n    g = 1\n' end"""
)
TABLES["code_files"] = f"""select {repo('(case when doc_id % 3 = 0 then 0 else doc_id // 12 end)')} as repo, doc_id as ord,
  case when doc_id % 13 = 0 then 'dir' else 'file' end as kind,
  case when doc_id % 5 = 0 then 'README.md' else concat('f', doc_id, '.py') end as name,
  case when doc_id % 11 = 0 then 404 else 200 end as status_code, doc_id % 4 as program,
  concat({_PROGRAMS}, '# ', replace(text, chr(10), chr(10) || '# ')) as text from documents"""
TABLES["python_files"] = """select *, len(list_filter(regexp_split_to_array(text,
    '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda l: length(l) > 120)) as long_lines
  from code_files where kind = 'file' and name like '%.py'"""
# The four programs: undocumented functions, complexity, risky calls, unused imports, globals.
_CODE = {0: (0, 0, 0, 0, 0), 1: (1, 2, 1, 1, 0), 3: (0, 0, 0, 0, 1)}


def _code_case(position: int) -> str:
    return "case program " + " ".join(f"when {k} then {v[position]}" for k, v in _CODE.items()) + " end"


TABLES["code_scores"] = f"""select *, case when program = 2 then 0e0 else
    greatest(0e0, least(1e1, 1e1 - {_code_case(0)} * 3e0 - 0e0 - least(4e0, {_code_case(1)} * 0.1e0)
      - {_code_case(2)} * 5 * 0.5e0 - least(2e0, {_code_case(3)} * 0.25e0) - least(1e0, long_lines * 0.05e0)
      - least(1e0, {_code_case(4)} * 0.1e0))) / 1e1 end as score from python_files"""
TABLES["code_quality"] = f"""select l.repo, case when not l.has_python then {C.NO_CODE_SCORE}::double
    else coalesce(s.score, 0e0) end as score
  from (select repo, bool_or(kind = 'file' and name like '%.py') as has_python from code_files group by repo) l
  left join (select repo, sum(score order by ord) / count(*) as score from (select * from code_scores where status_code = 200
      qualify row_number() over (partition by repo order by ord) <= {C.MAX_CODE_FILES}) group by repo) s on s.repo = l.repo"""

TABLES["responses"] = f"""select {artifact_id('name')} as id, content from (select {repo('conv_id * 6 + turn // 2')} as name,
    concat(text, case conv_id % 4 when 0 then chr(10) || 'Final Response -- Status Code : 0.5'
      when 1 then chr(10) || 'Final Response -- Status Code : 1'
      when 2 then chr(10) || 'Final Response -- Status Code: 1' else '' end) as content
    from conversations where role = 'assistant')"""


def status(pattern: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(content, {text(pattern)}, 1), '') as double), 0e0)"


def rated(models: str, strict: bool = False) -> str:
    """All ten metrics of a table of models, wide."""
    if strict:
        def present(c):
            return f"(trim(coalesce({c}, '')) not in ('', 'NULL'))"
    else:
        def present(c):
            return f"coalesce({c} <> 'NULL', true)"
    code_on, data_on = present("m.code_url"), present("m.dataset_url")
    is_url = "starts_with(m.model_id, 'http')"
    trusted = ", ".join(text(w) for w in C.TRUSTED_DATASETS)
    low_ds = "list_transform(coalesce(i.datasets, []::varchar[]), lambda x: lower(x))"
    found = f"len(list_distinct(list_concat(r.trusted, list_filter([{trusted}], lambda w: list_contains({low_ds}, w)))))"
    both = (
        f"(list_contains(r.trusted, 'bookcorpus') or list_contains({low_ds}, 'bookcorpus')) and "
        f"(list_contains(r.trusted, 'wikipedia') or list_contains({low_ds}, 'wikipedia'))"
    )
    share = "least(1e0, r.quality_hits / 4e0)"
    quality = f"""case when {both} then least(1e0, 0.9e0 + 0.05e0 + {share} * 0.05e0)
        when {found} >= 2 then least(0.95e0, 0.8e0 + {share} * 0.15e0)
        when {found} = 1 then least(0.9e0, 0.6e0 + {share} * 0.3e0)
        when len({low_ds}) > 0 or r.has_section then least(0.7e0, 0.4e0 + {share} * 0.3e0) else 0e0 end"""
    gib = f"(f.total_bytes / {C.GIB}::double)"
    sized = f"(i.model_id is not null and i.sha is not null and not {is_url} and f.total_bytes > 0)"
    devices = ", ".join(
        f"case when {sized} then {device_ladder(d, gib)} end as {d}" for d in C.DEVICES
    )
    github = "regexp_extract(m.code_url, '^[A-Za-z]+://[^/?#]*github\\.com[^/?#]*/+([^/?#]+)/+([^/?#]+)', {})"
    code_repo = f"{github.format(1)} || '/' || regexp_replace({github.format(2)}, '\\.git$', '')"
    return f"""select m.type, m.id, m.name, m.model_url,
      case when i.model_id is not null and not {is_url} then {round3(
          "greatest(0e0, least(1e0, case when coalesce(f.has_readme, false) or i.has_card then 1e0 else 0.3e0 end * 0.6e0"
          " + i.likes_score * 0.4e0 + case when i.has_examples then 0.1e0 else 0e0 end))")} end as ramp_up_time,
      case when i.model_id is not null and not {is_url}
        then {round3('i.popularity * 0.6e0 + i.freshness * 0.4e0')} else 0e0 end as bus_factor,
      case when m.model_id is not null then case when {is_url} then 0e0 else coalesce(r.license, 0e0) end end as license,
      case when contains(m.model_id, '/') then coalesce(c.claims, {C.NO_FILES_SCORE}::double) else 0e0 end as performance_claims,
      {devices},
      case when {code_on} and {data_on} then 1e0 when m.model_id is null or {is_url} then 0e0
        else (case when {code_on} or (i.model_id is not null and coalesce(f.has_python, false)) or coalesce(r.python_signal, false)
                then 0.5e0 else 0e0 end)
           + (case when {data_on} or (i.model_id is not null and len(coalesce(i.datasets, []::varchar[])) > 0) then 0.5e0 else 0e0 end)
        end as dataset_and_code_score,
      case when m.model_id is not null then case when r.model_id is not null and not r.blank
        then {round3(quality)} else 0e0 end end as dataset_quality,
      coalesce(q.score, {C.NO_CODE_SCORE}::double) as code_quality,
      coalesce(v.score, -1e0) as reviewedness,
      case when a.content is not null then {status('Final Response -- Status Code : ([0-9]+(?:[.][0-9]+)?)').replace('content', 'a.content')} end as reproducibility
    from (select *, {model_id('model_url')} as model_id,
        coalesce({link('model_url', False, 1)} || '/' || {link('model_url', False, 2)},
          case when contains(model_url, '{C.HUB_HOST}') then (select any_value(page_repo) from page_links l
            where l.model_id = {model_id('model_url')}) end) as review_repo from {models}) m
    left join (select * from info_scores where status_code = 200) i on i.model_id = m.model_id
    left join listing_facts f on f.model_id = m.model_id
    left join readme_facts r on r.model_id = m.model_id
    left join claims c on c.model_id = m.model_id
    left join code_quality q on q.repo = {code_repo}
    left join review_scores v on v.repo = m.review_repo
    left join responses a on a.id = m.id"""


def scored(wide: str) -> str:
    """Adds size_score (device mean), net_score, failures and admitted."""
    net, used = "0e0", "0e0"
    for m in C.METRIC_WEIGHTS:
        net = f"({net} + case when {m} is null then 0e0 else greatest({m}, 0e0) * 0.1e0 end)"
        used = f"({used} + case when {m} is null then 0e0 else 0.1e0 end)"
    return f"""select *, case when used > 0 then {round3('net / used')} else 0e0 end as net_score, failures = '' as admitted
      from (select *, {net} as net, {used} as used, {failures()} as failures
        from (select *, (((raspberry_pi + jetson_nano) + desktop_pc) + aws_server) / 4e0 as size_score from {wide}))"""


def failures() -> str:
    items = ", ".join(
        f"case when {m} is null or {m} < {C.ADMISSION_THRESHOLD} then '{m}' end"
        for m in sorted(C.METRIC_WEIGHTS)
    )
    return join_list(f"list_filter([{items}], lambda x: x is not null)")


TABLES["rated"] = rated("models")
TABLES["scored"] = scored("rated")
TABLES["rated_strict"] = rated("models", strict=True)

_REGISTRATION = """select case when p % 11 = 0 then '' when p % 12 = 0 then null when p % 13 = 0 then 'dataset'
      else type end as artifact_type,
    case when p % 17 = 0 then '' else model_url end as source_url,
    case when p % 19 <> 0 then name end as name, code_url, dataset_url from models"""
TABLES["registrations"] = f"""select *, case when coalesce(artifact_type, '') = '' or source_url = ''
    then 'Missing artifact_type or url' when name is null then 'Missing name' end as error
  from ({_REGISTRATION})"""
TABLES["registered_models"] = f"""select 'model' as type, {artifact_id('name')} as id, name, source_url as model_url, code_url, dataset_url
  from registrations where error is null and artifact_type = 'model'"""
TABLES["rated_registrations"] = rated("registered_models")
TABLES["scored_registrations"] = scored("rated_registrations")
TABLES["decisions"] = f"""select type, id, name, model_url, case when admitted then 'created' else 'rejected' end as status,
    failures, net_score, null::varchar as error from scored_registrations
  union all select artifact_type, {artifact_id('name')}, name, source_url,
    case when error is null then 'created' else 'invalid' end, '', case when error is null then 0e0 end, error
    from registrations where error is not null or artifact_type <> 'model'"""

TABLES["stored_models"] = """select type, case when p % 9 = 4 then -id else id end as id, name, model_url
  from models"""
TABLES["updates"] = """select case when p % 11 = 0 then 'code' else type end as path_type,
    id + case when p % 13 = 0 then 1 else 0 end as path_id, type, id,
    case when p % 17 = 0 then '' when p % 5 = 0 then concat(name, '-new') else name end as name,
    model_url as url, code_url, dataset_url from models"""
TABLES["checked_updates"] = """select u.*, case when path_type <> u.type or path_id <> u.id or u.name = '' then 'invalid'
    when s.id is null then 'not_found' else 'ok' end as status
  from updates u left join stored_models s on s.type = u.type and s.id = u.id"""
TABLES["updated_models"] = f"""select type, {artifact_id('name')} as id, name, url as model_url, code_url, dataset_url
  from checked_updates where status = 'ok'"""
TABLES["rated_updates"] = rated("updated_models")
TABLES["scored_updates"] = scored("rated_updates")

TABLES["document_names"] = f"select doc_id as d, {repo('doc_id')} as repo from documents"
TABLES["name_index"] = f"""select name, id::varchar as id, type, seq from artifacts
  union all select repo, ({artifact_id('repo')})::varchar, 'model', 10000000000 + 2 * d from document_names
  union all select concat(repo, ' renamed'), ({artifact_id('repo')})::varchar, 'model', 10000000001 + 2 * d
    from document_names where d % 5 = 0"""
TABLES["last_names"] = """select id, name from name_index
  qualify row_number() over (partition by id order by seq desc) = 1"""
TABLES["readmes"] = f"""select 'model' as type, {artifact_id('name')} as id, text from (select text,
    case when d % 7 = 0 then concat('ghost', d) else {repo('d')} end as name from readme_texts)"""
TABLES["logs"] = """select case when event_id % 3 = 0 then 'g0' else concat('g', user_id % 9) end as log_group, ts,
    concat(case event_type when 'signup' then 'Warning signup' else event_type end, ' ', props) as message, event_id
  from events"""
TABLES["api_requests"] = "select ts, value as latency_ms from events"
TABLES["objects"] = f"""select type, {artifact_id('name')} * case when p_size > 5 then 1 else -1 end as id,
  floor(p_retailprice * 12345)::bigint as length from parts"""
TABLES["costs"] = "select type, id, round_even(length / 1048576e0, 0)::bigint as total_cost from objects"
_GROUPS = ", ".join(f"('{g}')" for g in t.LOG_GROUPS)


def _score(metric: str) -> str:
    path = f"'$.{metric}'"
    return f"""coalesce(case json_type(results, {path}) when 'ARRAY'
        then try_cast(json_extract_string(results, '$.{metric}[0]') as double)
        when 'VARCHAR' then null else try_cast(json_extract_string(results, {path}) as double) end, 0e0)"""


def _latency(metric: str) -> str:
    return f"coalesce(try_cast(json_extract_string(results, '$.{metric}[1]') as bigint), 0)"


SCALARS = [m for m in C.METRIC_WEIGHTS if m != "size_score"]
TABLES["rating_view"] = (
    "select id, name, 'model' as category, net_score, 0::bigint as net_score_latency, "
    + ", ".join(f"{_score(m)} as {m}, {_latency(m)} as {m}_latency" for m in SCALARS)
    + f", {C.TREE_SCORE}::double as tree_score, 0::bigint as tree_score_latency, "
    + ", ".join(
        f"coalesce(try_cast(json_extract_string(results, '$.size_score[0].{d}') as double), 0e0) as {d}"
        for d in C.DEVICES
    )
    + f", {_latency('size_score')} as size_score_latency from artifacts where type = 'model'"
)


# --- queries: sources and sinks ----------------------------------------------------------

q = QUERIES
q["src_registry"] = """select type, id, name, model_url, download_url, net_score from artifacts
  where seq % 17 <> 0"""
q["src_name_index"] = """select id::varchar as id, case when seq % 2 = 0 then concat(name, ' v2') else name end as name
  from artifacts where seq % 2 = 0 or (seq % 13 <> 0 and seq % 17 <> 0 and seq % 19 <> 0)"""
q["src_readmes"] = """select type, id, case id % 4 when 0 then 'README.md' else 'docs/README.md' end as path,
  md5(text) as digest from readmes where id % 4 < 2"""
q["src_model_info"] = """select model_id, status_code, sha, downloads, likes, last_modified, array_to_string(tags, '|') as tags,
  has_card, case when has_card then array_to_string(datasets, '|') end as datasets,
  case when status_code = 200 then (case when sha is null then 1 else 2 end)::bigint end as files,
  case when status_code = 200 then 1::bigint end as last_ord,
  case when status_code = 200 then greatest(likes::varchar, downloads) end as content_length from model_info"""
q["src_pr_activity"] = """select repo, 'prs' as kind, count(*) as n, (count(*) filter (where merged))::bigint as total
    from prs where number % 50 <> 0 group by repo
  union all select repo, 'reviews', count(*), sum(review_id)::bigint from pr_reviews where number % 50 <> 0 group by repo
  union all select repo, 'files', count(*), sum(additions)::bigint from pr_files where number % 50 <> 0 group by repo"""
q["src_code_files"] = """select repo, kind, name, concat('./', name) as path, status_code, md5(text) as digest
  from code_files where ord % 7 <> 0"""
_CANDIDATES = ", ".join(f"({text(f)})" for f in C.REPO_FILES)
q["src_repo_subset"] = f"""select n.repo, f.file, md5(coalesce(p.text, '')) as digest
  from document_names n cross join (values {_CANDIDATES}) f(file)
  left join picked p on p.repo = n.repo and p.file = f.file"""
q["src_landed_readme"] = f"""select n.model_id, md5(coalesce(m.text, '')) as digest from (select
    case when p % 10 = 9 then concat('model', p) else {repo('p')} end as model_id from parts) n
  left join main_readmes m on m.model_id = n.model_id"""
q["src_logs"] = f"""select log_group, event_id, message, epoch_us(ts) as ts_us from logs
  where ts between timestamp '{catalog.LOG_START}' and timestamp '{catalog.LOG_END}' and log_group not in ('g8', 'g9')"""
q["src_api_requests"] = f"""select epoch_us(ts) as ts_us, latency_ms from api_requests
  where ts between timestamp '{catalog.LOG_START}' and timestamp '{catalog.LOG_END}'"""
q["src_object_sizes"] = """select type, id, (strlen(name) + 1)::bigint as length from artifacts"""
q["snk_upsert_registry"] = """select type, id, name, case when type = 'model' then net_score / 2 else net_score end as net_score,
  seq + case when type = 'model' then 1000000000 else 0 end as seq from artifacts where net_score <= 0.9e0"""
q["snk_base_and_changes"] = """select type, id, name, case when type = 'model' then net_score / 2 else net_score end as net_score,
  case when type = 'model' then 3 else 1 end::bigint as at, seq as place from artifacts where net_score <= 0.9e0"""
q["snk_append_index"] = """select id::varchar as id, case when seq % 2 = 0 then concat(name, ' v2') else name end as name
  from artifacts"""
q["snk_store_readme"] = """select 'model' as type, d as id, case d % 4
    when 0 then case when d % 3 <> 0 then concat('docs/ReadMe_', d) else 'README.md' end
    else case when d % 8 = 1 then 'README.rst' else 'README' end end as path, md5(text) as digest
  from readme_texts where d % 11 <> 0 and d % 4 <> 3 and not (d % 4 = 0 and d % 3 = 0 and d % 9 = 0)
    and not (d % 12 = 2 and d % 4 in (1, 2))"""
TABLES["delete_keys"] = """select type, id from artifacts where type = 'dataset'
  union all select type, -id from artifacts where type = 'dataset'"""
q["snk_delete_artifacts"] = """select type, id, 'remaining' as outcome from artifacts where type <> 'dataset'
  union all select type, -id, 'not_found' from artifacts where type = 'dataset'"""
q["snk_prune_index"] = """select name, id, type from name_index i where not exists
  (select 1 from delete_keys k where k.id::varchar = i.id and k.type = i.type)"""
q["snk_reset"] = """select type, id, name, net_score / 2 as net_score, seq + 1000000000 as seq from artifacts
  where type = 'model' and net_score <= 0.9e0"""

# --- queries: filters and projections ----------------------------------------------------

q["flt_types"] = "select name, id, type from artifacts where type in ('model', 'code')"
q["flt_name_exact"] = f"""select name, id, type from artifacts
  where id = {artifact_id("'red widget 1'")} and type in ('dataset', 'code')"""
q["flt_wildcard"] = "select name, id, type from artifacts"
q["flt_artifact_by_key"] = """select type, id, case when model_url = '' then 'malformed' else 'ok' end as status,
    case when model_url <> '' then name end as name, case when model_url <> '' then model_url end as url,
    case when model_url <> '' then download_url end as download_url from artifacts
  union all select concat(type, 's'), id, 'not_found', null, null, null from artifacts"""
q["flt_registration_valid"] = "select * from registrations"
q["flt_upload_valid"] = """select seq, artifact_type, model_url, net_score,
    case when artifact_type = '' or model_url = '' or seq % 11 = 0 or net_score is null
      then 'Missing one or more required fields' end as error
  from (select seq, model_url, case when seq % 7 = 0 then '' else type end as artifact_type,
    case when seq % 13 <> 0 then net_score end as net_score from artifacts)"""
q["flt_update_valid"] = "select path_type, path_id, type, id, name, status from checked_updates"
q["flt_regex_name"] = f"""select name, id, type from name_index
  where regexp_matches(name, {text(catalog.NAME_PATTERN)}, 'i')"""
q["flt_regex_readme"] = f"""select type, id::varchar as id from readmes
  where regexp_matches(text, {text(catalog.README_PATTERN)}, 'i')"""


def guard(pattern: str) -> str:
    nested = " or ".join(matches(pattern, n) for n in C.NESTED_QUANTIFIERS)
    bounds = f"regexp_extract_all({pattern}, '\\{{\\d+,(\\d+)\\}}', 1)"
    groups = f"regexp_extract_all({pattern}, '\\(([^)]+)\\)[*+]', 1)"
    return f"""case when {nested} then {text(C.REASON_NESTED)}
      when len(list_filter({bounds}, lambda b: b::hugeint > {C.MAX_REPEAT})) > 0 then {text(C.REASON_REPEAT)}
      when len(list_filter({groups}, lambda g: len(list_filter(string_split(g, '|'), lambda a:
        len(list_filter(string_split(g, '|'), lambda b: a <> b and starts_with(a, b))) > 0)) > 0)) > 0
        then {text(C.REASON_AMBIGUOUS)} end"""


TABLES["derived_patterns"] = """select p as p_partkey, case p % 9 when 0 then concat('(a', p, ')+')
    when 1 then concat('x{1,', p, '}') when 2 then concat('(b|b', p, ')*') when 3 then concat('(', p_name, '+)*')
    when 4 then concat('(.*', p, ')? +') when 5 then concat('(', p_name, ')+ ?') when 6 then concat('(', p, '|5)+')
    when 7 then concat('(a', p, ')+?') else p_name end as regex from parts"""
q["flt_safe_patterns"] = f"select p_partkey, regex, {guard('regex')} as reason from derived_patterns"
q["flt_weight_files"] = f"select model_id, ord, rfilename from siblings where {IS_WEIGHT}"
q["flt_min_size"] = f"select model_id, ord, size_bytes from siblings where size_bytes >= {C.MIN_WEIGHT_BYTES}"
q["flt_python_files"] = "select repo, ord, name from python_files"
q["flt_binary_ext"] = "select * from source_files"
q["flt_merged_prs"] = "select repo, number from prs where merged"
q["flt_log_level"] = """select log_group, event_id, 'error' as level from logs where contains(lower(message), 'error')
  union all select log_group, event_id, 'warning' from logs where contains(lower(message), 'warn')"""
TABLES["wide_results"] = "select type, id, " + ", ".join(
    f"max(case when metric = '{m}' then score end) as {m}" for m in C.METRIC_WEIGHTS
) + " from metric_results group by type, id"
TABLES["gated"] = f"select type, id, case when type = 'model' then {failures()} else '' end as failures from wide_results"
q["flt_admission_gate"] = "select type, id, failures = '' as admitted, failures from gated"
q["prj_rating_view"] = "select * from rating_view"
q["prj_subscores"] = " union all ".join(
    f"select id, '{m}' as key, {m} as value from rating_view" for m in [*SCALARS, "tree_score"]
)
q["prj_listing"] = "select name, id, type from artifacts"
q["prj_device_map"] = " union all ".join(
    f"select id, '{d}' as device, {d} as score from rating_view" for d in C.DEVICES
)

# --- queries: joins ----------------------------------------------------------------------

q["join_readme_name"] = f"""select coalesce(n.name, '{C.UNKNOWN_NAME}') as name, r.id::varchar as id, r.type
  from readmes r left join last_names n on n.id = r.id::varchar"""
q["join_pr_reviews"] = """select p.repo, p.number, exists (select 1 from pr_reviews v
  where v.repo = p.repo and v.number = p.number) as reviewed from prs p"""
q["join_pr_files"] = "select f.* from prs p join pr_files f on f.repo = p.repo and f.number = p.number"
q["join_registry_info"] = f"""select m.id, m.model_id, case when i.model_id is not null then true end as has_info,
    case when i.model_id is not null then i.sha is not null end as has_sha,
    {round3('i.likes_score')} as likes_score, i.has_card, i.has_examples, {round3('i.popularity')} as popularity,
    {round3('i.freshness')} as freshness, lower(array_to_string(i.datasets, '|')) as datasets,
    f.total_bytes, f.has_readme, f.has_python, r.blank, r.license, r.python_signal,
    case when r.model_id is not null then {join_list('r.trusted')} end as trusted, r.quality_hits, r.has_section,
    c.claims, l.page_repo
  from (select id, {model_id('model_url')} as model_id from models) m
  left join (select * from info_scores where status_code = 200) i on i.model_id = m.model_id
  left join listing_facts f on f.model_id = m.model_id left join readme_facts r on r.model_id = m.model_id
  left join claims c on c.model_id = m.model_id
  left join (select model_id, coalesce(page_repo, '') as page_repo from page_links) l on l.model_id = m.model_id"""
q["join_details"] = """select a.type, a.id, a.name, coalesce(case when a.type = 'model' then a.net_score::varchar end, 'N/A') as rating,
    concat(coalesce(c.total_cost::varchar, 'N/A'), ' MB') as cost
  from artifacts a left join costs c on c.type = a.type and c.id = a.id"""
q["join_update_exists"] = """select u.type, u.id, s.id is not null as found
  from updates u left join stored_models s on s.type = u.type and s.id = u.id"""
q["join_keys_lookup"] = """select a.type, a.id, c.total_cost, case when c.id is null then 'not_found' else 'ok' end as status
    from artifacts a left join costs c on c.type = a.type and c.id = a.id
  union all select concat(type, 's'), id, null, 'not_found' from artifacts"""
_PATTERNS = ", ".join(f"({i}, {text(p)})" for i, p in t.PATTERNS)
q["join_patterns_theta"] = f"""select d, pattern_id from (select d, text from readme_texts
    union all select -1 - seq, name from artifacts) x
  join (select * from (values {_PATTERNS}) v(pattern_id, regex) where {guard('regex')} is null) p
    on regexp_matches(x.text, p.regex, 'i')"""
TABLES["pattern_table"] = """select c_custkey::int as pattern_id, case c_custkey % 6
      when 0 then concat('(ring|bolt) ', c_custkey % 100, '$') when 1 then concat('^Small .* ', c_custkey)
      when 2 then concat('gear [0-9]*', c_custkey % 10, 'x?$') when 3 then concat('(', c_custkey, '+)+')
      when 4 then concat('(red|blue|', c_custkey, ') widget') else concat('[0-9]{2}', c_custkey % 10) end as regex
  from customer"""
q["join_pattern_table"] = f"""select seq as d, pattern_id from artifacts
  join (select * from pattern_table where {guard('regex')} is null) on regexp_matches(name, regex, 'i')"""
q["join_keywords"] = f"""select d, unnest({words_found('lower(text)', C.TRUSTED_DATASETS + C.QUALITY_WORDS)}) as word
  from readme_texts"""

# --- queries: aggregations ---------------------------------------------------------------

q["agg_net_score"] = f"""select type, id, net_score from ({scored(
    "(select *, size_score as raspberry_pi, size_score as jetson_nano, size_score as desktop_pc, size_score as aws_server "
    "from wide_results)").replace("(select *, (((raspberry_pi + jetson_nano) + desktop_pc) + aws_server) / 4e0 as size_score from", "(select * from")})"""
q["agg_device_mean"] = "select type, id, score as mean from metric_results where metric = 'size_score'"
q["agg_total_weight_bytes"] = "select model_id, total_bytes from listing_facts where total_bytes is not null"
q["agg_reviewedness"] = "select repo, score from review_scores"
q["agg_code_quality"] = f"select repo, {round3('score')} as score from code_quality"
q["agg_keyword_hits"] = f"""select d, hits, least(1e0, hits / 4e0) as share from
  (select d, len({words_found('lower(text)', C.QUALITY_WORDS)})::int as hits from readme_texts)"""
q["agg_distinct_trusted"] = f"""select d, len(f)::int as n, {join_list('list_sort(f)')} as found from
  (select d, {words_found('lower(text)', C.TRUSTED_DATASETS)} as f from readme_texts)"""
TABLES["log_counts"] = f"""select g.log_group, count(l.event_id) as total,
    count(l.event_id) filter (where contains(lower(message), 'error')) as errors,
    count(l.event_id) filter (where contains(lower(message), 'warn')) as warnings
  from (values {_GROUPS}) g(log_group) left join logs l on l.log_group = g.log_group group by g.log_group"""
q["agg_log_counts"] = "select * from log_counts"


def latest(period: str) -> str:
    bucket = f"time_bucket(interval '{period}', {{}}, timestamp '1970-01-01')"
    newest = bucket.format("(select max(ts) from api_requests)")
    return f"(select * from api_requests where {bucket.format('ts')} = {newest})"


q["agg_latency_avg_latest"] = " union all ".join(
    f"select '{p}' as period, round(sum(latency_ms::decimal(28, 6))::double / count(*), 6) as avg_latency_ms from {latest(p)}"
    for p in catalog.PERIODS
)
q["agg_latency_pctl_latest"] = " union all ".join(
    f"select '{p}' as period, {f}::double as fraction, round(quantile_cont(latency_ms, {f}), 6) as latency_ms from {latest(p)}"
    for p in catalog.PERIODS
    for f in (0.95, 0.99)
)
q["agg_request_count"] = "select count(*) as total_requests from api_requests"
TABLES["period_stats"] = """select epoch_us(time_bucket(interval '5 minutes', ts, timestamp '1970-01-01')) as period_us,
  count(*) as requests, round(sum(latency_ms::decimal(28, 6))::double / count(*), 6) as avg_latency_ms
  from api_requests group by 1"""
q["agg_period_stats"] = "select * from period_stats"
q["agg_health_status"] = """select 'all' as lines, case when count(*) = 0 or
    bool_or(contains(lower(message), 'error')) then 'DEGRADED' else 'OK' end as status from logs
  union all select 'quiet', case when (select count(*) from api_requests) = 0 then 'DEGRADED' else 'OK' end"""
q["agg_cost_mb"] = "select * from costs"
q["agg_last_wins"] = "select * from last_names"

# --- queries: windows, sorts, limits, sets -----------------------------------------------

TABLES["recent_errors"] = f"""select log_group, (row_number() over (partition by log_group order by ts desc, event_id desc))::int as rank,
    event_id, message from logs where contains(lower(message), 'error') qualify rank <= {C.RECENT_ERRORS}"""
q["win_recent_errors"] = "select * from recent_errors"
q["win_recent_prs"] = "select repo, number from recent_prs"
q["win_first_files"] = f"""select repo, ord from python_files where status_code = 200
  qualify row_number() over (partition by repo order by ord) <= {C.MAX_CODE_FILES}"""
q["win_first_nonblank"] = f"""select repo, file, md5(text) as digest from picked
  where trim(text, E' \\t\\n\\r') <> '' and {_PRIORITY} is not null
  qualify row_number() over (partition by repo order by {_PRIORITY}) = 1"""
q["win_first_sibling"] = """select p as p_partkey, case when p % 3 = 0 then concat('docs/ReadMe_', p, '.txt')
  when p % 5 <> 0 then 'README.md' end as readme, p % 2 = 0 as has_python from parts"""
q["win_running_cap"] = f"""select model_id, ord, size_bytes, running_before::bigint as running_before from (
    select *, coalesce(sum(size_bytes) over (partition by model_id order by ord, size_bytes
      rows between unbounded preceding and 1 preceding), 0) as running_before from siblings where {COUNTED})
  where running_before < {C.WEIGHT_CAP_BYTES}"""
q["win_latest_period"] = "select * from period_stats order by period_us desc limit 1"


def expand(types: list[str], source: str = "artifacts") -> str:
    values = ", ".join(f"({i}, '{x}')" for i, x in enumerate(types))
    return f"select a.name, a.id, a.type, w.i::int as type_rank from {source} a join (values {values}) w(i, type) on w.type = a.type"


q["lim_page"] = f"""select name, id, type, type_rank, case when n > 90 then 90::bigint end as next_offset from
  (select *, count(*) over () as n from ({expand(['dataset', 'model'])}))
  order by type_rank, id::varchar limit 50 offset 40"""
q["lim_page_ranked"] = f"""select name, id, type, type_rank, case when n > 120 then 120::bigint end as next_offset from
  (select *, count(*) over () as n from ({expand(['dataset', 'model'])}))
  order by type_rank, id::varchar limit 50 offset 70"""
q["lim_page_keyset"] = f"""select * from ({expand(['dataset', 'model'])})
  where type_rank > 0 or id::varchar > '5' order by type_rank, id::varchar limit 50"""
q["lim_log_result"] = f"select log_group, event_id, message from logs order by ts desc, event_id desc limit {C.LOG_RESULT_CAP}"
q["srt_recent"] = "select repo, number from prs order by updated_at desc, number desc"


def search(pattern: str) -> str:
    return f"""select name, id, type, 'name' as hit_source from name_index where regexp_matches(name, {text(pattern)}, 'i')
      union all select coalesce(n.name, '{C.UNKNOWN_NAME}'), r.id::varchar, r.type, 'readme'
        from readmes r left join last_names n on n.id = r.id::varchar where regexp_matches(r.text, {text(pattern)}, 'i')"""


q["set_union_search"] = f"""select type, id, max(name) as name, min(hit_source) as hit_source
  from ({search('org5/|accuracy')}) group by type, id"""
q["set_union_types"] = expand(["code", "model", "code"])
q["set_superset"] = """select d, contains(lower(text), 'bookcorpus') and contains(lower(text), 'wikipedia') as strong
  from readme_texts"""
q["set_difference"] = "select repo, ord, case when program = 1 then 'os' else '' end as unused from python_files"

# --- queries: scalar functions -----------------------------------------------------------

q["scl_artifact_id"] = f"select doc_id, {artifact_id('text')} as id from documents"
TABLES["urls"] = f"""select p_partkey, {catalog.URL_FORMS} as url
  from (select p_partkey, {repo('p_partkey')} as name from part)"""
q["scl_model_id"] = f"select p_partkey, {model_id('url')} as model_id from urls"
q["scl_detect_source"] = """select p_partkey, case when contains(url, 'huggingface.co') then 'huggingface'
  when contains(url, 'github.com') then 'github' end as source from urls"""
_PATH = "trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')"
q["scl_repo_type"] = f"""select p_partkey, case when parts[1] = 'datasets' then 'dataset' else 'model' end as repo_type,
    coalesce(array_to_string(case when parts[1] = 'datasets' then parts[2:3] else parts[1:2] end, '/'), '') as repo_id
  from (select p_partkey, string_split({_PATH}, '/') as parts from urls)"""
_GH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*github[.]com[^/?#]*/+([^/?#]+)/+([^/?#]+)', {})"
_ARCHIVE = "regexp_extract(url, '^https?://github[.]com/([^/]+)/([^/]+)', {})"
q["scl_github_repo"] = f"""select p_partkey, nullif({_GH.format(1)}, '') as owner,
    nullif(regexp_replace({_GH.format(2)}, '[.]git$', ''), '') as repo,
    nullif({_ARCHIVE.format(1)}, '') as archive_owner, nullif({_ARCHIVE.format(2)}, '') as archive_repo from urls"""
q["scl_extract_repo_link"] = f"""select model_id, {link('html', True, 1)} as owner, {link('html', True, 2)} as repo,
    {link('html', False, 1)} as first_owner, regexp_replace({link('html', False, 2)}, '[.]git$', '') as first_repo
  from html_pages"""
q["scl_source_url"] = """select name, concat('https://huggingface.co/', name, '/raw/main/README.md') as raw_url,
    concat('https://github.com/', name, '/archive/refs/heads/main.zip') as archive_url,
    concat('https://huggingface.co/api/models/', name) as api_url from models"""
q["scl_popularity"] = "select model_id, round(popularity, 9) as popularity from info_scores"
q["scl_likes"] = "select model_id, round(likes_score, 9) as likes_score from info_scores"
q["scl_freshness"] = "select model_id, round(freshness, 9) as freshness from info_scores"
q["scl_license_text"] = "select d, md5(license_text) as digest from license_texts"
TABLES["plain_parts"] = """select d, string_split(regexp_replace(lower(text), '\\n(#{1,6}\\s)', chr(1) || '\\1', 'g'), chr(1)) as parts
  from readme_texts"""
q["scl_sections"] = f"""select d, len(secs)::int as n, md5({join_list('secs')}) as digest from (select d,
    list_filter(parts, lambda s: regexp_matches(regexp_extract(s, '^[^\\n]*'), {text(C.CLAIM_HEADING)})) as secs from plain_parts)"""
q["scl_dataset_section"] = "select d, section from data_sections"
TABLES["number_texts"] = f"select d, {ascii_letters('text')} as s0 from readme_texts"
q["scl_number_positions"] = f"select d, start::int as start, token from ({numbers('number_texts', 's0')})"
TABLES["near_docs"] = near("claim_texts", "low")
q["scl_near_metric"] = "select d, d in (select d from near_docs) as near from claim_texts"
q["scl_metric_table"] = f"select d, {metric_table('low')} as has_table from claim_texts"
q["scl_placeholder"] = f"select d, {any_word('lower(text)', C.PLACEHOLDER_WORDS)} as placeholder from readme_texts"
q["scl_yaml_metric"] = f"select d, {yaml_metric('low')} as yaml from claim_texts"
q["scl_python_signal"] = f"select d, {any_word('lower(text)', C.PYTHON_SIGNALS)} as signal from readme_texts"
q["scl_examples_tag"] = "select model_id, has_examples from info_scores"
q["scl_doc_present"] = """select p as p_partkey, case when p % 5 <> 0 or p % 4 = 0 then 1e0 else 0.3e0 end as doc_score
  from parts"""
q["scl_size_bytes"] = "select model_id, ord, size_bytes from siblings"
q["scl_device_buckets"] = "select l_orderkey, l_linenumber, l_partkey, total_bytes, " + ", ".join(
    f"case when total_bytes > 0 then {device_ladder(d, f'(total_bytes / {C.GIB}::double)')} end as {d}" for d in C.DEVICES
) + """ from (select l_orderkey, l_linenumber, l_partkey,
    floor(l_extendedprice * 1000000 * (l_partkey % 3))::bigint as total_bytes from lineitem)"""
q["scl_status_code"] = f"""select id, {status('Final Response -- Status Code : ([0-9]+(?:[.][0-9]+)?)')} as status,
    {status('Final Response -- Status Code[ ]*:[ ]*([0-9]+(?:[.][0-9]+)?)')} as lenient_status from responses"""
q["scl_link_pair"] = """select p as p_partkey, case when p % 5 <> 0 then concat('https://github.com/a/b', p) end as code_url,
  case when p % 5 <> 0 then ' NULL' end as dataset_url from parts"""
q["scl_score_clamp"] = f"""select id, metric, {round3('greatest(s / 7, 0e0)')} as clamped from (
    select id, metric, s from raw_results where metric <> 'size_score' and s is not null)
  union all select id, metric, null from raw_results where metric = 'size_score' or s is null"""
q["scl_trust_band"] = """select id, case when net_score < 0.3e0 then 'low' when net_score < 0.7e0 then 'moderate'
  else 'strong' end as band from artifacts"""
q["scl_mb_label"] = """select a.id, concat(coalesce(c.total_cost::varchar, 'N/A'), ' MB') as label
  from artifacts a left join costs c on c.type = a.type and c.id = a.id"""

# --- queries: metrics --------------------------------------------------------------------


def metric_rows(metric: str, wide: str = "rated") -> str:
    if metric == "size_score":
        score, devices = "null::double", ", ".join(C.DEVICES)
    else:
        score, devices = round3(metric), ", ".join(f"null::double as {d}" for d in C.DEVICES)
    return f"select type, id, '{metric}' as metric, {score} as score, {devices}, 0::bigint as latency_ms from {wide}"


for _key, _metric in {
    "met_ramp_up_time": "ramp_up_time",
    "met_bus_factor": "bus_factor",
    "met_license": "license",
    "met_performance_claims": "performance_claims",
    "met_size_score": "size_score",
    "met_dataset_and_code": "dataset_and_code_score",
    "met_dataset_quality": "dataset_quality",
    "met_code_quality": "code_quality",
    "met_reviewedness": "reviewedness",
    "met_reproducibility": "reproducibility",
}.items():
    q[_key] = metric_rows(_metric)
q["met_all"] = (
    "select type, id, name, "
    + ", ".join(f"{round3(m)} as {m}" for m in C.METRIC_WEIGHTS)
    + ", net_score, admitted, failures from scored"
)
q["met_all_known"] = q["met_all"]
TABLES["learnable"] = f"""select 'texts' as kind, text, regexp_matches(repo, '[02468]$') as even
  from repo_files where status_code = 200 and length(text) > 0
  union all select 'sources', text, regexp_matches(repo, '[02468]$')
  from (select * from python_files where status_code = 200
    qualify row_number() over (partition by repo order by ord) <= {C.MAX_CODE_FILES})"""
q["agg_learned_texts"] = """select step, kind, case step when 0 then half when 1 then whole - half else 0 end as judged
  from (select kind, count(distinct text) filter (where even) as half, count(distinct text) as whole
    from learnable group by kind), (select unnest([0, 1, 2]) as step)"""
q["met_all_long"] = " union all ".join(
    metric_rows(m, "rated_strict") for m in C.METRIC_WEIGHTS
)
q["udf_code_facts"] = """select repo, ord, program <> 2 as valid, case program when 2 then 0 else 1 end as functions,
    case program when 1 then 1 else 0 end as undocumented, case program when 1 then 2e0 else 0e0 end as complexity,
    case program when 3 then 1 else 0 end as globals, case program when 1 then 1 else 0 end as risky,
    case program when 1 then 'os|sys' else '' end as imports,
    case program when 0 then 'x' when 1 then 'eval|sys|x' when 3 then 'g' else '' end as names,
    long_lines::int as long_lines from python_files"""
q["udf_code_score"] = f"select repo, ord, {round3('score')} as score from code_scores"
q["udf_registry"] = f"""select type, id, 'bus_factor' as metric, {round3('bus_factor')} as score from rated
  union all select type, id, 'name_length', {round3('least(1e0, length(name) / 20e0)')} from models
  union all select type, id, 'broken', null from models"""
q["udf_rows"] = f"""select type, id, 'picky' as metric, case when name not like '%7' then {round3('length(name) / 40e0')} end as score,
    case when name like '%7' then concat('ValueError: no score for ', name) end as error from models"""

# --- queries: end to end -----------------------------------------------------------------

TABLES["named"] = f"select * from artifacts where id = {artifact_id(text('red widget 1'))}"
_LISTED = f"""select name, id, type, type_rank from ({expand(['dataset', 'model'])})
      union all select name, id, type, type_rank + 2 from ({expand(['model', 'dataset', 'code'], 'named')})
      union all select name, id, type, type_rank + 5 from ({expand(['model', 'dataset', 'code'])})"""
q["e2e_list"] = f"""select name, id, type, type_rank, case when n > 100 then 100::bigint end as next_offset from (
    select *, count(*) over () as n from ({_LISTED}))
  order by type_rank, id::varchar limit 50 offset 50"""
q["e2e_list_after"] = f"""select name, id, type, type_rank from ({_LISTED})
  where type_rank > 1 or (type_rank = 1 and id::varchar > '5') order by type_rank, id::varchar limit 50"""
q["e2e_search"] = search("(small|blue) (ring|bolt)|apache|evaluation results")


TABLES["readme_names"] = """select concat(case when d % 8 = 2 then 'github.com/' else 'huggingface.co/' end, repo) as key,
    case when d % 8 = 2 then case when d % 16 = 10 then 'README.rst' else 'README' end
      when d % 9 = 0 then null when d % 10 = 1 then concat('docs/ReadMe_', d) else 'README.md' end as file, text
  from readme_texts join document_names using (d) where d % 37 <> 0 and not (d % 8 = 2 and d % 24 = 2)"""


def readme_key(url: str) -> str:
    return f"""case when {url} like 'https://github.com/%' then regexp_extract({url}, '^https://(.*)[.]git$', 1)
      when {url} like 'https://huggingface.co/%' then regexp_extract({url}, '^https://([^/]+/[^/]+/[^/]+)', 1) end"""


def stored(records: str, ratings: str) -> str:
    """Records (type, id, name, model_url, net_score, fresh) as read back; fresh ones were rated and may have a README."""
    scores = ", ".join(
        f"case when d.type = 'model' then coalesce({round3('r.' + m)}, 0e0) end as {m}"
        for m in (*[m for m in C.METRIC_WEIGHTS if m != "size_score"], *C.DEVICES)
    )
    return f"""select d.type, d.id, d.name, d.model_url, d.net_score, d.name as index_name,
      case when fresh and m.file is not null then concat('artifacts/', d.type, '/', d.id, '/', m.file) end as readme,
      {scores}
      from ({records}) d left join {ratings} r on fresh and d.type = 'model' and r.id = d.id
      left join readme_names m on m.key = {readme_key('d.model_url')}"""


q["e2e_rate_and_register"] = stored(
    "select type, id, name, model_url, net_score, true as fresh from decisions where status = 'created'",
    "rated_registrations",
)
q["e2e_update"] = stored(
    """select type, id, name, model_url, net_score, true as fresh from scored_updates where admitted
    union all select type, id, name, model_url, null, false from stored_models s
    where not exists (select 1 from scored_updates u where u.admitted and u.type = s.type and u.id = s.id)""",
    "rated_updates",
)
TABLES["run_registrations"] = f"""select *, case when place % 2 = 0 then 'even' else 'odd' end as run,
    (1 + place % 2)::bigint as run_number
  from (select artifact_type as type, {artifact_id('name')} as id, name, source_url,
          regexp_extract(name, '[0-9]+$')::bigint as place from registrations where error is null)"""
q["e2e_register_runs"] = f"""select 'index' as stored, run, run_number, place, type, id, name as text from run_registrations
  union all select 'changes', run, run_number, place, type, id, concat('put:', source_url) from run_registrations
  union all select 'readmes', run, run_number, place, type, id, concat('artifacts/', type, '/', id, '/', file, ':', md5(text))
  from run_registrations join readme_names m on m.file is not null and m.key = {readme_key('source_url')}"""
q["flt_regex_readme_indexed"] = q["flt_regex_readme"]
q["e2e_search_stored"] = f"""select name, id::varchar as id, type, 'name' as hit_source from run_registrations
    where regexp_matches(name, 'model1[0-5]', 'i')
  union all select name, id::varchar, type, 'readme'
  from run_registrations join readme_names m on m.file = 'README.md' and m.key = {readme_key('source_url')}
  where regexp_matches(text, 'licen[cs]e|evaluation results|model1[0-5]', 'i')"""
q["e2e_decisions"] = """select *, 'registration' as request from decisions
  union all select type, id, name, model_url, case when admitted then 'created' else 'rejected' end as status,
    failures, net_score, null::varchar as error, 'update' from scored_updates
  union all select type, id, name, url, status, '', null, null, 'update' from checked_updates where status <> 'ok'"""
q["e2e_blank_search"] = f"""select name, id, type, case when n > 50 then 50::bigint end as next_offset from
  (select *, count(*) over () as n from ({expand(['model', 'dataset', 'code'])})) order by type_rank, id::varchar limit 50"""
_HOUR = "ts between timestamp '2024-01-05 12:00:00' and timestamp '2024-01-15 12:00:00'"


def windowed(sql: str) -> str:
    """The same SQL over the ten days before the report."""
    return sql.replace("from api_requests", f"from (select * from api_requests where {_HOUR})")


_LATEST = windowed(latest("5 minutes"))
q["e2e_health"] = f"""select case when r.n = 0 or max(c.errors) over () > 0 then 'DEGRADED' else 'OK' end as status,
    coalesce(round(r.mean, 6), 0e0) as avg_latency_ms, coalesce(round(r.p95, 6), 0e0) as p95_latency_ms,
    coalesce(round(r.p99, 6), 0e0) as p99_latency_ms, r.n as total_requests, c.log_group as name, c.total, c.errors, c.warnings,
    coalesce(e.recent_errors, '') as recent_errors
  from ({TABLES['log_counts'].replace('left join logs l', f'left join (select * from logs where {_HOUR}) l')}) c
  left join (select log_group, string_agg(message, '|' order by ts desc, event_id desc) as recent_errors from
      (select * from logs where {_HOUR} and contains(lower(message), 'error')
       qualify {last_error(C.RECENT_ERRORS)}) group by log_group) e on e.log_group = c.log_group,
  (select (select sum(latency_ms::decimal(28, 6))::double / count(*) from {_LATEST}) as mean,
     (select quantile_cont(latency_ms, 0.95) from {_LATEST}) as p95,
     (select quantile_cont(latency_ms, 0.99) from {_LATEST}) as p99,
     (select count(*) from api_requests where {_HOUR}) as n) r"""


def stream_counts(start: str, source: str, hours: str) -> str:
    return f"""select epoch_us({start}) as start_us, epoch_us({start} + interval '{hours}') as end_us, log_group, count(*) as total,
      count(*) filter (where contains(lower(message), 'error')) as errors,
      count(*) filter (where contains(lower(message), 'warn')) as warnings from {source} group by 1, 2, 3"""


_BUCKET = "time_bucket(interval '5 minutes', ts, timestamp '1970-01-01')"
q["stream_health"] = stream_counts(_BUCKET, "logs", "5 minutes")
q["stream_health_hour"] = stream_counts(
    "s", f"(select *, {_BUCKET} - to_minutes(5 * j) as s from logs, range(12) r(j))", "1 hour"
)
_LATENCIES = """select {cells}::int as cells, epoch_us(s) as start_us, count(*) as requests,
    round(sum(value::decimal(28, 6))::double / count(*), 6) as avg_latency_ms,
    round(quantile_disc(value, 0.95), 6) as p95_latency_ms
  from (select value, {bucket} - to_minutes(5 * j) as s from events, range({cells}) r(j)) group by s"""
q["stream_latency"] = " union all ".join(_LATENCIES.format(cells=n, bucket=_BUCKET) for n in (1, 12))
q["stream_register"] = f"""select type, id, name, model_url, net_score, index_name, readme from ({q["e2e_rate_and_register"]})"""


# --- assembly ----------------------------------------------------------------------------


def _needed(sql: str, found: list[str]) -> list[str]:
    """Names of the derived tables a statement uses, dependencies first."""
    words = set(re.findall(r"\b(?:from|join)\s+([a-z_]+)\b", sql))
    for name, body in TABLES.items():
        if name in words and name not in found:
            _needed(body, found)
            if name not in found:
                found.append(name)
    return found


def statement(sql: str) -> str:
    names = _needed(sql, [])
    ctes = ", ".join(f"{n} as ({TABLES[n]})" for n in names)
    return f"with {ctes} {sql}" if names else sql


def queries() -> dict[str, str]:
    return {key: statement(sql) for key, sql in QUERIES.items()}
