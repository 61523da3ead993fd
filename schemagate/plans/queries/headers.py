"""Queries of header matching: every twelve parts make one file, each part a header of it."""

from pyspark.sql import functions as F

from schemagate.functions.headers import HEADER_HINTS, HEADER_WORDS, LETTER_GROUPS, LETTERS_FROM, LETTERS_TO, header_row_score, normalize_header
from schemagate.operators import headers as op
from schemagate.plans.queries.base import load, query, quoted, sql_strip
from schemagate.profiles import load_profile

BUDGET = load_profile("budget_execution_v1")
TARGETS = BUDGET.targets

# Ways in which files spell their headers; the size of the part picks one.
SPELLINGS = (
    "Period", " Отдел ", "Budget-Line", "Описание", "Planned Amt", "Изпълнена сума", "Remaining Amount!", "Execution %", "CURRENCY",
    "Статус", "Responsible_Person", "Notes 2025", "Дата", "Номер", "period", "Planned  Amount", "Executed (Amount)", "Dept", "Код", "№",
    "Състояние", "execution percentage", "De\u0301ja\u0300 vu", "Цена / Брой",
)
HEADER = (
    "case mod(p_size * 7 + p_partkey * 5, 24) " + " ".join(f"when {i} then {quoted(s)}" for i, s in enumerate(SPELLINGS))
    + " end || case when mod(p_size, 10) = 3 then ' ' || p_type when mod(p_size, 10) = 6 then '  ' || p_name else '' end"
)
HEADERS_SQL = f"select cast(floor(p_partkey / 12) as bigint) as file_id, mod(p_partkey, 12)::int as position, {HEADER} as header from part"


def header_table(spark, sf):
    return load(spark, sf, "part").selectExpr(
        "cast(floor(p_partkey / 12) as bigint) as file_id", "cast(mod(p_partkey, 12) as int) as position", f"{HEADER} as header"
    )


def sql_normalize(expr: str) -> str:
    out = rf"regexp_replace(lower({sql_strip(expr)}), '\pM', '', 'g')"
    for word, replacement in HEADER_WORDS:
        if word != replacement:
            out = f"replace({out}, {quoted(word)}, {quoted(replacement)})"
    out = f"translate({out}, '{LETTERS_FROM}', '{LETTERS_TO}')"
    for letter, replacement in LETTER_GROUPS:
        out = f"replace({out}, '{letter}', '{replacement}')"
    out = rf"regexp_replace({out}, '[^\pL\pN_\s]', ' ', 'g')"
    return rf"trim(regexp_replace({sql_strip(out)}, '\s+', '_', 'g'), '_')"


@query(f"select file_id, position, header, {sql_normalize('header')} as normal from ({HEADERS_SQL})")
def header_normalize(spark, sf):
    return header_table(spark, sf).withColumn("normal", normalize_header(F.col("header")))


TARGETS_SQL = "(values " + ", ".join(f"('{t}', {i})" for i, t in enumerate(TARGETS)) + ") t(target, target_pos)"


def _similarity(a: str, b: str) -> str:
    base = f"(1.0::double - levenshtein({a}, {b})::double / greatest(length({a}), length({b})))"
    bonus = f"case when contains({a}, {b}) or contains({b}, {a}) then least(1.0::double, {base} + 0.1::double) else {base} end"
    return f"""case when {a} = '' or {b} = '' then 0.0::double when {a} = {b} then 1.0::double
      when starts_with({a}, left({b}, 3)) or starts_with({b}, left({a}, 3)) then least(1.0::double, {bonus} + 0.05::double) else {bonus} end"""


PAIRS_SQL = f"""
  select file_id, header, position, target, target_pos, {_similarity('a', 'b')} as similarity from (
    select file_id, header, min(position) as position, any_value({sql_normalize('header')}) as a from ({HEADERS_SQL}) group by file_id, header)
  cross join (select target, target_pos, {sql_normalize('target')} as b from {TARGETS_SQL})"""


@query(f"select file_id, header, position, target, target_pos, similarity from ({PAIRS_SQL})")
def header_similarity(spark, sf):
    return op.header_pairs(header_table(spark, sf), TARGETS)


@query(f"select file_id, target, max(similarity) as best, count(*) as headers from ({PAIRS_SQL}) group by file_id, target")
def header_pairs(spark, sf):
    """Best score of every target in every file."""
    pairs = op.header_pairs(header_table(spark, sf), TARGETS)
    return pairs.groupBy("file_id", "target").agg(F.max("similarity").alias("best"), F.count(F.lit(1)).alias("headers"))


def _greedy_sql() -> str:
    """One-to-one matching as a recursive query: each step settles the next target of every file."""
    return f"""
    with recursive scored as materialized (select * from ({PAIRS_SQL}) where similarity >= 0.7),
    ranked as materialized (select file_id, target, row_number() over (partition by file_id order by best desc, target_pos) as step
      from (select file_id, target, target_pos, max(similarity) as best from scored group by all)),
    steps as materialized (select r.file_id, r.step, r.target,
      list(struct_pack(h := header, p := position, s := similarity) order by similarity desc, position) as options
      from ranked r join scored s on r.file_id = s.file_id and r.target = s.target group by all),
    walk as (
      select file_id, 0::bigint as step, []::varchar[] as used, null::varchar as target,
        null::struct(h varchar, p int, s double) as pick from (select distinct file_id from steps)
      union all
      select file_id, step, case when pick is null then used else list_append(used, pick.h) end, target, pick from (
        select s.file_id, s.step, w.used, s.target, list_filter(s.options, lambda o: not list_contains(w.used, o.h))[1] as pick
        from walk w join steps s on s.file_id = w.file_id and s.step = w.step + 1))
    select file_id, target, pick.h as header, pick.p as position, pick.s as similarity from walk where pick is not null"""


GREEDY_SQL = _greedy_sql()


@query(GREEDY_SQL)
def header_greedy(spark, sf):
    return op.greedy_matches(header_table(spark, sf), TARGETS)


ALIASES_SQL = "(values " + ", ".join(f"('{t}', {quoted(a)}, {r})" for t, a, r in BUDGET.aliases()) + ") a(target, alias, rank)"
ALIAS_SQL = f"""select file_id, target, arg_min(header, rank * 1000 - position) as header
  from ({HEADERS_SQL}) join {ALIASES_SQL} on alias = lower(header) group by file_id, target"""


@query(ALIAS_SQL)
def alias_match(spark, sf):
    return op.alias_matches(header_table(spark, sf), BUDGET)


@query(f"""
with found as (select file_id, target, header as source from ({PAIRS_SQL}) where similarity > 0.5)
select * from found union all
select file_id, target, target as source from (select distinct file_id from ({HEADERS_SQL})) g cross join {TARGETS_SQL}
where not exists (select 1 from found f where f.file_id = g.file_id and f.target = t.target)
""")
def profile_bootstrap(spark, sf):
    return op.bootstrap_profile(header_table(spark, sf), TARGETS)


@query(f"""
with m as ({ALIAS_SQL})
select file_id, 'source' as side, header as name from ({HEADERS_SQL}) h
where not exists (select 1 from m where m.file_id = h.file_id and m.header = h.header)
union all select file_id, 'target', target from (select distinct file_id from ({HEADERS_SQL})) f cross join {TARGETS_SQL}
where not exists (select 1 from m where m.file_id = f.file_id and m.target = t.target)
""")
def unmatched_headers(spark, sf):
    headers = header_table(spark, sf)
    matches = op.alias_matches(headers, BUDGET)
    sources = op.unmatched_sources(headers, matches).select("file_id", F.lit("source").alias("side"), F.col("header").alias("name"))
    targets = op.unmatched_targets(headers, TARGETS, matches)
    return sources.unionByName(targets.select("file_id", F.lit("target").alias("side"), F.col("target").alias("name")))


@query(f"""
with m as (select file_id, count(*) as matched from ({ALIAS_SQL}) group by file_id)
select file_id, headers, coalesce(matched, 0) as matched, {len(TARGETS)} - coalesce(matched, 0) as unmatched_targets,
  coalesce(matched, 0) / {len(TARGETS)} as confidence
from (select file_id, count(*) as headers from ({HEADERS_SQL}) group by file_id) left join m using (file_id)
""")
def mapping_report(spark, sf):
    headers = header_table(spark, sf)
    return op.match_report(headers, TARGETS, op.alias_matches(headers, BUDGET))


@query(f"""
select file_id, len(list_filter(sources, lambda x: not list_contains(known, x))) as new_headers,
  len(list_filter(known, lambda x: not list_contains(sources, x))) as absent_headers from (
  select file_id, list(distinct lower(header)) as sources, [{', '.join(quoted(a) for a in sorted({a for _, a, _ in BUDGET.aliases()}))}] as known
  from ({HEADERS_SQL}) group by file_id)
""")
def header_set_diff(spark, sf):
    """Set differences between the headers of a file and all known aliases, by joins."""
    headers = header_table(spark, sf).select("file_id", F.lower("header").alias("name")).distinct()
    aliases = spark.createDataFrame([(a,) for a in sorted({a for _, a, _ in BUDGET.aliases()})], "name string")
    known = headers.join(F.broadcast(aliases.withColumn("known", F.lit(1))), "name", "left")
    total = len({a for _, a, _ in BUDGET.aliases()})
    return known.groupBy("file_id").agg(
        F.count_if(F.col("known").isNull()).alias("new_headers"),
        (F.lit(total) - F.count_if(F.col("known").isNotNull())).cast("bigint").alias("absent_headers"),
    )


def document_lines(spark, sf):
    """Lines of the documents as rows of comma-separated cells."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("row_id", "line"))
    return docs.select("file_id", F.col("row_id").cast("bigint").alias("row_id"), F.split("line", ",").alias("cells"))


CELL_SCORE = f"""case when length(s) < 2 then 0 else case when s <> 'nan' then 10 else 0 end
  + case when regexp_matches(s, '^[0-9]+$') then 0 else 5 end + case when length(s) > 2 then 3 else 0 end
  + case when regexp_matches(s, '\\pL') then 5 else 0 end
  + case when regexp_matches({sql_normalize('s')}, '{"|".join(HEADER_HINTS)}') then 5 else 0 end
  - case when regexp_matches(s, '^(Row|row|Ред|ред)') then 5 else 0 end end"""
SCORES_SQL = f"""select file_id, row_id, sum({CELL_SCORE})::bigint / (count(*) * 10) as score, count(*) as width from (
  select file_id, row_id, {sql_strip('cell')} as s from (select file_id, row_id, unnest(string_split(line, ',')) as cell from (
    select doc_id as file_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as row_id
    from documents))) group by file_id, row_id"""


@query(f"select file_id, row_id, score, width from ({SCORES_SQL})")
def header_row_scores(spark, sf):
    return document_lines(spark, sf).select(
        "file_id", "row_id", header_row_score(F.col("cells")).alias("score"), F.size("cells").cast("bigint").alias("width")
    )


@query(f"""
select file_id, header_row, score, width from (
  select file_id, row_id as header_row, score, width, row_number() over (partition by file_id order by score desc, row_id) as n
  from ({SCORES_SQL}) where row_id < 10 and score > 0) where n = 1
""")
def header_row_detect(spark, sf):
    found = op.detect_header_rows(document_lines(spark, sf))
    return found.select("file_id", "header_row", "score", F.size("headers").cast("bigint").alias("width"))
