"""Queries of the validation rules, their split and their summaries."""

from pyspark.sql import functions as F

from schemagate.operators import validate as op
from schemagate.plans.queries.base import load, query, sql_strip
from schemagate.plans.queries.normalize import D, LINE_KEY, M, RAW_EMAIL, RAW_PHONE, RAW_URL, Y
from schemagate.profiles import FieldSpec, Profile, load_profile


def _profile(name: str, **spec) -> Profile:
    return Profile("rule", {name: FieldSpec((name,), **spec)})


def _errors(df, key: str, name: str, **spec):
    return op.validate(df, _profile(name, **spec), key).errors


def _sql(table: str, key: str, name: str, expr: str, *rules: tuple[str, str]) -> str:
    """Union of (condition over ``v``, reason) rules as error rows."""
    return " union all ".join(
        f"""select row_id, '{name}' as "column", '{reason}' as reason, coalesce(cast(v as varchar), '') as value,
            'error' as severity from (select {key} as row_id, {expr} as v from {table}) where {condition}"""
        for condition, reason in rules
    )


SPARSE = "nullif(o_orderpriority, case when mod(o_custkey, 4) = 0 then o_orderpriority end)"


@query(_sql("orders", "o_orderkey", "priority", SPARSE, ("v is null", "required_field_missing")))
def validate_required(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderkey", f"{SPARSE} as priority")
    return _errors(df, "o_orderkey", "priority", required=True)


@query("""select -1::bigint as row_id, 'executed_amount' as "column", 'required_column_missing' as reason,
  'column not found in data' as value, 'error' as severity union all
  select o_orderkey, 'order_no', 'required_field_missing', '', 'error' from orders where mod(o_custkey, 6) = 0""")
def validate_missing_column(spark, sf):
    df = load(spark, sf, "orders").selectExpr(
        "o_orderkey", "case when mod(o_custkey, 6) = 0 then null else o_orderpriority end as order_no"
    )
    columns = {n: FieldSpec((n,), required=True) for n in ("order_no", "executed_amount")}
    return op.validate(df, Profile("rule", columns), "o_orderkey").errors


FILE_TARGETS = ("source", "lang", "n_chars", "title", "text")


@query(f"""select 's' || d.source || '#-1' as row_id, t as "column", 'required_column_missing' as reason, 'column not found in data' as value, 'error' as severity
  from (select distinct source from documents) d, (select unnest({list(FILE_TARGETS)}) as t)
  where not exists (select * from documents x where x.source = d.source and {FILE_TARGETS}[1 + mod(x.doc_id * 7 + length(x.text), 151)::int] = t)""".replace(str(FILE_TARGETS), str(list(FILE_TARGETS))))
def file_missing_columns(spark, sf):
    """Each source is a file, each of its documents a match with one target or none."""
    docs = load(spark, sf, "documents").select(F.concat(F.lit("s"), "source").alias("file_id"), "doc_id", "text")
    targets = F.array(*map(F.lit, FILE_TARGETS))
    matches = docs.select("file_id", F.get(targets, ((F.col("doc_id") * 7 + F.length("text")) % 151).cast("int")).alias("target"))
    return op.column_errors(op.required_columns(docs.select("file_id").distinct(), matches.distinct(), FILE_TARGETS))


RAW_NUMBER = """case mod(o_orderkey, 6) when 0 then cast(o_custkey as string) when 1 then cast(o_custkey as string) || '.5'
    when 2 then cast(o_custkey as string) || '.0' when 3 then '1_000' when 4 then 'nan' else o_orderstatus end"""
BAD_NUMBER = "not regexp_matches(v, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')"


@query(_sql("orders", "o_orderkey", "amount", RAW_NUMBER, (BAD_NUMBER, "not_numeric")))
def validate_numeric(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderkey", f"{RAW_NUMBER} as amount")
    return _errors(df, "o_orderkey", "amount", type="decimal")


@query(_sql("orders", "o_orderkey", "units", RAW_NUMBER, (BAD_NUMBER, "not_numeric"),
            ("try_cast(v as double) <> floor(try_cast(v as double)) and v <> 'nan'", "not_integer")))
def validate_integer(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderkey", f"{RAW_NUMBER} as units")
    return _errors(df, "o_orderkey", "units", type="integer")


PRICE = "cast(l_extendedprice as decimal(18,2))"
LINE_ID = " || '-' || ".join(f"cast({k} as string)" for k in LINE_KEY)


def _lines(spark, sf, expr: str, name: str):
    return load(spark, sf, "lineitem").selectExpr(f"{LINE_ID} as line_id", f"{expr} as {name}")


@query(_sql("lineitem", LINE_ID, "price", PRICE, ("v < 5000", "below_minimum:5000")))
def validate_minimum(spark, sf):
    return _errors(_lines(spark, sf, PRICE, "price"), "line_id", "price", type="decimal", validation={"min_value": 5000})


@query(_sql("lineitem", LINE_ID, "price", PRICE, ("v > 90000", "above_maximum:90000")))
def validate_maximum(spark, sf):
    return _errors(_lines(spark, sf, PRICE, "price"), "line_id", "price", type="decimal", validation={"max_value": 90000})


@query(_sql("documents", "doc_id", "text", "text", ("length(v) < 200", "too_short:200")))
def validate_min_length(spark, sf):
    return _errors(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", validation={"min_length": 200})


@query(_sql("part", "p_partkey", "p_name", "p_name || ' ' || p_type", ("length(v) > 15", "too_long:15")))
def validate_max_length(spark, sf):
    df = load(spark, sf, "part").selectExpr("p_partkey", "p_name || ' ' || p_type as p_name")
    return _errors(df, "p_partkey", "p_name", validation={"max_length": 15})


@query(_sql("part", "p_partkey", "p_brand", "p_brand", ("not regexp_matches(v, '^(?:Brand#[1-3]|Brand#9)')",
                                                        "pattern_mismatch:Brand#[1-3]|Brand#9")))
def validate_pattern(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", "p_brand")
    return _errors(df, "p_partkey", "p_brand", validation={"pattern": "Brand#[1-3]|Brand#9"})


@query(_sql("customer", "c_custkey", "email", RAW_EMAIL,
            (f"not regexp_matches({sql_strip('v')}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}$')", "invalid_email_format")))
def validate_email(spark, sf):
    df = load(spark, sf, "customer").selectExpr("c_custkey", f"{RAW_EMAIL} as email")
    return _errors(df, "c_custkey", "email", type="email")


@query(_sql("pages", "page_id", "url", RAW_URL,
            (f"not regexp_matches({sql_strip('v')}, '^https?://[a-zA-Z0-9_.-]+(:[0-9]+)?(/.*)?$', 'i')", "invalid_url_format")))
def validate_url(spark, sf):
    df = load(spark, sf, "pages").selectExpr("page_id", f"{RAW_URL} as url")
    return _errors(df, "page_id", "url", type="url")


@query(_sql("customer", "c_custkey", "phone", RAW_PHONE,
            (f"not regexp_matches({sql_strip('v')}, '^[+]?[0-9\\s().-]{{7,15}}$')", "invalid_phone_format")))
def validate_phone(spark, sf):
    df = load(spark, sf, "customer").selectExpr("c_custkey", f"{RAW_PHONE} as phone")
    return _errors(df, "c_custkey", "phone", type="phone")


RAW_DAY = f"""case mod(o_orderkey, 6) when 0 then {Y} || '-' || {M} || '-' || {D} when 1 then {D} || '.' || {M} || '.' || {Y}
    when 2 then '31.04.' || {Y} when 3 then {Y} || '/' || {M} when 4 then {Y} || '-' || {M} else 'May ' || {Y} end"""


@query(_sql("orders", "o_orderkey", "day", RAW_DAY,
            ("regexp_matches(v, '^31[.]04[.]|/|May')", "invalid_date_format")))
def validate_date(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderkey", f"{RAW_DAY} as day")
    return _errors(df, "o_orderkey", "day", type="date")


@query(_sql("orders", "o_orderkey", "day", "o_orderdate::date", ("v < date '1997-03-01'", "date_before_minimum:1997-03-01")))
def validate_date_min(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_orderdate as date) as day")
    return _errors(df, "o_orderkey", "day", type="date", validation={"date_range": {"min_date": "1997-03-01"}})


@query(_sql("orders", "o_orderkey", "day", "o_orderdate::date", ("v > date '2000-06-30'", "date_after_maximum:2000-06-30")))
def validate_date_max(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_orderdate as date) as day")
    return _errors(df, "o_orderkey", "day", type="date", validation={"date_range": {"max_date": "2000-06-30"}})


RAW_STATUS = "case when mod(o_custkey, 3) = 0 then ' ' || o_orderstatus || ' ' when mod(o_custkey, 3) = 1 then lower(o_orderstatus) else o_orderstatus end"


@query(_sql("orders", "o_orderkey", "status", RAW_STATUS, (f"{sql_strip('v')} not in ('F', 'O')", "not_in_allowed_values:F,O")))
def validate_enum(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderkey", f"{RAW_STATUS} as status")
    return _errors(df, "o_orderkey", "status", validation={"enum_values": ["O", "F"]})


@query("""select o_orderkey as row_id, 'customer' as "column", 'duplicate_value' as reason, v as value, 'error' as severity
  from (select o_orderkey, cast(o_custkey as varchar) || '@' || cast(o_orderdate::date as varchar) as v,
        count(*) over (partition by o_custkey, o_orderdate::date) as n from orders) where n > 1""")
def validate_unique(spark, sf):
    df = load(spark, sf, "orders").selectExpr(
        "o_orderkey", "cast(o_custkey as string) || '@' || cast(cast(o_orderdate as date) as string) as customer"
    )
    return _errors(df, "o_orderkey", "customer", validation={"unique": True})


@query("""select doc_id as row_id, 'text' as "column", 'duplicate_value' as reason, text as value, 'error' as severity
  from (select *, count(*) over (partition by text) as n from documents) where n > 1""")
def validate_unique_text(spark, sf):
    df = load(spark, sf, "documents").select("doc_id", "text")
    return _errors(df, "doc_id", "text", validation={"unique": True})


BUDGET_LINES = """
  select o_orderkey, cast(o_totalprice as decimal(18,2)) as planned, executed,
    cast(case when mod(o_custkey, 2) = 0 then cast(o_totalprice as decimal(18,2)) - executed else 0 end as decimal(18,2)) as remaining,
    cast(mod(o_custkey, 200) as decimal(18,2)) as pct
  from orders join (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as executed from lineitem group by l_orderkey)
  on o_orderkey = l_orderkey"""


def budget_table(spark, sf):
    """Orders as budget rows: planned by the order, executed by its lines."""
    executed = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("executed_amount")
    )
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(executed, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
        "o_orderkey",
        "cast(o_totalprice as decimal(18,2)) as planned_amount",
        "executed_amount",
        """cast(case when mod(o_custkey, 2) = 0 then cast(o_totalprice as decimal(18,2)) - executed_amount else 0 end
           as decimal(18,2)) as remaining_amount""",
        "cast(mod(o_custkey, 200) as decimal(18,2)) as execution_percentage",
    )


@query(f"""
with b as ({BUDGET_LINES})
select o_orderkey as row_id, 'executed_amount' as "column", 'execution_exceeds_planned:' || cast(planned as varchar) as reason,
  cast(executed::decimal(18,2) as varchar) as value, 'warning' as severity from b where executed > planned * 1.05
union all select o_orderkey, 'remaining_amount', 'inconsistent_calculation:' || cast((planned - executed)::decimal(18,2) as varchar),
  cast(remaining as varchar), 'warning' from b where abs(remaining - (planned - executed)) > abs(planned) * 0.01
union all select o_orderkey, 'execution_percentage', 'inconsistent_percentage:' ||
  cast(round_even(executed::double / planned::double * 100, 1)::decimal(18,1) as varchar), cast(pct as varchar), 'warning'
  from b where planned <> 0 and abs(pct * planned - executed * 100) > abs(planned)
""")
def validate_budget_rules(spark, sf):
    budget = load_profile("budget_execution_v1")
    columns = {
        n: FieldSpec((n,), "decimal")
        for n in ("planned_amount", "executed_amount", "remaining_amount", "execution_percentage")
    }
    profile = Profile("budget_rules", columns, cross_rules=budget.cross_rules)
    return op.validate(budget_table(spark, sf), profile, "o_orderkey").errors


ORDER_RULES = Profile(
    "order_rules",
    {
        "o_orderpriority": FieldSpec(("p",), required=True, validation={"enum_values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]}),
        "o_totalprice": FieldSpec(("t",), "decimal", validation={"min_value": 10000, "max_value": 450000}),
        "o_orderdate": FieldSpec(("d",), "date", validation={"date_range": {"min_date": "1995-06-01", "max_date": "2001-12-31"}}),
    },
)
INJECTED = "nullif(o_orderpriority, case when mod(o_custkey, 7) = 0 then o_orderpriority end)"
ORDER_COLUMNS = (
    "o_orderkey",
    f"{INJECTED} as o_orderpriority",
    "cast(o_totalprice as decimal(18,2)) as o_totalprice",
    "cast(o_orderdate as date) as o_orderdate",
)
ORDERS_SQL = f"(select {', '.join(ORDER_COLUMNS)} from orders)"
ORDER_ERRORS = " union all ".join(
    f"""select o_orderkey as row_id, '{c}' as "column", '{reason}' as reason, coalesce(cast({c} as varchar), '') as value,
        'error' as severity from {ORDERS_SQL} where {cond}"""
    for c, reason, cond in (
        ("o_orderpriority", "required_field_missing", "o_orderpriority is null"),
        ("o_orderpriority", "not_in_allowed_values:1-URGENT,2-HIGH,3-MEDIUM,5-LOW",
         "o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')"),
        ("o_totalprice", "below_minimum:10000", "o_totalprice < 10000"),
        ("o_totalprice", "above_maximum:450000", "o_totalprice > 450000"),
        ("o_orderdate", "date_before_minimum:1995-06-01", "o_orderdate < date '1995-06-01'"),
        ("o_orderdate", "date_after_maximum:2001-12-31", "o_orderdate > date '2001-12-31'"),
    )
)


def checked_orders(spark, sf):
    df = load(spark, sf, "orders").selectExpr(*ORDER_COLUMNS)
    return op.validate(df, ORDER_RULES, "o_orderkey")


@query(ORDER_ERRORS)
def validate_orders_errors(spark, sf):
    return checked_orders(spark, sf).errors


@query(f"select * from {ORDERS_SQL} where o_orderkey not in (select row_id from ({ORDER_ERRORS}))")
def validate_orders_split(spark, sf):
    return checked_orders(spark, sf).valid


@query(f"select * from {ORDERS_SQL} where o_orderkey not in (select row_id from ({ORDER_ERRORS}))")
def valid_via_anti_join(spark, sf):
    checked = checked_orders(spark, sf)
    return op.rows_without_errors(checked.annotated.drop(op.ERRORS, op.EXCLUDED), checked.errors, "o_orderkey").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"
    )


@query(f"""
with e as ({ORDER_ERRORS}), n as (select count(*) as total, (select count(*) from e) as errors,
  (select count(distinct row_id) from e) as invalid from orders)
select total as total_rows, total - invalid as valid_rows, invalid as invalid_rows, errors as total_errors,
  errors as errors, 0::bigint as warnings, 0::bigint as infos, errors / total as error_rate, invalid / total as exclusion_rate,
  errors = 0 as validation_passed, (total - invalid) / total as data_quality_score from n
""")
def error_summary(spark, sf):
    return op.summary(checked_orders(spark, sf).annotated)


@query(f"""
with e as ({ORDER_ERRORS})
select 'severity' as dimension, s as key, count(e.severity) as n from (values ('error'), ('warning'), ('info')) d(s)
  left join e on e.severity = s group by s
union all select 'column', "column", count(*) from e group by "column"
union all select 'reason', reason, count(*) from e group by reason
""")
def errors_by_dimension(spark, sf):
    return op.errors_by(checked_orders(spark, sf).errors)
