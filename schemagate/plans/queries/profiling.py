"""Queries of profiles and quality metrics."""

from pyspark.sql import functions as F

from schemagate.operators import profiling as op
from schemagate.plans.process import Processed, run_metrics as metrics_of
from schemagate.plans.queries.base import load, query
from schemagate.plans.queries.validate import ORDER_ERRORS, ORDERS_SQL, checked_orders
from schemagate.plans.skew import lookup_join

LABELED = "(select d.*, quality, toxic from documents d left join labels using (doc_id))"
LABELED_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


def labeled(spark, sf):
    return lookup_join(load(spark, sf, "documents"), load(spark, sf, "labels"), "doc_id", "left").select(*LABELED_COLUMNS)


@query(" union all ".join(
    f"""select '{c}' as "column", count(*) - count({c}) as null_count, count({c}) as non_null_count from {LABELED}"""
    for c in LABELED_COLUMNS
))
def profile_nulls(spark, sf):
    return op.column_profile(labeled(spark, sf)).select("column", "null_count", "non_null_count")


@query("""
select 'n_chars' as "column", 'bigint' as data_type union all select 'doc_id', 'bigint' union all select 'text', 'string'
union all select 'lang', 'string' union all select 'source', 'string' union all select 'quality', 'int' union all select 'toxic', 'int'
""")
def profile_types(spark, sf):
    """Types as read; the scan also counts, so the work grows with the table."""
    return op.column_profile(labeled(spark, sf)).filter("null_count + non_null_count > 0").select("column", "data_type")


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(" union all ".join(
    f"""select '{c}' as "column", count({c}) as "count", round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
        min({c})::double as min, max({c})::double as max from lineitem"""
    for c in NUMBERS
))
def profile_numeric(spark, sf):
    found = op.numeric_profile(load(spark, sf, "lineitem"), NUMBERS)
    return found.select("column", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query("""select (count(*) - (select count(*) from (select distinct text, lang from documents)))::bigint as duplicate_rows from documents""")
def duplicate_rows(spark, sf):
    return op.duplicate_rows(load(spark, sf, "documents").select("text", "lang"))


NULL_CELLS = " + ".join(f"(count(*) - count({c}))" for c in LABELED_COLUMNS)


@query(f"""
select n as row_count, 7 as column_count, n * 7 as total_cells, nulls as null_cells, (n * 7 - nulls) / (n * 7) as completeness
from (select count(*) as n, ({NULL_CELLS})::bigint as nulls from {LABELED})
""")
def completeness(spark, sf):
    return op.completeness(labeled(spark, sf))


VALID_SQL = f"(select * from {ORDERS_SQL} where o_orderkey not in (select row_id from ({ORDER_ERRORS})))"
QUALITY_SQL = f"""
select i.n as input_rows, 4 as input_columns, (i.n * 4 - i.nulls) / (i.n * 4) as input_completeness,
  o.n as output_rows, 4 as output_columns, (o.n * 4 - o.nulls) / (o.n * 4) as output_completeness,
  o.n / i.n as row_retention_rate, 4 / 4 as column_mapping_rate,
  ((o.n * 4 - o.nulls) / (o.n * 4) + o.n / i.n) / 2 as completeness
from (select count(*) as n, count(*) - count(o_orderpriority) as nulls from {ORDERS_SQL}) i,
     (select count(*) as n, count(*) - count(o_orderpriority) as nulls from {VALID_SQL}) o"""


@query(f"select *, case when completeness > 0.8 then 'passed' else 'warning' end as validation_status from ({QUALITY_SQL})")
def quality_metrics(spark, sf):
    checked = checked_orders(spark, sf)
    return op.quality_metrics(checked.annotated.drop("errors").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"), checked.valid)


@query(f"""
select n as input_rows, v as output_rows, 3 as columns_mapped, (1.0::double + v / n) / 2 as data_quality_score,
  n - v as rows_invalid, case when (1.0::double + v / n) / 2 > 0.8 then 'passed' else 'warning' end as validation_status
from (select (select count(*) from orders) as n, (select count(*) from {VALID_SQL}) as v)
""")
def run_metrics(spark, sf):
    checked = checked_orders(spark, sf)
    source = checked.annotated.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    matches = {n: (n, 1.0) for n in ("o_orderpriority", "o_totalprice", "o_orderdate")}
    return metrics_of(Processed(source, source, checked, matches, [], 1.0), "o_orderkey")


DISTINCT = ("text", "source", "doc_id")


@query(" union all ".join(
    f"""select '{c}' as "column", count({c}) as non_null, count(distinct {c}) as distinct_values,
        count({c}) = count(distinct {c}) as all_distinct from documents"""
    for c in DISTINCT
))
def distinct_check(spark, sf):
    return op.distinct_check(load(spark, sf, "documents"), DISTINCT)


@query("""
select n_name as org, cast(year(o_orderdate) as bigint) as budget_year, o_orderpriority as department,
  sum(planned)::decimal(28,2) as planned_total, sum(executed)::decimal(28,2) as executed_total,
  sum(planned - executed)::decimal(28,2) as remaining_total, count(*) filter (o_orderstatus = 'O') as active_lines,
  count(*) as line_count, grouping(n_name, cast(year(o_orderdate) as bigint), o_orderpriority)::bigint as level
from (select o_custkey, o_orderdate, o_orderpriority, o_orderstatus, cast(o_totalprice as decimal(18,2)) as planned,
      coalesce(executed, 0)::decimal(18,2) as executed from orders left join
      (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as executed from lineitem group by l_orderkey)
      on o_orderkey = l_orderkey)
join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by rollup (n_name, cast(year(o_orderdate) as bigint), o_orderpriority)
""")
def budget_rollup(spark, sf):
    executed = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("executed")
    )
    orgs = lookup_join(
        load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")),
        load(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("org")),
        "n_nationkey",
    ).drop("n_nationkey")
    lines = lookup_join(load(spark, sf, "orders").join(executed, "o_orderkey", "left"), orgs, "o_custkey").select(
        "org",
        F.year("o_orderdate").cast("bigint").alias("budget_year"),
        F.col("o_orderpriority").alias("department"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("planned"),
        F.coalesce("executed", F.lit(0)).cast("decimal(18,2)").alias("executed"),
        F.when(F.col("o_orderstatus") == "O", "active").alias("status"),
    )
    rolled = op.budget_rollup(lines, ["org", "budget_year", "department"])
    return rolled.withColumns({c: F.col(c).cast("decimal(28,2)") for c in ("planned_total", "executed_total", "remaining_total")})
