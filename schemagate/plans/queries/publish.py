"""Queries of publication: customers are datasets to publish, those with money in hand are published already."""

from pyspark.sql import functions as F

from schemagate.operators import publish as op
from schemagate.plans.queries.base import load, query
from schemagate.plans.queries.normalize import LONG_NAME, ORG
from schemagate.sinks import export

NOW = "timestamp '2025-01-31 12:00:00'"
FULL = f"{ORG} || '-' || {LONG_NAME}"
SLUG_SQL = f"""select c_custkey, {ORG} as org_id, {LONG_NAME} as dataset_id, c_acctbal, c_mktsegment,
  case when length(n) > 90 then left(n, 80) || '-' || left(md5({FULL}), 8) else n end as package_name
  from (select *, trim(regexp_replace(lower({FULL}), '[^\\pL\\pN]+', '-', 'g'), '-') as n from customer)"""
KNOWN_DATE = "case when c_acctbal > 5000 then timestamp '2024-06-01 08:00:00' end"


def candidates(spark, sf):
    return load(spark, sf, "customer").selectExpr(f"{ORG} as org_id", f"{LONG_NAME} as dataset_id", "c_custkey", "c_mktsegment as profile", "c_acctbal")


def published(spark, sf):
    """Packages that exist: of the datasets with a balance above zero."""
    named = candidates(spark, sf).filter("c_acctbal > 0")
    return named.select(
        op.package_slug(F.col("org_id"), F.col("dataset_id")).alias("name"),
        F.concat(F.lit("pkg-"), F.col("c_custkey").cast("string")).alias("id"), F.expr(KNOWN_DATE).alias("created_date"),
    )


def plan(spark, sf):
    return op.publish_plan(candidates(spark, sf), published(spark, sf), F.expr(NOW))


@query(f"""select org_id, dataset_id, package_name, case when c_acctbal > 0 then 'pkg-' || c_custkey::varchar end as package_id,
  case when c_acctbal > 0 then 'update' else 'create' end as action,
  coalesce(case when c_acctbal > 0 then {KNOWN_DATE} end, {NOW}) as created_date from ({SLUG_SQL})""")
def publish_plan(spark, sf):
    return plan(spark, sf).select("org_id", "dataset_id", "package_name", "package_id", "action", "created_date")


@query("""select 'pkg-' || c_custkey::varchar as package_id, name, format, mimetype, case when c_acctbal > 3000 and name = 'CSV Data'
    then 'res-' || c_custkey::varchar end as resource_id, case when c_acctbal > 3000 and name = 'CSV Data' then 'update' else 'create' end as action
  from customer cross join (values ('CSV Data', 'CSV', 'text/csv'), ('JSON Data', 'JSON', 'application/json'),
    ('Processing Metadata', 'JSON', 'application/json')) r(name, format, mimetype)""")
def resource_plan(spark, sf):
    customers = load(spark, sf, "customer")
    package = F.concat(F.lit("pkg-"), F.col("c_custkey").cast("string")).alias("package_id")
    known = customers.filter("c_acctbal > 3000").select(
        package, F.lit("CSV Data").alias("name"), F.concat(F.lit("res-"), F.col("c_custkey").cast("string")).alias("id")
    )
    return op.resource_plan(op.standard_resources(customers.select(package)), known)


TAGS = "case when mod(c_custkey, 3) = 0 then lower(c_mktsegment) when mod(c_custkey, 3) = 1 then 'budget' end"


@query(f"""select c_custkey, array_to_string(list_sort(list_distinct(list_concat(case when t is null then [] else [t, 'open'] end,
  ['budget', 'government', 'automated', c_mktsegment]))), ',') as tags from (select *, {TAGS} as t from customer)""")
def tag_union(spark, sf):
    tags = F.when(F.expr(TAGS).isNotNull(), F.array(F.expr(TAGS), F.lit("open")))
    merged = op.merged_tags(tags, F.col("c_mktsegment"))
    return load(spark, sf, "customer").select("c_custkey", F.array_join(merged, ",").alias("tags"))


@query(f"""select package_name as name, case when c_acctbal > 0 then 'pkg-' || c_custkey::varchar end as id, 'Dataset ' || package_name as title,
  'Automated data publication' as notes, org_id as maintainer, 'cc-by' as license_id, 'active' as state, c_mktsegment as profile,
  7::bigint as extras, 4::bigint as tags from ({SLUG_SQL})""")
def package_record(spark, sf):
    record = op.package_record(plan(spark, sf), F.expr(NOW)).select("record.*")
    profile = F.filter("extras", lambda e: e["key"] == "profile")[0]["value"]
    return record.select(
        "name", "id", "title", "notes", "maintainer", "license_id", "state", profile.alias("profile"),
        F.size("extras").cast("bigint").alias("extras"), F.size("tags").cast("bigint").alias("tags"),
    )


@query("""select 'orders - org' as title, 'Open Data License' as license, 6 as column_count, count(*) as row_count,
  1.0::double as completeness, count(*) * 6 as total_cells, 0::bigint as null_cells, 0::bigint as duplicate_rows,
  6::bigint as profiled_columns, max(o_totalprice) as highest_total, 'passed' as validation_status, 0.95::double as quality_score from orders""")
def export_metadata(spark, sf):
    orders = load(spark, sf, "orders")
    meta = export.metadata(orders, "orders", "org", F.expr(NOW), {"profile": "orders"})
    rich = export.enriched(meta, "orders", F.lit(1.0), F.lit(0.95), F.expr(NOW))
    highest = F.filter("statistics", lambda s: s["column"] == "o_totalprice")[0]["max"]
    return rich.select(
        "dataset.title", "dataset.license", "data.column_count", "data.row_count", "quality.completeness", "quality.total_cells",
        "quality.null_cells", "quality.duplicate_rows", F.size("data.column_profile").cast("bigint").alias("profiled_columns"),
        highest.alias("highest_total"), "validation_status", "quality_score",
    )


@query(f"""select 'pkg-' || source as package_id, lang || ' Data' as name, lang || ' Data generated by {op.GENERATOR}' as description, 'CSV' as format,
  'text/csv' as mimetype, n_chars as size, '2025-01-01 00:00:00' as last_modified from documents""")
def resource_records(spark, sf):
    listed = load(spark, sf, "documents").select(
        F.concat(F.lit("pkg-"), "source").alias("package_id"), F.concat("lang", F.lit(" Data")).alias("name"), F.lit("csv").alias("format"),
        F.lit("text/csv").alias("mime_type"), F.col("n_chars").alias("size_bytes"), F.expr("timestamp_ntz '2025-01-01 00:00:00'").alias("modified_at"),
    )
    return op.resource_record(listed).select("record.*")
