"""Queries of the catalog: customers are datasets, orders their runs, line items the runs' artifacts."""

from pyspark.sql import functions as F

from schemagate.operators import catalog as op
from schemagate.plans.queries.base import load, query

DATASETS = {
    "id": "c_custkey", "org_id": "'org' || cast(c_nationkey as string)", "name": "c_name", "profile": "c_mktsegment", "active": "c_acctbal >= 0",
}
RUNS = {
    "id": "o_orderkey", "dataset_id": "o_custkey", "started_at": "o_orderdate",
    "status": "case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end",
    "rows_processed": "cast(floor(o_totalprice) as bigint)",
}
MAPPINGS = {
    "id": "o_orderkey", "dataset_id": "o_custkey", "version": "cast(mod(o_orderkey, 7) + 1 as int)", "active": "o_orderstatus <> 'P'",
    "created_at": "o_orderdate",
}
ARTIFACTS = {
    "id": "cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string)",
    "run_id": "l_orderkey", "kind": "case l_returnflag when 'A' then 'output_csv' when 'N' then 'output_json' else 'metadata' end",
    "size_bytes": "cast(floor(l_extendedprice) as bigint)",
}
EXECUTIONS = {
    "id": "event_id", "job_id": "user_id", "started_at": "ts",
    "status": "case event_type when 'error' then 'failed' when 'view' then 'running' else 'completed' end",
}
TABLES = {
    "datasets": ("customer", DATASETS), "runs": ("orders", RUNS), "mappings": ("orders", MAPPINGS), "artifacts": ("lineitem", ARTIFACTS),
    "executions": ("events", EXECUTIONS),
}
NOW = "timestamp '2024-01-31 00:00:00'"


def _table(spark, sf, name):
    source, columns = TABLES[name]
    return load(spark, sf, source).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def _sql(name: str) -> str:
    source, columns = TABLES[name]
    return f"(select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source})"


S = {name: _sql(name) for name in TABLES}


@query(f"""select dataset_id, version, created_at, id, active from (select *, row_number() over (partition by dataset_id
  order by version desc, created_at desc, id desc) as n from {S['mappings']} where active) where n = 1""")
def latest_mapping(spark, sf):
    return op.latest_mapping(_table(spark, sf, "mappings"))


@query(f"""select dataset_id, id, started_at, status, rows_processed from (select *, row_number() over (partition by dataset_id
  order by started_at desc, id desc) as n from {S['runs']} where status = 'completed') where n = 1""")
def latest_success(spark, sf):
    return op.latest_successful_run(_table(spark, sf, "runs"))


@query(f"""select id, dataset_id, started_at, status, rows_processed from (select *, row_number() over (partition by dataset_id
  order by started_at desc, id desc) as n from {S['runs']}) where n > 4""")
def runs_to_purge(spark, sf):
    return op.runs_to_purge(_table(spark, sf, "runs"), keep_last=4)


RUN_FIELDS = {
    "status": "event_type", "message": "case when value > 20 then props end", "score": "case when event_type <> 'view' then value end",
    "finished_at": "case when event_type = 'purchase' then ts end",
}
LATEST = ", ".join(f"arg_max({e}, (ts, event_id)) filter (({e}) is not null) as {c}" for c, e in RUN_FIELDS.items())


@query(f"select user_id as id, {LATEST} from events group by user_id")
def run_latest_state(spark, sf):
    changes = load(spark, sf, "events").selectExpr("user_id as id", "ts as event_at", "event_id", *[f"{e} as {c}" for c, e in RUN_FIELDS.items()])
    return op.run_state(changes, list(RUN_FIELDS), at=("event_at", "event_id"))


@query(f"select id, dataset_id, started_at, status, rows_processed from {S['runs']} where status = 'completed' order by started_at desc, id limit 20 offset 40")
def run_list_page(spark, sf):
    return op.list_runs(_table(spark, sf, "runs"), status="completed", offset=40, limit=20)


@query(f"select id, org_id, name, profile, active from {S['datasets']} where active and org_id = 'org7' order by id limit 100 offset 2")
def dataset_page(spark, sf):
    return op.list_datasets(_table(spark, sf, "datasets"), "org7", offset=2)


@query(f"select id, job_id, started_at, status from {S['executions']} where job_id = 7 order by started_at desc, id limit 50")
def executions_recent(spark, sf):
    return op.recent_executions(_table(spark, sf, "executions"), job_id=7)


@query(f"select id, job_id, started_at, status from {S['executions']} where started_at >= {NOW} - interval 7 days")
def retention(spark, sf):
    return op.retained(_table(spark, sf, "executions"), F.expr(NOW))


@query("""select event_id as id, epoch_us(finished) - epoch_us(ts) as micros, (epoch_us(finished) - epoch_us(ts)) / 1000000 as duration_seconds
  from (select event_id, ts, ts + to_seconds(cast(floor(value) as bigint)) as finished from events)""")
def run_duration(spark, sf):
    timed = load(spark, sf, "events").selectExpr(
        "event_id as id", "ts as started_at", "ts + make_dt_interval(0, 0, 0, floor(value)) as finished_at"
    )
    return op.with_duration(timed).select("id", F.round(F.col("duration_seconds") * 1_000_000).cast("bigint").alias("micros"), "duration_seconds")


@query(f"""select r.id as run_id, dataset_id, started_at, status, rows_processed, a.id as artifact_id, kind, size_bytes
  from {S['runs']} r left join {S['artifacts']} a on a.run_id = r.id""")
def runs_with_artifacts(spark, sf):
    return op.runs_with_artifacts(_table(spark, sf, "runs"), _table(spark, sf, "artifacts"))


@query(f"select run_id, count(*) as artifact_count from {S['artifacts']} group by run_id")
def artifact_counts(spark, sf):
    return op.artifact_counts(_table(spark, sf, "artifacts"))


@query(f"select id, run_id, kind, size_bytes from {S['artifacts']} where kind = 'metadata'")
def artifacts_by_kind(spark, sf):
    return op.artifacts_of(_table(spark, sf, "artifacts"), kind="metadata")


@query(f"select id, run_id, kind, size_bytes from {S['artifacts']} where run_id = 7")
def artifacts_by_run(spark, sf):
    return op.artifacts_of(_table(spark, sf, "artifacts"), run_id=7)


@query(f"select id, dataset_id, started_at, status, rows_processed from {S['runs']} where id = 77")
def run_by_id(spark, sf):
    return op.by_id(_table(spark, sf, "runs"), 77)


@query(f"select id, dataset_id, version, active, created_at from {S['mappings']}")
def mapping_history(spark, sf):
    return op.mapping_history(_table(spark, sf, "mappings"))


@query(f"""select d.id as dataset_id, org_id, name, profile, active, coalesce(run_count, 0) as run_count, last_run_at,
  coalesce(completed_runs, 0) as completed_runs, coalesce(mapping_count, 0) as mapping_count, latest_version
  from {S['datasets']} d left join (select dataset_id, count(*) as run_count, max(started_at) as last_run_at,
    count(*) filter (status = 'completed') as completed_runs from {S['runs']} group by dataset_id) r on r.dataset_id = d.id
  left join (select dataset_id, count(*) as mapping_count, max(version) as latest_version from {S['mappings']} where active
    group by dataset_id) m on m.dataset_id = d.id""")
def dataset_detail(spark, sf):
    mappings = _table(spark, sf, "mappings").filter("active")
    return op.dataset_detail(_table(spark, sf, "datasets"), _table(spark, sf, "runs"), mappings)


@query(f"select id, org_id, name, profile, active from {S['datasets']} where not active")
def dataset_existence(spark, sf):
    """Datasets whose name is not taken by an active one."""
    datasets = _table(spark, sf, "datasets")
    return op.new_datasets(datasets, datasets.filter("active")).select("id", "org_id", "name", "profile", "active")


@query(f"""select a.id, run_id, kind, size_bytes from {S['artifacts']} a where run_id not in (select r.id from {S['runs']} r
  join {S['datasets']} d on r.dataset_id = d.id where not active)""")
def cascade_orphans(spark, sf):
    """Artifacts left after the inactive datasets are deleted with their runs."""
    runs = _table(spark, sf, "runs")
    deleted = _table(spark, sf, "datasets").filter("not active")
    gone = runs.join(deleted.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi").select("id")
    return op.without_children_of(_table(spark, sf, "artifacts"), gone, "run_id").select("id", "run_id", "kind", "size_bytes")


@query(f"""select count(*) as total, count(*) filter (started_at >= {NOW} - interval 24 hours) as recent_24h,
  count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed,
  count(*) filter (status = 'running') as running, count(*) filter (status = 'pending') as pending from {S['executions']}""")
def status_counts(spark, sf):
    return op.status_counts(_table(spark, sf, "executions"), F.expr(NOW), ["completed", "failed", "running", "pending"])
