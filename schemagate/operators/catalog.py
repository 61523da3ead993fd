"""Catalog of datasets, mapping versions, runs and artifacts, as tables of plain rows.

State changes are appended as events; the current state is an aggregate over them. Latest-row
questions are answered by ``max_by``-style aggregates, which combine map-side, so one dataset with
most of the runs is no hot window.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemagate.plans.skew import lookup_join

SCHEMAS = {
    "datasets": "id string, org_id string, name string, description string, profile string, schedule_cron string, "
    "publish_target string, active boolean, created_at timestamp, updated_at timestamp",
    "mappings": "id string, dataset_id string, json_spec string, version int, active boolean, created_at timestamp",
    "run_events": "id string, dataset_id string, event_at timestamp, status string, started_at timestamp, "
    "finished_at timestamp, input_hash string, output_hash string, message string, rows_processed bigint, "
    "rows_valid bigint, rows_invalid bigint, external_package_id string, external_resource_id string",
    "artifacts": "id string, run_id string, kind string, path string, checksum string, size_bytes bigint, "
    "mime_type string, created_at timestamp",
    "stage_events": "dataset_id string, run_id string, stage string, status string, event_at timestamp, "
    "input_hash string, output_hash string, error string, metrics map<string,double>",
}
RUN_STATUSES = ("pending", "running", "completed", "failed", "cancelled")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A catalog table kept as parquet under ``root``."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def append(df: DataFrame, root: str, name: str) -> None:
    columns = SparkSession.active().createDataFrame([], SCHEMAS[name]).columns
    df.select(*columns).write.mode("append").parquet(f"{root}/{name}")


def rows(spark: SparkSession, name: str, *values: dict) -> DataFrame:
    """Catalog rows from dicts; fields not given are null."""
    columns = spark.createDataFrame([], SCHEMAS[name]).columns
    return spark.createDataFrame([tuple(v.get(c) for c in columns) for v in values], SCHEMAS[name])


def latest_per(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes last in ``order``."""
    rest = [c for c in df.columns if c != key]
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), ranked).alias("r"))
    return best.select(key, "r.*")


def latest_mapping(mappings: DataFrame) -> DataFrame:
    """Highest active version of each dataset, the newest of equals."""
    return latest_per(mappings.filter("active"), "dataset_id", [F.col("version"), F.col("created_at"), F.col("id")])


def latest_successful_run(runs: DataFrame) -> DataFrame:
    return latest_per(
        runs.filter(F.col("status") == "completed"), "dataset_id", [F.col("started_at"), F.col("id")]
    )


def runs_to_purge(runs: DataFrame, keep_last: int = 10) -> DataFrame:
    """All runs of a dataset but its newest ``keep_last``.

    The kept rank is limited before the shuffle, so each task passes on at most ``keep_last`` runs
    of a dataset; the oldest kept run is then the cut for all its rows.
    """
    newest = Window.partitionBy("dataset_id").orderBy(F.desc("started_at"), F.desc("id"))
    cuts = (
        runs.select("dataset_id", "started_at", "id")
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= keep_last)
        .groupBy("dataset_id")
        .agg(F.min(F.struct("started_at", "id")).alias("cut"))
    )
    return (
        lookup_join(runs, cuts, "dataset_id")
        .filter(F.struct("started_at", "id") < F.col("cut"))
        .drop("cut")
    )


def run_state(events: DataFrame, fields: Sequence[str], key: str = "id", at: Sequence[str] = ("event_at",)) -> DataFrame:
    """Current state of each run: for every field the last value any event has set."""
    order = F.struct(*at)
    return events.groupBy(key).agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    )


def page(df: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of an ordered listing."""
    return df.orderBy(*order).offset(offset).limit(limit)


def list_datasets(
    datasets: DataFrame, org_id: str | None = None, active_only: bool = True, offset: int = 0, limit: int = 100
) -> DataFrame:
    if org_id:
        datasets = datasets.filter(F.col("org_id") == org_id)
    if active_only:
        datasets = datasets.filter("active")
    return page(datasets, ["id"], offset, limit)


def list_runs(
    runs: DataFrame, dataset_id: str | None = None, status: str | None = None, offset: int = 0, limit: int = 100
) -> DataFrame:
    if dataset_id is not None:
        runs = runs.filter(F.col("dataset_id") == dataset_id)
    if status:
        runs = runs.filter(F.col("status") == status)
    return page(runs, [F.desc("started_at"), "id"], offset, limit)


def mapping_history(mappings: DataFrame, dataset_id: str | None = None) -> DataFrame:
    if dataset_id is not None:
        mappings = mappings.filter(F.col("dataset_id") == dataset_id)
    return mappings.orderBy("dataset_id", F.desc("version"), F.desc("created_at"))


def artifacts_of(artifacts: DataFrame, run_id=None, kind: str | None = None) -> DataFrame:
    if run_id is not None:
        artifacts = artifacts.filter(F.col("run_id") == run_id)
    if kind is not None:
        artifacts = artifacts.filter(F.col("kind") == kind)
    return artifacts


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == value)


def recent_executions(executions: DataFrame, job_id: str | None = None, limit: int = 50) -> DataFrame:
    if job_id is not None:
        executions = executions.filter(F.col("job_id") == job_id)
    return page(executions, [F.desc("started_at"), "id"], 0, limit)


def retained(executions: DataFrame, now: datetime | Column, keep_days: int = 7) -> DataFrame:
    """Executions started within the last ``keep_days`` days."""
    now = now if isinstance(now, Column) else F.lit(now)
    return executions.filter(F.col("started_at") >= now - F.make_dt_interval(days=F.lit(keep_days)))


def with_duration(df: DataFrame) -> DataFrame:
    """Add ``duration_seconds`` between started_at and finished_at."""
    micros = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return df.withColumn("duration_seconds", micros / 1_000_000)


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("run_id").agg(F.count(F.lit(1)).alias("artifact_count"))


def runs_with_artifacts(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each run with each of its artifacts; runs without any stay, with nulls.

    One row per pair, never an array per run, so the artifacts of a hot run stay spread out.
    """
    return lookup_join(
        artifacts.withColumnRenamed("id", "artifact_id"), runs.withColumnRenamed("id", "run_id"), "run_id"
    ).unionByName(
        runs.withColumnRenamed("id", "run_id").join(artifacts.select("run_id").distinct(), "run_id", "left_anti"),
        allowMissingColumns=True,
    )


def dataset_detail(datasets: DataFrame, runs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Datasets with the number and time of their runs and their newest mapping version."""
    by_run = runs.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.max("started_at").alias("last_run_at"),
        F.count_if(F.col("status") == "completed").alias("completed_runs"),
    )
    by_mapping = mappings.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("mapping_count"), F.max("version").alias("latest_version")
    )
    zero = {"run_count": 0, "completed_runs": 0, "mapping_count": 0}
    return (
        datasets.withColumnRenamed("id", "dataset_id")
        .join(by_run, "dataset_id", "left")
        .join(by_mapping, "dataset_id", "left")
        .na.fill(zero)
    )


def new_datasets(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose (org_id, name) is not taken yet."""
    return candidates.join(existing.select("org_id", "name"), ["org_id", "name"], "left_anti")


def without_children_of(children: DataFrame, deleted: DataFrame, parent_key: str) -> DataFrame:
    """Child table after its parents ``deleted`` (column ``id``) are gone."""
    gone = deleted.select(F.col("id").alias(parent_key))
    return children.join(gone, parent_key, "left_anti")


def status_counts(executions: DataFrame, now: datetime | Column, statuses: Sequence[str]) -> DataFrame:
    """One row: executions in all, per status, and within the last 24 hours."""
    now = now if isinstance(now, Column) else F.lit(now)
    recent = F.col("started_at") >= now - F.expr("interval 24 hours")
    return executions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(recent).alias("recent_24h"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
    )
