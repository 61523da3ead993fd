"""The whole way of a table: mapping, normalization, validation, metrics, export, run records."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemagate.functions.text import WORKBOOK_NULL_TOKENS
from schemagate.operators import catalog, headers
from schemagate.operators.headers import column_mapping, map_columns
from schemagate.operators.normalize import apply_mapping, clean_cells, drop_empty_rows, normalize_table
from schemagate.operators.profiling import quality_metrics
from schemagate.operators.validate import Validation, column_errors, required_columns, validate
from schemagate.plans.durable import stored
from schemagate.profiles import Profile
from schemagate.sinks import export
from schemagate.sources import files, workbook


@dataclass
class Processed:
    """Lazy tables of a processed input; nothing has run but the match of its header names."""

    source: DataFrame
    normalized: DataFrame
    validation: Validation
    matches: dict[str, tuple[str, float]]
    unmapped: list[str]
    confidence: float

    @property
    def valid(self) -> DataFrame:
        return self.validation.valid

    @property
    def errors(self) -> DataFrame:
        return self.validation.errors


def process_table(
    df: DataFrame,
    profile: Profile,
    key: str,
    mapping: Mapping[str, str] | None = None,
    keep_raw: bool = False,
    apply_defaults: bool = False,
) -> Processed:
    """Map, normalize and validate a table of text columns; ``mapping`` (source to target) skips matching."""
    names = [c for c in df.columns if c != key]
    if mapping is None:
        matches = map_columns(df.sparkSession, names, profile)
    else:
        matches = {target: (source, 1.0) for source, target in mapping.items()}
    data = drop_empty_rows(df, names)
    mapped, unmapped = apply_mapping(data, column_mapping(matches))
    normalized = normalize_table(mapped, profile, apply_defaults, keep_raw)
    checked = validate(normalized, profile, key)
    unmapped = [c for c in unmapped if c != key]
    return Processed(data, normalized, checked, matches, unmapped, len(matches) / max(len(profile.columns), 1))


def process_files(listing: DataFrame, profile: Profile, **limits) -> tuple[Validation, DataFrame, DataFrame]:
    """Map, normalize and validate all admitted files of a folder at once.

    Also returns the matches made for each file, and what was left out, as (file_id, row_id, reason): files not
    admitted, without a reader, without a matching header or ending inside a quoted cell (row_id is null), and rows with
    more cells than headers. Rows are keyed by ``row_key``: file and row number. A required column that a file does not
    have is one error of the file, with row -1. Files are read once: rows, headers, matches and cleaned cells are stored (see
    :func:`schemagate.plans.durable.stored`), and every step reads them from there.
    """
    taken = files.admitted(listing, **limits)
    text = files.mixed_records(taken)
    rows = stored(text.rows.unionByName(workbook.read_workbooks(taken)), "folder-rows")
    located = stored(headers.locate_headers(rows), "folder-headers")
    matches = stored(headers.match_files(files.header_table(located), profile), "folder-matches")
    table = files.mapped_table(rows, located, matches, profile.targets)
    keyed = table.withColumn("row_key", F.concat_ws("#", "file_id", F.col("row_id").cast("string")))
    # Stored, as the optimizer else copies the cleaning of every cell into each filter and rule.
    cells = stored(clean_cells(keyed.drop("file_id", "row_id"), WORKBOOK_NULL_TOKENS), "folder-cells")
    named = taken.select(F.col("path").alias("file_id"))
    matched, unclosed = matches.select("file_id").distinct(), stored(text.unclosed, "folder-unclosed")
    unread = named.filter(F.lower("file_id").endswith(".xls")).withColumn("reason", F.lit("no_reader"))
    unmatched = named.filter(~F.lower("file_id").endswith(".xls")).join(matched, "file_id", "left_anti").join(unclosed, "file_id", "left_anti")
    whole = files.rejected(listing, **limits).select(F.col("path").alias("file_id"), "reason").unionByName(unread)
    whole = whole.unionByName(unmatched.withColumn("reason", F.lit("no_matching_header"))).unionByName(unclosed.withColumn("reason", F.lit("quote_not_closed")))
    over = files.overlong_rows(rows, located).select("file_id", "row_id", F.lit("more_cells_than_headers").alias("reason"))
    left_out = whole.withColumn("row_id", F.lit(None).cast("bigint")).unionByName(over)
    checked = validate(normalize_table(drop_empty_rows(cells, profile.targets), profile), profile, "row_key", absent="absent")
    wanted = [name for name, spec in profile.columns.items() if spec.required]
    checked.file_errors = column_errors(required_columns(matched, matches, wanted))
    return checked, matches, left_out.select("file_id", "row_id", "reason")


def run_metrics(done: Processed, key: str) -> DataFrame:
    """One row: rows in and out, columns mapped, score, rows lost."""
    quality = quality_metrics(done.source.drop(key), done.valid.drop(key))
    return quality.select(
        "input_rows",
        "output_rows",
        F.lit(len(done.matches)).alias("columns_mapped"),
        F.col("completeness").alias("data_quality_score"),
        (F.col("input_rows") - F.col("output_rows")).alias("rows_invalid"),
        "validation_status",
    )


def process_and_export(
    df: DataFrame,
    profile: Profile,
    key: str,
    dataset_id: str,
    org_id: str,
    output_root: str,
    catalog_root: str,
    run_id: str,
    now: datetime,
    base_metadata: Mapping[str, Any] | None = None,
    input_hash: str | None = None,
    mapping: Mapping[str, str] | None = None,
) -> dict[str, Any]:
    """Process a table, write every output, and append the run to the catalog.

    The annotated rows are written once and read back for the valid rows, the errors and the
    metrics, so the input is parsed a single time and lost executors cost no recomputation of it.
    """
    spark = df.sparkSession
    began = time.monotonic()

    def clock() -> datetime:
        return now + timedelta(seconds=time.monotonic() - began)

    def event(status: str, **fields) -> None:
        row = {"id": run_id, "dataset_id": dataset_id, "event_at": clock(), "status": status, **fields}
        catalog.append(catalog.rows(spark, "run_events", row), catalog_root, "run_events")

    def stage(name: str, metrics: Mapping[str, float], **fields) -> None:
        row = {
            "dataset_id": dataset_id, "run_id": run_id, "stage": name, "status": "completed", "event_at": clock(),
            "metrics": {k: float(v) for k, v in metrics.items()}, **fields,
        }
        catalog.append(catalog.rows(spark, "stage_events", row), catalog_root, "stage_events")

    event("running", started_at=now, input_hash=input_hash)
    try:
        base = f"{output_root}/{org_id}/{dataset_id}/{dataset_id}_{org_id}_{now:%Y%m%d_%H%M%S}"
        done = process_table(df, profile, key, mapping)
        stage("mapping", {"matches_found": len(done.matches), "confidence": done.confidence})
        done.validation.annotated.write.mode("overwrite").parquet(f"{base}_annotated")
        done.validation.annotated = spark.read.parquet(f"{base}_annotated")

        metrics = run_metrics(done, key).first().asDict()
        stage("normalization", {k: v for k, v in metrics.items() if k != "validation_status"})
        export.export_csv(done.valid.drop(key), f"{base}_csv", profile.output, "overwrite")
        export.export_json(done.valid.drop(key), f"{base}_json", "overwrite")
        reported = export.export_errors(done.errors, f"{base}_errors", "overwrite")
        described = {**(base_metadata or {}), "profile": profile.profile, "validation_status": metrics["validation_status"]}
        meta = export.metadata(done.valid.drop(key), dataset_id, org_id, F.lit(now), described)
        score = F.lit(metrics["data_quality_score"])
        meta = export.enriched(meta, profile.profile, F.lit(done.confidence), score, F.lit(now))
        export.export_metadata(meta, f"{base}_metadata", "overwrite")

        kinds = {"output_csv": f"{base}_csv", "output_json": f"{base}_json", "metadata": f"{base}_metadata"}
        if reported:
            kinds["validation_report"] = f"{base}_errors"
        for kind, path in kinds.items():
            record_artifacts(spark, run_id, path, kind, catalog_root, now)
        stage("export", {"files": len(kinds)})
        event(
            "completed", finished_at=clock(), rows_processed=metrics["input_rows"], rows_valid=metrics["output_rows"],
            rows_invalid=metrics["rows_invalid"], message="processing completed",
        )
    except Exception as e:
        event("failed", finished_at=clock(), message=str(e))
        raise
    return {"run_id": run_id, "paths": kinds, "metrics": metrics, "confidence": done.confidence}


def record_artifacts(spark: SparkSession, run_id: str, path: str, kind: str, catalog_root: str, now: datetime) -> None:
    """Append the data files under ``path`` to the artifacts of a run."""
    written = export.manifest(spark, path, kind).filter(~F.col("path").rlike(r"/[._][^/]*$"))
    found = written.select(
        F.sha2(F.concat(F.lit(run_id), F.col("path")), 256).alias("id"), F.lit(run_id).alias("run_id"), "kind", "path",
        "checksum", "size_bytes", "mime_type", F.lit(now).alias("created_at"),
    )
    catalog.append(found, catalog_root, "artifacts")


