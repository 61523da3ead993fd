import hashlib
import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from schemagate.operators import catalog, publish
from schemagate.plans.process import process_and_export, process_table, run_metrics
from schemagate.profiles import load_profile
from schemagate.sinks import export
from schemagate.streaming.intake import intake_all, intake_stream, landed_rows

BUDGET = load_profile("budget_execution_v1")
HEADERS = ["Period", "Department", "Budget Line", "Planned Amount", "Executed Amount", "Status"]
DATA = [
    ("2025-01", "education", "E1", "150 000,50", "145230.25", "Active"),
    ("2025-02", "health", "H1", "10", "20", "active"),
    ("2019-12", "roads", "R1", "1", "1", "active"),
    (None, None, None, None, None, None),
    ("2025-03", None, "X", "abc", "1", "активен"),
]
MAPPING = {"Period": "period", "Department": "department", "Budget Line": "budget_line", "Planned Amount": "planned_amount",
           "Executed Amount": "executed_amount", "Status": "status"}


def source(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(DATA)], "row_id bigint, " + ", ".join(f"`{h}` string" for h in HEADERS))


def test_process_table(spark):
    done = process_table(source(spark), BUDGET, "row_id")
    assert set(done.matches) == set(MAPPING.values()) and done.unmapped == []
    assert rows(done.valid, "row_id", "department") == [(0, "Education"), (1, "Health")]
    assert rows(done.errors, "row_id", "reason") == [
        (1, "execution_exceeds_planned:10.00"), (2, "date_before_minimum:2020-01-01"),
        (4, "not_in_allowed_values:active,cancelled,completed,inactive"), (4, "required_field_missing"), (4, "required_field_missing"),
    ]
    m = run_metrics(done, "row_id").first()
    assert (m.input_rows, m.output_rows, m.columns_mapped, m.rows_invalid) == (4, 2, 6, 2)


def test_process_and_export(spark, tmp_path):
    out, cat, now = str(tmp_path / "out"), str(tmp_path / "cat"), datetime(2025, 5, 1, 12)
    result = process_and_export(source(spark), BUDGET, "row_id", "ds", "org", out, cat, "run-1", now, {"title": "T"})
    back = spark.read.option("header", "true").csv(result["paths"]["output_csv"])
    assert rows(back, "period", "planned_amount") == [("2025-01-01", "150000.50"), ("2025-02-01", "10.00")]
    assert spark.read.json(result["paths"]["output_json"]).count() == 2
    meta = json.loads(spark.read.text(result["paths"]["metadata"]).first().value)
    assert meta["dataset"]["title"] == "T" and meta["data"]["row_count"] == 2 and meta["validation_status"] == "warning"
    assert "validation_report" in result["paths"]
    state = catalog.run_state(catalog.table(spark, cat, "run_events"), ["status", "started_at", "rows_valid", "message"]).first()
    assert (state.status, state.rows_valid) == ("completed", 2)
    kinds = {r.kind for r in catalog.table(spark, cat, "artifacts").collect()}
    assert kinds == {"output_csv", "output_json", "metadata", "validation_report"}
    assert catalog.table(spark, cat, "stage_events").count() == 3
    with pytest.raises(Exception):
        process_and_export(source(spark), BUDGET, "nope", "ds", "org", out, cat, "run-2", now)
    failed = catalog.table(spark, cat, "run_events").filter("id = 'run-2' and status = 'failed'")
    assert failed.count() == 1


def test_no_error_report_without_errors(spark, tmp_path):
    none = spark.createDataFrame([], "row_id int, column string")
    assert export.export_errors(none, str(tmp_path / "e")) is False and not (tmp_path / "e").exists()


def test_resource_records(spark):
    df = spark.createDataFrame([("p", "CSV Data", "csv", "text/csv", 5, "2025-01-01")], "package_id string, name string, format string, mime_type string, size_bytes int, modified_at string")
    r = publish.resource_record(df).first().record
    assert (r.format, r.mimetype, r["size"]) == ("CSV", "text/csv", 5)


def _drop(path, name, data):
    path.mkdir(parents=True, exist_ok=True)
    text = "\n".join(",".join('"' + (v or "") + '"' for v in r) for r in [HEADERS, *data]) + "\n"
    (path / name).write_text(text, encoding="utf-8")


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    _drop(folder, "a.csv", DATA[:2])

    def run():
        intake_stream(landed_rows(spark, str(folder), HEADERS), BUDGET, MAPPING, out, state).awaitTermination()

    run()
    assert spark.read.parquet(f"{out}/valid").count() == 2
    _drop(folder, "b.csv", DATA[2:])
    (folder / "c.csv").write_text(",".join(HEADERS) + "\n1,2\n", encoding="utf-8")
    run()
    run()
    batch = process_table(source(spark), BUDGET, "row_id", MAPPING)
    key = ["period", "department", "planned_amount", "status"]
    assert rows(spark.read.parquet(f"{out}/valid"), *key) == rows(batch.valid, *key)
    assert rows(spark.read.parquet(f"{out}/errors"), "column", "reason") == rows(batch.errors, "column", "reason")
    assert spark.read.parquet(f"{out}/quarantine").count() == 1
    assert spark.read.parquet(f"{out}/events").agg(F.sum("rows_processed"), F.sum("rows_valid")).first()[:] == (4, 2)


def test_intake_of_datasets(spark, tmp_path):
    _drop(tmp_path / "up" / "o" / "d1", "a.csv", DATA[:1])
    base = {"org_id": "o", "active": True, "profile": BUDGET, "columns": HEADERS, "mapping": MAPPING}
    datasets = [{**base, "id": "d1"}, {**base, "id": "d2", "active": False}, {**base, "id": "d3"}]
    got = intake_all(spark, datasets, str(tmp_path / "up"), str(tmp_path / "o"), str(tmp_path / "s"))
    assert rows(got) == [("d1", "completed", None), ("d2", "skipped", "dataset_inactive"), ("d3", "skipped", "no_upload_directory")]


def test_manifest_of_files_of_any_size(spark, tmp_path):
    """A file beyond what one row can hold, names with blanks and percent signs; files without content are not listed."""
    (tmp_path / "out" / "deep").mkdir(parents=True)
    with open(tmp_path / "out" / "large.csv", "wb") as f:
        f.truncate((2 << 30) + 5)
    (tmp_path / "out" / "deep" / "a b%20c.json").write_bytes(b"{}")
    (tmp_path / "out" / "empty.csv").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r for r in export.manifest(spark, str(tmp_path / "out"), "output").collect()}
    whole = hashlib.sha256()
    for _ in range(2 << 6):
        whole.update(bytes(1 << 24))
    whole.update(bytes(5))
    assert {k: (r.size_bytes, r.checksum) for k, r in got.items()} == {
        "large.csv": ((2 << 30) + 5, whole.hexdigest()),
        "a b%20c.json": (2, hashlib.sha256(b"{}").hexdigest()),
    }
