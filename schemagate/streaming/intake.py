"""Incremental intake: every newly landed file is taken once, validated and appended.

Outputs are partitioned by batch number and a batch overwrites only its own partition, so a batch
that is repeated after a failure leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from schemagate.operators.normalize import apply_mapping, drop_empty_rows, normalize_table
from schemagate.operators.validate import ERRORS, EXCLUDED, validate
from schemagate.plans.skew import digest
from schemagate.profiles import Profile
from schemagate.sources.files import CORRUPT, quarantine, string_schema, well_formed

ROW_ID = "row_id"


def landed_rows(
    spark: SparkSession, path: str, columns: Sequence[str], delimiter: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """Stream of the rows of delimited files in a folder, all text, with the file they came from."""
    return (
        spark.readStream.schema(string_schema([*columns, CORRUPT]))
        .option("header", "true").option("sep", delimiter).option("encoding", encoding)
        .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", "false")
        .csv(path)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def validate_batch(batch: DataFrame, batch_id: int, profile: Profile, mapping: Mapping[str, str], out: str) -> None:
    """Quarantine, normalize and validate one batch; write valid rows, errors and an event."""
    whole = well_formed(batch)
    _write(quarantine(batch), f"{out}/quarantine", batch_id)
    data = [c for c in whole.columns if c != "file_path"]
    # Row identity by content: the same whenever the batch is repeated.
    keyed = drop_empty_rows(whole, data).withColumn(
        ROW_ID, F.hex(digest(*[F.col(f"`{c}`") for c in ["file_path", *data]]))
    )
    mapped, _ = apply_mapping(keyed, mapping)
    checked = validate(normalize_table(mapped, profile), profile, ROW_ID)
    # Written once, read back for all outputs.
    _write(checked.annotated, f"{out}/annotated", batch_id)
    checked.annotated = batch.sparkSession.read.parquet(f"{out}/annotated/batch_id={batch_id}")
    _write(checked.valid, f"{out}/valid", batch_id)
    _write(checked.errors, f"{out}/errors", batch_id)
    _write(
        checked.annotated.groupBy("file_path").agg(
            F.count(F.lit(1)).alias("rows_processed"),
            F.count_if(~F.col(EXCLUDED)).alias("rows_valid"),
            F.sum(F.size(ERRORS)).cast("bigint").alias("errors"),
        ),
        f"{out}/events",
        batch_id,
    )


def intake_stream(
    rows: DataFrame,
    profile: Profile,
    mapping: Mapping[str, str],
    out: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the intake; uniqueness rules look at one batch at a time."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: validate_batch(batch, batch_id, profile, mapping, out)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def intake_all(
    spark: SparkSession, datasets: Sequence[Mapping], folder: str, out: str, checkpoints: str
) -> DataFrame:
    """Run the intake of each dataset once; tell for each what was done or why it was skipped.

    A dataset is a mapping with id, org_id, active, profile (a Profile), columns and mapping.
    """
    outcomes = []
    for d in datasets:
        place = f"{d['org_id']}/{d['id']}"
        if not d["active"]:
            outcomes.append((d["id"], "skipped", "dataset_inactive"))
            continue
        try:
            spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{folder}/{place}").select("path").head(1)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            outcomes.append((d["id"], "skipped", "no_upload_directory"))
            continue
        query = intake_stream(
            landed_rows(spark, f"{folder}/{place}", d["columns"]), d["profile"], d["mapping"], f"{out}/{place}",
            f"{checkpoints}/{place}",
        )
        query.awaitTermination()
        taken = reduce(lambda n, p: n + p["numInputRows"], query.recentProgress, 0)
        outcomes.append((d["id"], "completed" if taken else "skipped", None if taken else "no_input_files"))
    return spark.createDataFrame(outcomes, "dataset_id string, status string, reason string")
