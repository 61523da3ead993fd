"""Export of results: data files, error report, metadata document, manifest, invoice documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, StringType, StructField, StructType

from schemagate import __version__
from schemagate.functions.text import mime_type
from schemagate.operators.profiling import column_profile, completeness, duplicate_rows, numeric_profile, verdict
from schemagate.profiles import OutputSpec
from schemagate.sinks.documents import DocumentFiles
from schemagate.sources.stores import ARROW_STORES, open_path, store_name

#: Bytes of a file that a checksum reads at a time.
CHUNK = 4 << 20

# Defaults of the descriptive metadata.
DEFAULT_LICENSE, DEFAULT_FREQUENCY = "Open Data License", "monthly"
_JAVA_LETTERS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def java_format(fmt: str) -> str:
    for ours, theirs in _JAVA_LETTERS.items():
        fmt = fmt.replace(ours, theirs)
    return fmt


def formatted(df: DataFrame, output: OutputSpec) -> DataFrame:
    """Fractions cut to the declared places, half-even."""
    fractions = (DecimalType, DoubleType, FloatType)
    places = {
        f.name: F.bround(F.col(f.name).cast("decimal(38,10)"), output.decimal_places).cast(
            f"decimal(38,{output.decimal_places})"
        )
        for f in df.schema.fields
        if isinstance(f.dataType, fractions) and not (isinstance(f.dataType, DecimalType) and f.dataType.scale == 0)
    }
    return df.withColumns(places)


def export_csv(df: DataFrame, path: str, output: OutputSpec = OutputSpec(), mode: str = "error") -> None:
    writer = (
        formatted(df, output).write.mode(mode).option("header", "true").option("encoding", "UTF-8")
        .option("escape", '"').option("dateFormat", java_format(output.date_format))
    )
    if output.null_representation:
        writer = writer.option("nullValue", output.null_representation)
    writer.csv(path)


def export_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with ISO dates; null fields are written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def export_errors(errors: DataFrame, path: str, mode: str = "error") -> bool:
    """Error report, written only if there is an error."""
    if errors.isEmpty():
        return False
    errors.write.mode(mode).option("header", "true").option("escape", '"').csv(path)
    return True


def metadata(
    df: DataFrame,
    dataset: str,
    org_id: str,
    created: Column,
    base: Mapping[str, Any] | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """One row of nested metadata: description, data, files, processing, statistics, quality.

    Everything counted comes from single-row aggregates; only their results are combined.
    """
    base = dict(base or {})
    columns, numbers = column_profile(df), numeric_profile(df)
    stamp = created.cast("string")

    def listed(table: DataFrame, name: str) -> DataFrame:
        # One entry per column or file of the table.
        entries = F.sort_array(F.collect_list(F.struct(*table.columns)))
        return table.agg(entries.alias(name)).withColumn("k", F.lit(1))

    described = F.struct(
        F.lit(base.get("title", f"{dataset} - {org_id}")).alias("title"),
        F.lit(base.get("description", "")).alias("description"),
        F.lit(base.get("publisher", org_id)).alias("publisher"),
        F.lit(base.get("license", DEFAULT_LICENSE)).alias("license"),
        F.lit(base.get("update_frequency", DEFAULT_FREQUENCY)).alias("update_frequency"),
        stamp.alias("created"),
        stamp.alias("modified"),
        F.lit(base.get("temporal_coverage", "")).alias("temporal_coverage"),
        F.lit(base.get("spatial_coverage", "")).alias("spatial_coverage"),
        F.array(*[F.lit(k) for k in base.get("keywords", [dataset])]).alias("keywords"),
    )
    data = F.struct(
        F.lit("CSV/JSON").alias("format"),
        F.lit("UTF-8").alias("encoding"),
        "column_count",
        "row_count",
        F.array(*map(F.lit, df.columns)).alias("columns"),
        F.col("column_list").alias("column_profile"),
    )
    processing = F.struct(
        F.lit("schemagate").alias("generated_by"),
        F.lit(__version__).alias("version"),
        stamp.alias("processing_date"),
        F.lit(base.get("profile", "")).alias("profile_used"),
        F.lit(base.get("validation_status", "unknown")).alias("validation_status"),
    )
    quality = F.struct("completeness", "total_cells", "null_cells", "duplicate_rows")
    joined = (
        completeness(df).withColumn("k", F.lit(1))
        .join(duplicate_rows(df).withColumn("k", F.lit(1)), "k")
        .join(listed(columns, "column_list"), "k")
        .join(listed(numbers, "number_list"), "k")
    )
    sections = [
        described.alias("dataset"), data.alias("data"), processing.alias("processing"),
        F.col("number_list").alias("statistics"), quality.alias("quality"),
    ]
    if files is not None:
        # Totals per kind; the files themselves, of which there may be many, stay in the manifest.
        kinds = files.groupBy("kind", "mime_type").agg(
            F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").cast("bigint").alias("size_bytes")
        )
        joined = joined.join(listed(kinds, "file_list"), "k")
        sections.append(F.col("file_list").alias("files"))
    return joined.select(*sections)


def enriched(meta: DataFrame, profile: str, confidence: Column, score: Column, at: Column) -> DataFrame:
    """Add what the processing found out: profile, time, confidence, score and verdict."""
    return meta.withColumns(
        {
            "profile": F.lit(profile),
            "processing_date": at.cast("string"),
            "mapping_confidence": confidence,
            "quality_score": score,
            "validation_status": verdict(score),
        }
    )


def export_metadata(meta: DataFrame, path: str, mode: str = "error") -> None:
    meta.select(F.to_json(F.struct(*meta.columns)).alias("value")).write.mode(mode).text(path)


def manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Path, checksum, size and type of every file of an output that has content.

    Spark lists the files without reading them; tasks digest them chunk by chunk, so files may have any size and none is
    held in a row. In stores that only Spark opens, each file is read whole and may have 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = files.select("path").first()
    if one is None or store_name(one.path) in ARROW_STORES:
        listed = files.select("path", "length", "modificationTime")
        files = listed.mapInArrow(_digested, StructType([*listed.schema.fields, StructField("checksum", StringType())]))
    else:
        files = files.withColumn("checksum", F.sha2("content", 256))
    return files.select(
        F.lit(kind).alias("kind"),
        "path",
        "checksum",
        F.col("length").alias("size_bytes"),
        mime_type(F.col("path")).alias("mime_type"),
        F.col("modificationTime").alias("modified_at"),
    )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = pa.array([file_digest(path) for path in batch["path"].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, sums], [*batch.schema.names, "checksum"])


def file_digest(path: str) -> str:
    """SHA-256 of a file, read in chunks."""
    digest = hashlib.sha256()
    with open_path(path) as file:
        while chunk := file.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def export_documents(docs: DataFrame, path: str, mode: str = "error") -> None:
    """Invoice documents as a table of file name, part number and text."""
    docs.filter(~F.col("illegal")).select("invoice_id", "part_no", "n_parts", "document").write.mode(mode).parquet(path)


def write_document_files(named: DataFrame, directory: str) -> int:
    """One file per document (file_path, part_no, n_parts, document) in a directory that all executors share.

    A document has one file, named the same way, of however many parts; its parts are written in order by one
    task. Invoices without a path, those in error, are passed over. Returns the number of parts written. Files appear
    when the whole write is done, or not at all: see :mod:`schemagate.sinks.documents`.
    """
    spark, counted = named.sparkSession, Observation()
    spark.dataSource.register(DocumentFiles)
    files = named.filter(F.col("file_path") != "").select("file_path", "part_no", "n_parts", "document")
    several = files.filter(F.col("n_parts") > 1).repartition("file_path").sortWithinPartitions("file_path", "part_no")
    files = files.filter(F.col("n_parts") == 1).unionByName(several).observe(counted, F.count(F.lit(1)).alias("parts"))
    files.select("file_path", F.col("part_no").cast("bigint"), F.col("n_parts").cast("bigint"), "document").write.format("document_files").mode("append").save(directory)
    return counted.get["parts"]
