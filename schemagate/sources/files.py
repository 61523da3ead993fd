"""Intake of delimited files: listing, admission, encoding and delimiter detection, scanning.

Two ways to read. :func:`read_delimited` hands uniform files of any size to Spark's splittable
reader. :func:`read_mixed` takes a folder of admitted files of any size, with any mix of encodings and
delimiters, in one plan; see :mod:`schemagate.sources.records`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from schemagate.functions.text import file_extension
from schemagate.plans.skew import number_hot
from schemagate.sources.records import DELIMITERS, Records, decode_bytes, delimiter_of, read_records, split_cells  # noqa: F401

CORRUPT = "_corrupt_record"
# Extensions taken in.
EXTENSIONS = ("csv", "tsv", "txt", "xlsx", "xls")
DATASET_EXTENSIONS = ("csv", "xlsx", "xls")
TEXT_EXTENSIONS = ("csv", "tsv", "txt")
# Ids numbered by one task.
ID_RUN = 2**20


def list_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Files under the path with length, time and content; unused content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path if isinstance(path, str) else list(path))


def admission(listing: DataFrame, max_bytes: int | None = None, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Add ``rejected``: why a file is not taken in, null if it is; sizes count only where a limit is given."""
    reason = F.when(~file_extension(F.col("path")).isin(list(extensions)), "unsupported_extension")
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, "file_too_large")
    return listing.withColumn("rejected", reason)


def admitted(listing: DataFrame, **limits) -> DataFrame:
    return admission(listing, **limits).filter(F.col("rejected").isNull()).drop("rejected")


def rejected(listing: DataFrame, **limits) -> DataFrame:
    return (
        admission(listing, **limits)
        .filter(F.col("rejected").isNotNull())
        .select("path", "length", F.col("rejected").alias("reason"))
    )


def newest_inputs(listing: DataFrame) -> DataFrame:
    """Newest data file of each ``.../org/dataset/`` folder; the later path of equal times."""
    parts = F.split("path", "/")
    files = listing.filter(file_extension(F.col("path")).isin(list(DATASET_EXTENSIONS)))
    return (
        files.select(
            F.element_at(parts, -3).alias("org_id"), F.element_at(parts, -2).alias("dataset_id"), "path", "modificationTime"
        )
        .groupBy("org_id", "dataset_id")
        .agg(F.max(F.struct("modificationTime", "path")).alias("f"))
        .select("org_id", "dataset_id", "f.path", "f.modificationTime")
    )


def checksums(listing: DataFrame) -> DataFrame:
    return listing.select("path", "length", "modificationTime", F.sha2("content", 256).alias("checksum"))


def detect_encoding(content: Column) -> Column:
    """UTF-8 where the bytes are valid in it, else the Cyrillic code page."""
    return F.when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("windows-1251")


def decode(content: Column) -> Column:
    """Text of a file, byte order mark removed."""
    text = decode_bytes(content, F.is_valid_utf8(content.cast("string")))
    return F.regexp_replace(text, "^\ufeff", "")


def detect_delimiter(text: Column) -> Column:
    """Most frequent delimiter of the whole text; comma if there is none."""
    return delimiter_of([F.length(text) - F.length(F.replace(text, F.lit(d), F.lit(""))) for d in DELIMITERS])


def mixed_records(listing: DataFrame, delimiter: str | None = None, skip_rows: int = 0, max_rows: int | None = None) -> Records:
    """Records of the admitted text files of a listing; only their paths pass through the driver, as in any file scan."""
    wanted = listing.filter(file_extension(F.col("path")).isin(list(TEXT_EXTENSIONS))).select("path")
    return read_records(listing.sparkSession, [r.path for r in wanted.collect()], delimiter, skip_rows, max_rows)


def read_mixed(listing: DataFrame, delimiter: str | None = None, skip_rows: int = 0, max_rows: int | None = None) -> DataFrame:
    """Rows of admitted text files as (file_id, row_id, cells); row ids count the records that are not empty from 0 in each file.

    ``skip_rows`` lines in front are left out, empty ones among them; ``max_rows`` rows are read after the first. Files
    that end inside a quoted cell give no rows: ``mixed_records`` names them.
    """
    return mixed_records(listing, delimiter, skip_rows, max_rows).rows


def header_table(located: DataFrame) -> DataFrame:
    """Header table (file_id, position, header) of files whose header rows are located."""
    named = located.select("file_id", F.posexplode("cells").alias("position", "header"))
    return named.filter(F.length(F.col("header")) > 0)


def mapped_table(rows: DataFrame, located: DataFrame, matches: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One wide table over all files: the cells under the matched headers, as text.

    ``located`` has the header row of each file, ``matches`` its (file_id, target, header). Rows with
    more cells than the header row are left to ``overlong_rows``. ``absent`` lists the targets without a column.
    """
    positions = (
        matches.join(header_table(located), ["file_id", "header"])
        .groupBy("file_id", "target")
        .agg(F.min("position").alias("position"))
        .groupBy("file_id")
        # One entry per target: as wide as the profile.
        .agg(F.map_from_entries(F.collect_list(F.struct("target", "position"))).alias("slot"))
    )
    files = located.select("file_id", "header_row", F.size("cells").alias("width")).join(positions, "file_id")
    data = rows.join(files, "file_id").filter((F.col("row_id") > F.col("header_row")) & (F.size("cells") <= F.col("width")))
    cells = [F.get("cells", F.try_element_at("slot", F.lit(t))).alias(t) for t in targets]
    absent = F.array_except(F.array(*map(F.lit, targets)), F.map_keys("slot"))
    return data.select("file_id", "row_id", *cells, absent.alias("absent"))


def overlong_rows(rows: DataFrame, located: DataFrame) -> DataFrame:
    """Data rows with more cells than their header row: under which header a cell belongs is not known."""
    files = located.select("file_id", "header_row", F.size("cells").alias("width"))
    data = rows.join(files, "file_id").filter((F.col("row_id") > F.col("header_row")) & (F.size("cells") > F.col("width")))
    return data.select("file_id", "row_id", "cells")


def string_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    delimiter: str = ",",
    encoding: str = "UTF-8",
    columns: Sequence[str] | None = None,
    multiline: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Uniform delimited files, every column as text.

    Adds ``_corrupt_record`` (the line, where its cell count differs from the header's),
    ``file_path`` and ``row_id``, which grows along each file.
    """
    path = path if isinstance(path, str) else list(path)
    reader = (
        spark.read.option("header", "true").option("sep", delimiter).option("encoding", encoding)
        .option("quote", '"').option("escape", '"').option("multiLine", str(multiline).lower())
    )
    names = list(columns) if columns else reader.csv(path).columns
    df = (
        reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        # Cells must be counted even when a query needs only some of the columns.
        .option("columnPruning", "false")
        .schema(string_schema([*names, CORRUPT])).csv(path)
        .withColumn("file_path", F.col("_metadata.file_path"))
        .withColumn("row_id", F.monotonically_increasing_id())
    )
    return df if max_rows is None else df.limit(max_rows)


def quarantine(df: DataFrame) -> DataFrame:
    """Lines whose cell count differs from the header's."""
    keep = [c for c in df.columns if c in ("file_path", "row_id")]
    # Spark refuses to scan the corrupt column alone, so the filter looks at a data column as well.
    data = next(c for c in df.columns if c not in (*keep, CORRUPT))
    scanned = F.length(F.coalesce(F.col(f"`{data}`"), F.lit(""))) >= 0
    return df.filter(F.col(CORRUPT).isNotNull() & scanned).select(*keep, CORRUPT)


def well_formed(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def contiguous_ids(df: DataFrame, order: str = "row_id", name: str = "row_no") -> DataFrame:
    """Number all rows from 0 without gaps by a whole-number column; each run of ids starts after the counts of those before."""
    numbered = number_hot(df.withColumn("__all", F.lit(1)), ["__all"], [F.col(order)], [F.expr(f"`{order}` div {ID_RUN}")], name)
    return numbered.withColumn(name, F.col(name) - 1).drop("__all")
