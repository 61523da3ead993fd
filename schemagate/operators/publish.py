"""What to publish: create or update decisions and the records to send, computed as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagate.functions.text import package_slug

GENERATOR = "schemagate"

# Tags of every package, and the resources a package has.
FIXED_TAGS = ("budget", "government", "automated")
RESOURCES = (
    ("CSV Data", "CSV", "text/csv"),
    ("JSON Data", "JSON", "application/json"),
    ("Processing Metadata", "JSON", "application/json"),
)
# Defaults of a package record.
DEFAULT_NOTES, DEFAULT_LICENSE = "Automated data publication", "cc-by"


def publish_plan(candidates: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """Create or update each dataset (org_id, dataset_id), keyed by its package name.

    ``existing`` has name, id and created_date of known packages. A package keeps its first
    creation date; one without gets ``now``.
    """
    named = candidates.withColumn("package_name", package_slug(F.col("org_id"), F.col("dataset_id")))
    known = existing.select(
        F.col("name").alias("package_name"), F.col("id").alias("package_id"), F.col("created_date").alias("known_date")
    )
    return (
        named.join(known, "package_name", "left")
        .withColumn("action", F.when(F.col("package_id").isNull(), "create").otherwise("update"))
        .withColumn("created_date", F.coalesce("known_date", now))
        .drop("known_date")
    )


def resource_plan(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Create or update each resource (package_id, name)."""
    known = existing.select("package_id", "name", F.col("id").alias("resource_id"))
    return wanted.join(known, ["package_id", "name"], "left").withColumn(
        "action", F.when(F.col("resource_id").isNull(), "create").otherwise("update")
    )


def standard_resources(packages: DataFrame) -> DataFrame:
    """The resources every package gets, one row each."""
    listed = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(f).alias("format"), F.lit(m).alias("mimetype")) for n, f, m in RESOURCES]
    )
    return packages.withColumn("r", F.explode(listed)).select(*packages.columns, "r.*")


def merged_tags(tags: Column, profile: Column, fixed: Sequence[str] = FIXED_TAGS) -> Column:
    """Distinct tags in order: given, profile, fixed."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    named = F.when(F.length(profile) > 0, F.array(profile)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(own, named, F.array(*map(F.lit, fixed)))))


def package_record(plan: DataFrame, now: Column) -> DataFrame:
    """Add ``record``, the package metadata as a struct.

    Reads package_name, org_id, created_date, package_id and, where present, title, description,
    author, maintainer, license, private, profile, processing_date, quality_score,
    validation_status and tags.
    """
    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in plan.columns else default

    text = lambda name: given(name, F.lit("")).cast("string")
    now_text = now.cast("string")
    pairs = (
        ("profile", text("profile")),
        ("processing_date", given("processing_date", now_text).cast("string")),
        ("data_quality_score", text("quality_score")),
        ("validation_status", text("validation_status")),
        ("generated_by", F.lit(GENERATOR)),
        ("last_updated", now_text),
        ("created_date", F.col("created_date").cast("string")),
    )
    tags = F.col("tags") if "tags" in plan.columns else F.array().cast("array<string>")
    record = F.struct(
        F.col("package_id").alias("id"),
        F.col("package_name").alias("name"),
        given("title", F.concat(F.lit("Dataset "), F.col("package_name"))).alias("title"),
        given("description", F.lit(DEFAULT_NOTES)).alias("notes"),
        given("author", F.lit(GENERATOR)).alias("author"),
        text("author_email").alias("author_email"),
        given("maintainer", F.col("org_id")).alias("maintainer"),
        text("maintainer_email").alias("maintainer_email"),
        given("license", F.lit(DEFAULT_LICENSE)).alias("license_id"),
        F.col("org_id").alias("owner_org"),
        given("private", F.lit(False)).alias("private"),
        F.lit("active").alias("state"),
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]).alias("extras"),
        F.transform(merged_tags(tags, text("profile")), lambda t: F.struct(t.alias("name"))).alias("tags"),
    )
    return plan.withColumn("record", record)


def resource_record(manifest: DataFrame) -> DataFrame:
    """Add ``record``, the resource metadata, to rows of package_id, name, format, mime_type, size, modified."""
    record = F.struct(
        "package_id",
        "name",
        F.concat(F.col("name"), F.lit(f" generated by {GENERATOR}")).alias("description"),
        F.upper("format").alias("format"),
        F.col("mime_type").alias("mimetype"),
        F.col("size_bytes").alias("size"),
        F.col("modified_at").cast("string").alias("last_modified"),
    )
    return manifest.withColumn("record", record)
