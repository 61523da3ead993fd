"""Hot groups take other plans; their rows must be the same as with plain ones."""

import hashlib
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from schemagate.operators import catalog, invoices
from schemagate.operators.profiling import duplicate_rows
from schemagate.plans import skew
from schemagate.sinks.export import write_document_files


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one group."""
    rng = random.Random(7)
    data = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(1000)) for i in range(600)]
    return spark.createDataFrame(data, "id int, k string, v int").cache()


@pytest.mark.parametrize("hot_rows", [5, 50, 10_000])
def test_number_within(skewed, hot_rows):
    got = skew.number_within(skewed, ["k"], [F.col("v"), F.col("id")], ["floor(v / 100)"], "n", hot_rows)
    want, seen = [], Counter()
    for r in sorted(skewed.collect(), key=lambda r: (r.v, r.id)):
        seen[r.k] += 1
        want.append((r.id, seen[r.k]))
    assert rows(got, "id", "n") == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_joins(spark, skewed):
    dim = spark.createDataFrame([(f"k{i}", i) for i in range(30)] + [("hot", -1)], "k string, d int")
    want = rows(skewed.join(dim, "k"), "id", "d")
    assert rows(skew.split_join(skewed, dim, "k", hot_rows=50), "id", "d") == want
    assert rows(skew.lookup_join(skewed, dim, "k", broadcast_bytes=0), "id", "d") == want
    assert rows(skew.lookup_join(skewed, dim, "k", "left"), "id", "d") == rows(skewed.join(dim, "k", "left"), "id", "d")


def test_broadcast_is_size_checked(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert skew.fits_broadcast(table) and not skew.fits_broadcast(table, 1000)


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_flag_repeated(skewed, hot_rows):
    df = skewed.withColumn("k", F.when(F.col("v") % 7 != 0, F.col("k")))
    counts = Counter(r.k for r in df.collect() if r.k is not None)
    want = sorted((r.id, counts[r.k] > 1 if r.k is not None else False) for r in df.collect())
    got = skew.flag_repeated(df, "k", "again", hot_rows)
    assert sorted(map(tuple, got.select("id", "again").collect())) == want
    assert got.columns == [*df.columns, "again"] or set(got.columns) == {*df.columns, "again"}


def test_duplicate_rows_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", ""), ("-", "a"), (None, "a"), (None, "a")], "x string, y string")
    assert duplicate_rows(df).first().duplicate_rows == 2


def test_runs_to_purge(spark):
    data = [(f"r{i:03}", "big" if i % 3 else f"d{i % 5}", i // 2) for i in range(90)]
    runs = spark.createDataFrame(data, "id string, dataset_id string, started_at int")
    want = []
    for d in {x[1] for x in data}:
        want += [x[0] for x in sorted((x for x in data if x[1] == d), key=lambda x: (x[2], x[0]), reverse=True)[3:]]
    assert sorted(r.id for r in catalog.runs_to_purge(runs, 3).collect()) == sorted(want)


def _lines(spark):
    data = [("A" if i % 3 else f"B{i % 9}", i, f"item {i} <&>", i % 4 + 1, i, 20 if i % 2 else 0) for i in range(90)]
    df = spark.createDataFrame(data, "invoice_id string, row_id bigint, description string, q int, p int, t int")
    return invoices.line_amounts(df.select(
        "invoice_id", "row_id", "description", F.col("q").cast("decimal(18,2)").alias("quantity"),
        F.col("p").cast("decimal(18,2)").alias("unit_price"), F.col("t").cast("decimal(18,2)").alias("tax_percent"),
    )).withColumn("issue_date", F.lit("2025-01-10"))


def test_documents_in_parts_add_up(spark):
    lines = _lines(spark)

    def docs(part_lines):
        nested = invoices.nested_lines(lines, ["row_id"], ["floor(row_id / 8)"], ["issue_date"], part_lines)
        return invoices.documents(nested)

    whole = {r.invoice_id: r.document for r in docs(1000).collect()}
    parts = docs(7).orderBy("invoice_id", "part_no").collect()
    joined = {}
    for r in parts:
        joined[r.invoice_id] = joined.get(r.invoice_id, "") + r.document
    assert len(parts) > len(whole) and joined == whole
    key = ["invoice_id", "payable_amount", "status"]
    assert rows(invoices.registry(docs(7)), *key) == rows(invoices.registry(docs(1000)), *key)
    assert invoices.registry(docs(7)).count() == len(whole)


def test_lines_are_numbered_only_where_an_invoice_is_long(spark):
    lines = _lines(spark)

    def plan(part_lines, ids=None):
        nested = invoices.nested_lines(lines, ["row_id"], ["floor(row_id / 8)"], ["issue_date"], part_lines, ids)
        return invoices.registry(invoices.documents(nested))._jdf.queryExecution().optimizedPlan().toString()

    assert "Window" in plan(59) and "Window" not in plan(60)
    assert "Window" not in plan(60, lines.select("invoice_id")) and "Window" in plan(60, lines.select("invoice_id").unionAll(lines.select("invoice_id")))


def test_one_checksum_and_file_on_both_sides_of_the_border(spark, tmp_path):
    lines = _lines(spark)

    def docs(part_lines):
        return invoices.documents(invoices.nested_lines(lines, ["row_id"], ["floor(row_id / 8)"], ["issue_date"], part_lines))

    def files(part_lines, name):
        named = docs(part_lines).join(invoices.registry(docs(part_lines)).select("invoice_id", "file_path"), "invoice_id")
        write_document_files(named, str(tmp_path / name))
        return {f.name: f.read_bytes() for f in (tmp_path / name).iterdir()}

    whole = {r.invoice_id: r.document for r in docs(60).collect()}  # 60 lines are the most of one invoice
    want = rows(invoices.registry(docs(60)))
    sums = rows(invoices.whole_documents(docs(60), ["line_count"]))
    assert {r[0]: r[4] for r in want} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in whole.items()}
    for part_lines in (59, 7):
        assert docs(part_lines).count() > len(whole)
        assert rows(invoices.registry(docs(part_lines))) == want and rows(invoices.whole_documents(docs(part_lines), ["line_count"])) == sums
    assert files(7, "parts") == files(60, "whole")
