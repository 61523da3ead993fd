"""Records over lines and chunks, sheets as partitions, files committed together."""

import csv
import hashlib
import io
import random
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from schemagate.operators import invoices
from schemagate.plans.process import process_files
from schemagate.profiles import load_profile
from schemagate.sinks.export import write_document_files
from schemagate.sources import files, records, workbook

BUDGET = load_profile("budget_execution_v1")
NAME = "substring_index(file_id, '/', -1)"


def cells_of(df, name):
    return [r.cells for r in df.filter(f"{NAME} = '{name}'").orderBy("row_id").collect()]


def test_quoted_breaks_and_tails(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'h,i\r\n1,"two\r\nlines, and ""more"""\r\n\r\n"a"b,5" pipe\r\n"\n",""\n')
    (tmp_path / "mac.csv").write_bytes(b'h;i\r"x\ry";2\r')
    (tmp_path / "open.csv").write_bytes(b'h,i\n1,"never\nclosed\n')
    found = files.mixed_records(files.list_files(spark, str(tmp_path)))
    assert cells_of(found.rows, "a.csv") == [["h", "i"], ["1", 'two\r\nlines, and "more"'], ["ab", '5" pipe'], ["\n", ""]]
    assert cells_of(found.rows, "mac.csv") == [["h", "i"], ["x\ry", "2"]]
    assert rows(found.unclosed.selectExpr(NAME)) == [("open.csv",)] and found.rows.filter(f"{NAME} = 'open.csv'").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_large_file_over_many_chunks(spark, tmp_path, seed):
    """A file of many tasks gives the same records as the csv module reading it as a whole."""
    r = random.Random(seed)
    pieces = ["a", "b c", '"', ",", "\n", "\r\n", "", "x" * 30, "й"]
    want = [["".join(r.choices(pieces, k=r.randint(0, 6))) for _ in range(r.randint(2, 4))] for _ in range(400)]
    text = io.StringIO(newline="")
    csv.writer(text, quoting=csv.QUOTE_ALL if seed == 2 else csv.QUOTE_MINIMAL).writerows(want)
    (tmp_path / "big one+1.csv").write_bytes(text.getvalue().encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = records.read_lines(spark, [str(tmp_path / "big one+1.csv")])
        assert lines.select("chunk").distinct().count() > 10
        got = records.split_records(lines, ",").rows.orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [x.row_id for x in got] == list(range(len(want))) and [list(x.cells) for x in got] == want


def test_lines_in_front_are_skipped(spark, tmp_path):
    (tmp_path / "x.csv").write_text('odd "title\n\na,b\n"1\n",2\n3,4\n')
    got = files.read_mixed(files.list_files(spark, str(tmp_path)), delimiter=",", skip_rows=2, max_rows=1)
    assert cells_of(got, "x.csv") == [["a", "b"], ["1\n", "2"]]


def test_folder_is_read_once_and_knows_absent_columns(spark, tmp_path):
    head = "Period,Department,Budget Line,Planned Amount,Executed Amount"
    (tmp_path / "all.csv").write_text(f'{head}\n2024-02,"Har\nbour",HB-1,10.00,5.00\n2024-02,,HB-2,10.00,5.00\n')
    (tmp_path / "nocol.csv").write_text("Period,Budget Line,Planned Amount,Executed Amount\n2024-03,A,1.00,1.00\n2024-03,B,2.00,1.00\n")
    checked, matches, left_out = process_files(files.list_files(spark, str(tmp_path)), BUDGET)
    for table in (checked.annotated, matches):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "binaryFile" not in plan and " text" not in plan
    key = F.regexp_extract("row_id", "[^/]+$", 0).alias("key")
    assert rows(checked.errors.select(key, "column", "reason")) == [("all.csv#2", "department", "required_field_missing"), ("nocol.csv#-1", "department", "required_column_missing")]
    assert rows(checked.valid.select("department")) == [(None,), (None,), ("Har\nBour",)] and "absent" not in checked.valid.columns and left_out.count() == 0


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, props="", styles=None):
    """A workbook of {name: sheet data}."""
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN} {REL}>{props}<sheets>{listed}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
        for i, data in enumerate(sheets.values()):
            if data is not None:
                z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{data}</sheetData></worksheet>")


STYLES = """<numFmts><numFmt numFmtId="164" formatCode="dd.mm.yyyy"/><numFmt numFmtId="165" formatCode="0.00 &quot;day&quot;"/><numFmt numFmtId="166" formatCode="[Red]0.0;-0"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="22"/><xf numFmtId="166"/><xf numFmtId="21"/></cellXfs>"""


def test_typed_cells(spark, tmp_path):
    values = [("s='0'", 45000), ("s='1'", 45000), ("s='2'", 45000), ("s='3'", 45000), ("s='4'", 45000.75), ("s='5'", 1.5), ("s='6'", 0.5), ("t='b'", 1), ("t='b'", 0), ("t='e'", "#DIV/0!"), ("s='1'", 59), ("s='1'", 61), ("s='1' t='str'", 7), ("s='99'", 3)]
    data = "<row>" + "".join(f"<c {a}><v>{v}</v></c>" for a, v in values) + "</row>"
    book(tmp_path / "a.xlsx", {"S": data}, styles=STYLES)
    book(tmp_path / "b.xlsx", {"S": data}, "<workbookPr date1904='1'/>", STYLES)
    got = {r.file_id[-6:]: r.cells for r in workbook.read_workbooks(files.list_files(spark, str(tmp_path))).collect()}
    assert got["a.xlsx"] == ["45000", "2023-03-15", "2023-03-15", "45000", "2023-03-15 18:00:00", "1.5", "12:00:00", "True", "False", "#DIV/0!", "1900-02-28", "1900-03-01", "7", "3"]
    assert got["b.xlsx"][1] == "2027-03-16"


def test_sheets_are_partitions(spark, tmp_path, monkeypatch):
    """Names need workbook.xml alone (a sheet is missing here), and only the sheet wanted is read, in bounded batches."""
    many = "".join(f"<row><c><v>{i}</v></c><c><v>x</v></c></row>" for i in range(500))
    book(tmp_path / "a b.xlsx", {"One": many, "Lost": None, "Two": many})
    listing = files.list_files(spark, str(tmp_path))
    assert rows(workbook.sheet_names(listing), "sheet_no", "sheet") == [(0, "One"), (1, "Lost"), (2, "Two")]
    cells = workbook.workbook_cells(listing.select("path"), 2)
    assert cells.rdd.getNumPartitions() == 1 and cells.count() == 1000 and rows(cells.select("sheet").distinct()) == [("Two",)]
    monkeypatch.setattr(workbook, "BATCH_CELLS", 300)
    with open(tmp_path / "a b.xlsx", "rb") as f:
        assert [b.num_rows for b in workbook._batches("p", 0, "One", f)] == [300, 300, 300, 100]
    through = listing.select(F.concat(F.lit("viewfs"), F.substring("path", 5, 999)).alias("path"), "content")
    assert workbook.workbook_cells(through, "One").count() == 1000


def named_documents(spark, n):
    return spark.range(n).select(
        F.format_string("d%d/inv_%d.xml", F.col("id") % 3, "id").alias("file_path"), F.explode(F.sequence(F.lit(0), F.col("id") % 4)).alias("part_no"),
        (F.col("id") % 4 + 1).alias("n_parts"),
    ).withColumn("document", F.concat_ws("-", "file_path", "part_no", F.lit("é\r\n")))


def test_documents_appear_together(spark, tmp_path):
    named = named_documents(spark, 40).repartition(5)
    assert write_document_files(named, str(tmp_path / "out")) == named.count()
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    want = {}
    for r in sorted(named.collect()):
        want[r.file_path] = want.get(r.file_path, b"") + r.document.encode()
    assert found == want and not list((tmp_path / "out").glob("_passing*"))


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    broken = F.when(F.col("file_path").contains("inv_17"), F.raise_error(F.lit("lost"))).otherwise(F.col("document"))
    with pytest.raises(Exception, match="lost"):
        write_document_files(named_documents(spark, 40).filter("n_parts = 1 or part_no = 0").withColumn("n_parts", F.lit(1)).repartition(5).withColumn("document", broken), str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []


def test_files_equal_checksums_of_the_registry(spark, sf_dir, tmp_path):
    from schemagate.plans.queries.invoices import invoice_documents

    docs = invoice_documents(spark, sf_dir).filter("invoice_id % 50 = 0")
    registry = invoices.registry(docs)
    write_document_files(docs.join(registry.select("invoice_id", "file_path"), "invoice_id"), str(tmp_path))
    sums = {r.file_path: r.checksum for r in registry.collect() if r.file_path}
    assert sums and {str(p.relative_to(tmp_path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.rglob("*.xml")} == sums
