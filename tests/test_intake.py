import os
import zipfile
from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

from schemagate.operators import normalize
from schemagate.plans.process import process_files
from schemagate.profiles import load_profile
from schemagate.sources import files, workbook

BUDGET = load_profile("budget_execution_v1")


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return path


def test_mixed_folder(spark, tmp_path):
    base = str(tmp_path / "in")
    write(f"{base}/a.csv", 'Period,Planned Amount\r\n2025-01,"1,5 ""x"""\r\n2025-02,3\r\n')
    write(f"{base}/b.csv", "Период;Планирана сума\n2025-03;150 000,50\n", "cp1251")
    write(f"{base}/c.tsv", "﻿Dept\tStatus\nx\tactive\n")
    write(f"{base}/d.pdf", "no")
    listing = files.list_files(spark, base)
    assert rows(files.rejected(listing), "reason") == [("unsupported_extension",)]
    got = files.read_mixed(files.admitted(listing))
    name = F.element_at(F.split("file_id", "/"), -1)
    assert rows(got.select(name, "row_id", F.concat_ws("#", "cells"))) == [
        ("a.csv", 0, "Period#Planned Amount"), ("a.csv", 1, '2025-01#1,5 "x"'), ("a.csv", 2, "2025-02#3"),
        ("b.csv", 0, "Период#Планирана сума"), ("b.csv", 1, "2025-03#150 000,50"), ("c.tsv", 0, "Dept#Status"), ("c.tsv", 1, "x#active"),
    ]
    checked, matches, left_out = process_files(listing, BUDGET)
    assert rows(matches.select(name, "target")) == [
        ("a.csv", "period"), ("a.csv", "planned_amount"), ("b.csv", "period"), ("b.csv", "planned_amount"),
        ("c.tsv", "department"), ("c.tsv", "status"),
    ]
    table = checked.annotated.select(F.col("period").cast("string"), "planned_amount", "department", "status")
    assert rows(table) == [
        (None, None, "X", "active"), ("2025-01-01", None, None, None), ("2025-02-01", Decimal("3.000000"), None, None),
        ("2025-03-01", Decimal("150000.500000"), None, None),
    ]
    skipped = files.read_mixed(files.admitted(listing), skip_rows=1, max_rows=1)
    assert skipped.filter("row_id = 0 and file_id like '%b.csv'").first().cells == ["2025-03", "150 000,50"]
    sums = files.checksums(listing)
    assert sums.filter(F.length("checksum") == 64).count() == 4


def test_code_page_and_blank_lines(spark, tmp_path):
    upper = bytes(b for b in range(128, 256) if b != 0x98)
    text = upper.decode("cp1251")
    frame = spark.createDataFrame([(bytearray(upper),), (bytearray(("\ufeff" + text).encode()),)], "c binary")
    assert [r[0] for r in frame.select(files.decode(F.col("c"))).collect()] == [text, text]
    write(str(tmp_path / "b" / "x.csv"), "title\n\na,b\n\n\n1,2\n\n3,4\n5,6\n")
    got = files.read_mixed(files.list_files(spark, str(tmp_path / "b")), skip_rows=1, max_rows=2)
    assert [(r.row_id, r.cells) for r in got.orderBy("row_id").collect()] == [(0, ["a", "b"]), (1, ["1", "2"]), (2, ["3", "4"])]


def test_generic_header_row(spark, tmp_path):
    base = str(tmp_path / "g")
    write(f"{base}/x.csv", "Column_1,Column_2\nmay,7\nPeriod,Department name\n2025-01,roads\n")
    checked, matches, left_out = process_files(files.list_files(spark, base), BUDGET)
    assert rows(matches, "target", "header") == [("department", "Department name"), ("period", "Period")]
    assert rows(checked.annotated.select(F.col("period").cast("string"))) == [("2025-01-01",)]


def test_uniform_files(spark, tmp_path):
    path = write(str(tmp_path / "u" / "x.csv"), 'a,b,c\n1,"2\n3",4\n')
    df = files.read_delimited(spark, path, multiline=True)
    assert rows(df, "a", "b", "c") == [("1", "2\n3", "4")]
    ragged = write(str(tmp_path / "r" / "x.csv"), "a,b\n1,2\n3,4,5\n6\n")
    df = files.read_delimited(spark, ragged)
    assert rows(files.well_formed(df), "a", "b") == [("1", "2")]
    assert rows(files.quarantine(df), files.CORRUPT) == [("3,4,5",), ("6",)]
    assert rows(files.contiguous_ids(df, "row_id"), "a", "row_no") == [("1", 0), ("3", 1), ("6", 2)]
    assert files.read_delimited(spark, ragged, max_rows=1).count() == 1


def test_newest_per_dataset(spark, tmp_path):
    for i, name in enumerate(["org/d1/old.csv", "org/d1/new.csv", "org/d2/only.xlsx", "org/d2/later.txt"]):
        os.utime(write(f"{tmp_path}/{name}", "x"), (1000 + i, 1000 + i))
    got = files.newest_inputs(files.list_files(spark, str(tmp_path)))
    assert rows(got.select("org_id", "dataset_id", F.element_at(F.split("path", "/"), -1))) == [
        ("org", "d1", "new.csv"), ("org", "d2", "only.xlsx")
    ]


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    os.makedirs(tmp_path / "w")
    with zipfile.ZipFile(tmp_path / "w" / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Empty" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/s1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Period</t></si><si><r><t>Amo</t></r><r><t>unt</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                   '<row r="2"><c r="A2"><v>45000</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {main}><sheetData/></worksheet>")
    listing = files.list_files(spark, str(tmp_path / "w"))
    assert rows(workbook.sheet_names(listing), "sheet_no", "sheet") == [(0, "Data"), (1, "Empty")]
    got = workbook.read_workbooks(listing).orderBy("row_id").collect()
    assert [(r.row_id, r.cells) for r in got] == [(0, ["Period", None, "Amount"]), (1, ["45000", None, "x"])]


def test_cleanup(spark):
    df = spark.createDataFrame([(" a ", None, None), ("NA", None, " "), (None, None, None)], "`x ` string, y string, ` ` string")
    clean = normalize.clean_cells(normalize.name_unnamed(df))
    assert clean.columns == ["x", "y", "Column_1"]
    assert rows(normalize.drop_empty_columns(normalize.drop_empty_rows(clean))) == [("a",)]
    assert normalize.strip_names(df).columns == ["x", "y", ""]
    numbered = spark.createDataFrame([(0, "t", None), (1, "A", "B"), (2, "1", "2")], "row_id int, c0 string, c1 string")
    assert rows(normalize.reheader(numbered, "row_id", 1, ["A", "B"])) == [(2, "1", "2")]
    assert normalize.reheader(numbered, "row_id", 1, ["A"]).columns == ["row_id", "c0", "c1"]
    mapped, left = normalize.apply_mapping(numbered, {"c0": "z"})
    assert mapped.columns == ["row_id", "z", "c1"] and left == ["row_id", "c1"]


def test_nothing_vanishes_from_a_folder(spark, tmp_path):
    head = "Period,Department,Budget Line,Planned Amount,Executed Amount"
    (tmp_path / "blank.csv").write_text(f"\n\n{head}\n2024-02,Harbour,HB-1,10.00,5.00\n")
    (tmp_path / "late.csv").write_text("".join(f"{i},,,,\n" for i in range(10)) + f"{head}\n2024-03,Parks,PK-1,20.00,5.00\n")
    (tmp_path / "commas.csv").write_text(head.replace(",", ";") + ";" + "," * 200 + "\n" + "2024-04;Roads;RD-1;30.00;5.00;x\n" * 60)
    (tmp_path / "ragged.csv").write_text(f"{head}\n2024-05,Roads,RD-2,150,000.50,72.150,80\n2024-05,Roads,RD-3,40.00,5.00\n")
    (tmp_path / "other.csv").write_text("qqq,zzz\n1,2\n")
    (tmp_path / "old.xls").write_bytes(b"x")
    (tmp_path / "note.pdf").write_bytes(b"x")
    checked, _, left_out = process_files(files.list_files(spark, str(tmp_path)), BUDGET)
    name = F.substring_index("file_id", "/", -1).alias("name")
    assert rows(left_out.select(name, "row_id", "reason")) == [
        ("note.pdf", None, "unsupported_extension"), ("old.xls", None, "no_reader"), ("other.csv", None, "no_matching_header"), ("ragged.csv", 1, "more_cells_than_headers"),
    ]
    planned = {float(r.planned_amount) for r in checked.valid.collect()}
    assert {10.0, 20.0, 30.0, 40.0} <= planned and 150.0 not in planned
