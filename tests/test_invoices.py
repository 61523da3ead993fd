from decimal import Decimal

import pytest

from schemagate.operators import invoices
from schemagate.profiles import load_profile
from schemagate.sinks.export import export_documents, write_document_files

PROFILE = load_profile("einvoice_v1")
COLUMNS = "row_id bigint, `Invoice ID` string, `Issue Date` string, Supplier string, Customer string, Description string, Qty string, `Unit Price` string, `VAT %` string"
DATA = [
    (0, "F-2041", "2024-06-18 00:00", "Nordwind GmbH", "Adler & Sohn", "Pump", "1", "100", "20"),
    (1, "F-2041", "2024-06-18", "Nordwind GmbH", "Adler & Sohn", "Valve <M>", "2", "50", "20"),
]
DOCUMENT = """<?xml version='1.0' encoding='UTF-8'?>
<Invoice xmlns:cbc="urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2" xmlns:cac="urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2">
  <cbc:CustomizationID>1.0</cbc:CustomizationID>
  <cbc:ProfileID>bii04</cbc:ProfileID>
  <cbc:ID>F-2041</cbc:ID>
  <cbc:IssueDate>2024-06-18</cbc:IssueDate>
  <cbc:DocumentCurrencyCode>EUR</cbc:DocumentCurrencyCode>
  <cac:AccountingSupplierParty>
    <cac:Party>
      <cbc:Name>Nordwind GmbH</cbc:Name>
    </cac:Party>
  </cac:AccountingSupplierParty>
  <cac:AccountingCustomerParty>
    <cac:Party>
      <cbc:Name>Adler &amp; Sohn</cbc:Name>
    </cac:Party>
  </cac:AccountingCustomerParty>
"""
SECOND_LINE = """  <cac:InvoiceLine>
    <cbc:ID>2</cbc:ID>
    <cbc:InvoicedQuantity unitCode="EA">2.00</cbc:InvoicedQuantity>
    <cbc:LineExtensionAmount currencyID="EUR">100.00</cbc:LineExtensionAmount>
    <cac:Item>
      <cbc:Description>Valve &lt;M&gt;</cbc:Description>
    </cac:Item>
    <cac:Price>
      <cbc:PriceAmount currencyID="EUR">50.00</cbc:PriceAmount>
    </cac:Price>
    <cac:TaxTotal>
      <cac:TaxSubtotal>
        <cbc:Percent>20.00</cbc:Percent>
      </cac:TaxSubtotal>
    </cac:TaxTotal>
  </cac:InvoiceLine>
  <cac:LegalMonetaryTotal>
    <cbc:LineExtensionAmount currencyID="EUR">200.00</cbc:LineExtensionAmount>
    <cbc:TaxExclusiveAmount currencyID="EUR">200.00</cbc:TaxExclusiveAmount>
    <cbc:TaxInclusiveAmount currencyID="EUR">240.00</cbc:TaxInclusiveAmount>
    <cbc:PayableAmount currencyID="EUR">240.00</cbc:PayableAmount>
  </cac:LegalMonetaryTotal>
</Invoice>
"""


def test_batch(spark, tmp_path):
    docs, registry = invoices.invoice_batch(spark.createDataFrame(DATA, COLUMNS), PROFILE, "row_id")
    doc = docs.first()
    assert doc.document.startswith(DOCUMENT) and doc.document.endswith(SECOND_LINE)
    assert (doc.net, doc.tax, doc.payable) == (Decimal("200.00"), Decimal("40.00"), Decimal("240.00"))
    r = registry.first()
    assert (r.invoice_id, r.file_path, r.currency, r.payable_amount, r.status, r.error) == ("F-2041", "inv_f-2041.xml", "EUR", Decimal("240.00"), "ok", "")
    named = docs.join(registry.select("invoice_id", "file_path"), "invoice_id")
    assert write_document_files(named, str(tmp_path / "xml")) == 1
    assert (tmp_path / "xml" / "inv_f-2041.xml").read_text("utf-8") == doc.document
    export_documents(docs, str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 1


def test_bad_invoice_fails_alone(spark, tmp_path):
    bad = [(2, "INV-2", "2025-01-11", "S\x07", "C", "x", "1", "1", None), (3, "INV-3", "2025-01-11", "S", "C", None, "n/a", "1", None)]
    docs, registry = invoices.invoice_batch(spark.createDataFrame(DATA + bad, COLUMNS), PROFILE, "row_id")
    got = {r.invoice_id: (r.status, str(r.payable_amount), r.checksum == "") for r in registry.collect()}
    named = docs.join(registry.select("invoice_id", "file_path"), "invoice_id")
    assert write_document_files(named, str(tmp_path)) == 2 and len(list(tmp_path.iterdir())) == 2
    assert got == {"F-2041": ("ok", "240.00", False), "INV-2": ("error", "0.00", True), "INV-3": ("ok", "0.00", False)}


def test_notations_on_request(spark):
    row = [(0, "1", "18.06.2024", "S", "C", "x", "2", "1 000,50", "20")]
    docs, _ = invoices.invoice_batch(spark.createDataFrame(row, COLUMNS), PROFILE, "row_id", parse_text=True)
    doc = docs.first()
    assert doc.payable == Decimal("2401.20") and "<cbc:IssueDate>2024-06-18<" in doc.document


def test_required_columns(spark):
    with pytest.raises(ValueError, match="unit_price"):
        invoices.lines_from_table(spark.createDataFrame(DATA, COLUMNS).drop("Unit Price"), PROFILE, "row_id")


def test_payload(spark):
    party = "struct<name:string,tax_id:string,country:string,city:string,postal_code:string,street:string>"
    line = "struct<id:string,description:string,quantity:decimal(18,2),unit_price:decimal(18,2),line_extension_amount:decimal(18,2),tax_percent:decimal(18,2)>"
    totals = "struct<line_extension_amount:decimal(18,2),tax_exclusive_amount:decimal(18,2),tax_inclusive_amount:decimal(18,2),payable_amount:decimal(18,2)>"
    d = Decimal
    row = ("I-9", "2025-01-01", "BGN", ("S", "BG1", "BG", "Sofia", "1000", "Main 1"), ("C", None, None, None, None, None),
           [("7", "Thing", d("1.00"), d("5.00"), d("5.00"), d("0.00"))], (d("5.00"), d("5.00"), d("6.00"), d("6.00")))
    df = spark.createDataFrame([row], f"id string, issue_date string, currency string, supplier {party}, customer {party}, lines array<{line}>, totals {totals}")
    text = invoices.payload_document(df).first().document
    for part in ("<cbc:ID>7</cbc:ID>", "<cbc:CompanyID>BG1</cbc:CompanyID>", "<cbc:StreetName>Main 1</cbc:StreetName>",
                 "<cbc:IdentificationCode>BG</cbc:IdentificationCode>", '<cbc:PayableAmount currencyID="BGN">6.00</cbc:PayableAmount>'):
        assert part in text
    assert text.count("PostalAddress") == 2 and "TaxTotal" not in text


def test_files_of_a_document_in_parts(spark, tmp_path):
    lines = invoices.lines_from_table(spark.createDataFrame(DATA, COLUMNS), PROFILE, "row_id")
    docs = invoices.documents(invoices.nested_lines(lines, ["row_id"], ["row_id"], invoices.HEAD_FIELDS, part_lines=1))
    named = docs.join(invoices.registry(docs).select("invoice_id", "file_path"), "invoice_id")
    assert write_document_files(named, str(tmp_path)) == 2
    text = "".join(f.read_text("utf-8") for f in sorted(tmp_path.iterdir()))
    assert text.startswith(DOCUMENT) and text.endswith(SECOND_LINE)
