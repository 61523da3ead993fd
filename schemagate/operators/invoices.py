"""Invoices out of line items: exact amounts, document text, registry.

Amounts are decimals, rounded half-even to two places. Totals are sums with map-side combine. The
document of an invoice is a sequence of parts of up to ``part_lines`` lines each, mostly a single one, so
that no task ever holds more than a few parts. Names and checksums are those of the whole document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagate.functions.dates import date_prefix, parse_date
from schemagate.functions.numbers import MONEY_TYPE, money, money_product, parse_decimal
from schemagate.functions.text import safe_filename, strip
from schemagate.plans.durable import stored
from schemagate.plans.skew import flag_repeated, hot_keys, number_hot, number_within
from schemagate.profiles import Profile

PART_LINES = 100_000
CURRENCY = "EUR"

# Targets an invoice batch cannot do without.
REQUIRED_TARGETS = (
    "invoice_id", "issue_date", "supplier_name", "customer_name", "line_description", "quantity", "unit_price",
)
# Document constants.
CUSTOMIZATION_ID, PROFILE_ID, UNIT_CODE = "1.0", "bii04", "EA"
NAMESPACES = (
    ("xmlns:cbc", "urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2"),
    ("xmlns:cac", "urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2"),
    ("xmlns:xsi", "http://www.w3.org/2001/XMLSchema-instance"),
    ("xmlns", "urn:oasis:names:specification:ubl:schema:xsd:Invoice-2"),
)
TOTAL_TAGS = ("LineExtensionAmount", "TaxExclusiveAmount", "TaxInclusiveAmount", "PayableAmount")
DECLARATION = "<?xml version='1.0' encoding='UTF-8'?>\n"

ILLEGAL_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]"
ILLEGAL_MESSAGE = "text holds characters that XML does not allow"
RANGE_MESSAGE = "an amount is out of range"

PARTY_FIELDS = ("name", "tax_id", "street", "city", "postal_code", "country")
LINE_FIELDS = ("description", "quantity", "unit_price", "tax_percent", "line_net")


# --- lines and totals --------------------------------------------------------------------------


def resolve_columns(names: Sequence[str], profile: Profile) -> dict[str, str]:
    """Target to column: the first listed alias among the names, ignoring case."""
    by_lower = {n.lower(): n for n in names}
    found = {}
    for target, spec in profile.columns.items():
        hit = next((by_lower[a.lower()] for a in spec.sources if a.lower() in by_lower), None)
        if hit is not None:
            found[target] = hit
    return found


def require_targets(found: Mapping[str, str], required: Sequence[str] = REQUIRED_TARGETS) -> None:
    missing = [t for t in required if t not in found]
    if missing:
        raise ValueError(f"missing required columns for invoices: {missing}")


def line_amounts(df: DataFrame, tax_rate: Column | None = None) -> DataFrame:
    """Add ``line_net`` and ``line_tax`` to lines with exact quantity, unit_price and tax_percent.

    ``tax_rate`` is a decimal share, by default a hundredth of the percentage.
    """
    rate = F.col("tax_percent") * F.expr("0.01BD") if tax_rate is None else tax_rate
    net = money_product(F.col("quantity"), F.col("unit_price"))
    return df.withColumn("line_net", net).withColumn("line_tax", money_product(F.col("line_net"), rate))


def lines_from_table(
    df: DataFrame, profile: Profile, row_id: str, parse_text: bool = False
) -> DataFrame:
    """Canonical invoice lines from a table with the profile's column aliases.

    ``parse_text`` also reads amounts and dates in the notations of the profile.
    """
    found = resolve_columns([c for c in df.columns if c != row_id], profile)
    require_targets(found)

    def text(target: str) -> Column:
        return strip(F.col(f"`{found[target]}`").cast("string")) if target in found else F.lit(None).cast("string")

    def amount(target: str) -> Column:
        if target not in found:
            return F.lit(0).cast(MONEY_TYPE)
        return money(parse_decimal(text(target)) if parse_text else text(target))

    day = date_prefix(text("issue_date"))
    if parse_text:
        spec = profile.columns["issue_date"]
        parsed = parse_date(text("issue_date"), [*spec.format, *profile.normalization.date_formats])
        day = F.coalesce(parsed.cast("string"), day)
    lines = df.select(
        F.col(row_id).alias("row_id"),
        F.col(f"`{found['invoice_id']}`").cast("string").alias("invoice_id"),
        day.alias("issue_date"),
        text("supplier_name").alias("supplier_name"),
        F.nullif(text("supplier_tax_id"), F.lit("")).alias("supplier_tax_id"),
        text("customer_name").alias("customer_name"),
        F.nullif(text("customer_tax_id"), F.lit("")).alias("customer_tax_id"),
        text("line_description").alias("description"),
        amount("quantity").alias("quantity"),
        amount("unit_price").alias("unit_price"),
        amount("tax_percent").alias("tax_percent"),
    )
    return line_amounts(lines.filter(F.col("invoice_id").isNotNull()))


def _total(name: str) -> Column:
    """Sum of all lines; null if it, or the amount of a line, is too large for MONEY_TYPE."""
    return F.when(F.count(name) == F.count(F.lit(1)), F.sum(name).try_cast(MONEY_TYPE))


def invoice_totals(lines: DataFrame, order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Per invoice: line count, net, tax, payable, and the ``carry`` fields of its first line."""
    first = [F.min_by(F.struct(*carry), F.struct(*order)).alias("first")] if carry else []
    totals = lines.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        _total("line_net").alias("net"),
        _total("line_tax").alias("tax"),
        *first,
    )
    payable = (F.col("net") + F.col("tax")).try_cast(MONEY_TYPE).alias("payable")
    return totals.select("invoice_id", "line_count", "net", "tax", payable, *([f"first.{c}" for c in carry]))


def number_lines(
    lines: DataFrame, order: Sequence[str], chunk: Sequence[Column | str], hot_rows: int = PART_LINES
) -> DataFrame:
    """Line numbers from 1 within each invoice."""
    return number_within(lines, ["invoice_id"], [F.col(c) for c in order], chunk, "line_no", hot_rows)


def check_currency(lines: DataFrame) -> DataFrame:
    """Per invoice: its currency, and whether its lines agree on it."""
    return lines.groupBy("invoice_id").agg(
        F.min("currency").alias("currency"),
        (F.min("currency").eqNullSafe(F.max("currency"))).alias("one_currency"),
    )


def check_totals(totals: DataFrame, stated: str, tolerance: str = "0.01") -> DataFrame:
    """Flag invoices whose stated total is off by more than the tolerance."""
    off = F.abs(F.col("payable") - F.col(stated)) > F.expr(f"{tolerance}BD")
    return totals.withColumn("totals_warning", F.when(off, F.lit("totals_mismatch")))


# --- documents ---------------------------------------------------------------------------------


def escape(c: Column) -> Column:
    """Text as XML character data."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def _leaf(indent: int, tag: str, value: Column, attribute: Column | None = None) -> Column:
    opening = [F.lit(f"{'  ' * indent}<{tag}>")]
    if attribute is not None:
        opening = [F.lit(f"{'  ' * indent}<{tag} "), attribute, F.lit(">")]
    return F.concat(*opening, value, F.lit(f"</{tag}>\n"))


def _priced(currency: Column | str) -> Column:
    code = F.lit(currency) if isinstance(currency, str) else escape(currency)
    return F.concat(F.lit('currencyID="'), code, F.lit('"'))


def _node(indent: int, tag: str, *children: Column) -> Column:
    pad = "  " * indent
    return F.concat(F.lit(f"{pad}<{tag}>\n"), *children, F.lit(f"{pad}</{tag}>\n"))


def _if_text(c: Column, fragment: Column) -> Column:
    return F.when(F.length(c) > 0, fragment).otherwise(F.lit(""))


def _places(c: Column) -> Column:
    return c.cast(MONEY_TYPE).cast("string")


def line_xml(line_no: Column, line: Mapping[str, Column] | Column, currency: Column | str = CURRENCY) -> Column:
    """One invoice line as document text."""
    priced = _priced(currency)
    percent = line["tax_percent"]
    tax = F.when(
        percent > 0,
        _node(2, "cac:TaxTotal", _node(3, "cac:TaxSubtotal", _leaf(4, "cbc:Percent", _places(percent)))),
    ).otherwise(F.lit(""))
    return _node(
        1,
        "cac:InvoiceLine",
        _leaf(2, "cbc:ID", line_no.cast("string")),
        _leaf(2, "cbc:InvoicedQuantity", _places(line["quantity"]), F.lit(f'unitCode="{UNIT_CODE}"')),
        _leaf(2, "cbc:LineExtensionAmount", _places(line["line_net"]), priced),
        _node(2, "cac:Item", _leaf(3, "cbc:Description", escape(F.coalesce(line["description"], F.lit(""))))),
        _node(2, "cac:Price", _leaf(3, "cbc:PriceAmount", _places(line["unit_price"]), priced)),
        tax,
    )


def _party(role: str, party: str, columns: Sequence[str]) -> Column:
    def part(name: str) -> Column:
        column = f"{party}_{name}"
        return escape(F.coalesce(F.col(column), F.lit(""))) if column in columns else F.lit("")

    tax_id, street, city, code, country = (part(n) for n in PARTY_FIELDS[1:])
    tax = _if_text(tax_id, _node(3, "cac:PartyTaxScheme", _leaf(4, "cbc:CompanyID", tax_id)))
    address = F.lit("")
    if any(f"{party}_{n}" in columns for n in PARTY_FIELDS[2:]):
        filled = _node(
            3,
            "cac:PostalAddress",
            _if_text(street, _leaf(4, "cbc:StreetName", street)),
            _if_text(city, _leaf(4, "cbc:CityName", city)),
            _if_text(code, _leaf(4, "cbc:PostalZone", code)),
            _if_text(country, _node(4, "cac:Country", _leaf(5, "cbc:IdentificationCode", country))),
        )
        address = _if_text(F.concat(street, city, code, country), filled)
    return _node(1, role, _node(2, "cac:Party", _leaf(3, "cbc:Name", part("name")), tax, address))


def head_xml(columns: Sequence[str], currency: Column | str = CURRENCY) -> Column:
    """Document text before the lines, from the columns of an invoice row."""
    namespaces = " ".join(f'{name}="{uri}"' for name, uri in NAMESPACES)
    return F.concat(
        F.lit(f"{DECLARATION}<Invoice {namespaces}>\n"),
        _leaf(1, "cbc:CustomizationID", F.lit(CUSTOMIZATION_ID)),
        _leaf(1, "cbc:ProfileID", F.lit(PROFILE_ID)),
        _leaf(1, "cbc:ID", escape(F.col("invoice_id").cast("string"))),
        _leaf(1, "cbc:IssueDate", escape(F.coalesce(F.col("issue_date").cast("string"), F.lit("")))),
        _leaf(1, "cbc:DocumentCurrencyCode", F.lit(currency) if isinstance(currency, str) else escape(currency)),
        _party("cac:AccountingSupplierParty", "supplier", columns),
        _party("cac:AccountingCustomerParty", "customer", columns),
    )


def tail_xml(
    currency: Column | str = CURRENCY, amounts: Sequence[str] = ("net", "net", "payable", "payable")
) -> Column:
    """Document text after the lines; ``amounts`` are the columns of the four totals."""
    priced = _priced(currency)
    totals = _node(
        1,
        "cac:LegalMonetaryTotal",
        *[_leaf(2, f"cbc:{tag}", _places(F.col(c)), priced) for tag, c in zip(TOTAL_TAGS, amounts)],
    )
    return F.concat(totals, F.lit("</Invoice>\n"))


def _illegal(c: Column) -> Column:
    return F.coalesce(c.rlike(ILLEGAL_XML), F.lit(False))


def nested_lines(
    lines: DataFrame,
    order: Sequence[str],
    chunk: Sequence[Column | str],
    carry: Sequence[str] = (),
    part_lines: int = PART_LINES,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Invoices with their lines in an array: one row per invoice, several for very long ones.

    Columns: invoice_id, part_no (from 0), n_parts, first_line, lines, illegal_lines, line_count,
    net, tax, payable, carry. The lines of usual invoices are gathered in one shuffle. Only invoices with
    more than ``part_lines`` lines, at most ``rows / part_lines`` of them, are numbered and cut
    into parts first. To find those, ``ids`` may give the invoice_id of each line more cheaply. They are found when
    this is called: without any, the lines are not read and shuffled for them again.
    """
    slim = lines.select(*dict.fromkeys(["invoice_id", *order, *LINE_FIELDS, "line_tax", *carry]))
    found = stored(hot_keys(slim if ids is None else ids, ["invoice_id"], part_lines), "long-invoices")
    none, big = found.isEmpty(), F.broadcast(found)
    item = F.struct(*order, *[c for c in LINE_FIELDS if c not in order])
    bad = F.bool_or(_illegal(F.col("description"))).alias("illegal_lines")
    totals = [_total("line_net").alias("net"), _total("line_tax").alias("tax")]
    first = [F.min_by(F.struct(*carry), F.struct(*order)).alias("first")] if carry else []
    carried = [F.col(f"first.{c}") for c in carry]
    payable = (F.col("net") + F.col("tax")).try_cast(MONEY_TYPE).alias("payable")

    usual = (
        # Gathering lines shrinks nothing, so they are shuffled as they are and gathered after.
        (slim if none else slim.join(big, "invoice_id", "left_anti"))
        .repartition("invoice_id")
        .groupBy("invoice_id")
        .agg(F.sort_array(F.collect_list(item)).alias("lines"), bad, *totals, *first)
        .select(
            "invoice_id", F.lit(0).cast("bigint").alias("part_no"), F.lit(1).cast("bigint").alias("n_parts"),
            F.lit(1).cast("bigint").alias("first_line"), "lines", "illegal_lines",
            F.size("lines").cast("bigint").alias("line_count"), "net", "tax", payable, *carried,
        )
    )
    if none:
        return usual
    numbered = number_hot(
        slim.join(big, "invoice_id", "left_semi"), ["invoice_id"], [F.col(c) for c in order], chunk, "line_no"
    )
    parts = (
        numbered.withColumn("part_no", F.floor((F.col("line_no") - 1) / part_lines).cast("bigint"))
        .groupBy("invoice_id", "part_no")
        .agg(F.sort_array(F.collect_list(item)).alias("lines"), F.min("line_no").alias("first_line"), bad)
    )
    whole = (
        slim.join(big, "invoice_id", "left_semi")
        .groupBy("invoice_id")
        .agg(F.count(F.lit(1)).alias("line_count"), *totals, *first)
        .select(
            "invoice_id", F.ceil(F.col("line_count") / part_lines).cast("bigint").alias("n_parts"),
            "line_count", "net", "tax", payable, *carried,
        )
    )
    long = parts.join(whole, "invoice_id")
    return usual.unionByName(long)


def documents(invoices: DataFrame, currency: Column | str = CURRENCY) -> DataFrame:
    """Add ``document``, the text of each part; ``illegal`` tells whether XML forbids it.

    Takes nested invoices joined with issue_date and the supplier and customer fields.
    """
    columns = invoices.columns
    body = F.array_join(
        F.transform("lines", lambda line, i: line_xml(F.col("first_line") + i, line, currency)), ""
    )
    # Only these fields come from outside; the numbers need no check.
    texts = [c for c in columns if c in ("invoice_id", "issue_date") or c.split("_")[0] in ("supplier", "customer")]
    illegal = F.col("illegal_lines")
    for c in texts:
        illegal = illegal | _illegal(F.col(c).cast("string"))
    head = F.when(F.col("part_no") == 0, head_xml(columns, currency)).otherwise(F.lit(""))
    tail = F.when(F.col("part_no") == F.col("n_parts") - 1, tail_xml(currency)).otherwise(F.lit(""))
    return (
        invoices.withColumn("document", F.concat(head, body, tail))
        .withColumn("illegal", illegal)
        .drop("lines", "first_line", "illegal_lines")
    )


def document_path(invoice_id: Column) -> Column:
    return F.concat(F.lit("inv_"), safe_filename(invoice_id.cast("string")), F.lit(".xml"))


def whole_documents(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per invoice: invoice_id, carry, illegal, chars, md5 and sha256 of its whole document.

    ``carry`` are columns equal in all parts. These digests run over a text from its start to its end, so the
    parts of one document pass through one task, in order and one after the other; it holds no whole document.
    """
    kept = ["invoice_id", *carry]
    single = docs.filter(F.col("n_parts") == 1).select(
        *kept, "illegal", F.length("document").cast("bigint").alias("chars"), F.md5("document").alias("md5"),
        F.sha2("document", 256).alias("sha256"),
    )
    names = single.columns
    ordered = (
        docs.filter(F.col("n_parts") > 1)
        .select(*kept, "illegal", "part_no", "n_parts", "document")
        .repartition("invoice_id").sortWithinPartitions("invoice_id", "part_no")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, illegal, md5, sha256 = 0, False, hashlib.md5(), hashlib.sha256()
        for batch in batches:
            part_no, n_parts = batch["part_no"].to_pylist(), batch["n_parts"].to_pylist()
            for i, document in enumerate(batch["document"]):
                if part_no[i] == 0:
                    chars, illegal, md5, sha256 = 0, False, hashlib.md5(), hashlib.sha256()
                text, illegal = document.as_py(), illegal or batch["illegal"][i].as_py()
                chars = None if text is None or chars is None else chars + len(text)
                raw = (text or "").encode("utf-8")
                md5.update(raw)
                sha256.update(raw)
                if part_no[i] == n_parts[i] - 1:
                    sums = (None, None) if chars is None else (md5.hexdigest(), sha256.hexdigest())
                    own = [pa.array([illegal]), pa.array([chars], pa.int64()), *(pa.array([v], pa.string()) for v in sums)]
                    yield pa.RecordBatch.from_arrays([*batch.select(kept).slice(i, 1).columns, *own], names)

    return single.unionByName(ordered.mapInArrow(run, single.schema))


def registry(docs: DataFrame, unique_names: bool = False) -> DataFrame:
    """One row per invoice: path, currency, payable amount, checksum, status, error.

    Invoices with characters that XML forbids, or with an amount out of range, fail alone.
    The checksum is the SHA-256 of the document, of however many parts.
    ``unique_names`` says that the ids cannot turn into one file name.
    """
    rows = whole_documents(docs, ["payable"]).withColumnRenamed("sha256", "checksum")
    rows = rows.withColumn("file_path", document_path(F.col("invoice_id")))
    if not unique_names:
        rows = flag_repeated(rows, "file_path", "shared")
        suffix = F.left(F.sha2(F.col("invoice_id").cast("string"), 256), F.lit(8))
        own = F.concat(F.regexp_replace("file_path", r"\.xml$", "_"), suffix, F.lit(".xml"))
        rows = rows.withColumn("file_path", F.when(F.col("shared"), own).otherwise(F.col("file_path")))
    ok = ~F.col("illegal") & F.col("payable").isNotNull()
    return rows.select(
        F.col("invoice_id").cast("string").alias("invoice_id"),
        F.when(ok, F.col("file_path")).otherwise("").alias("file_path"),
        F.lit(CURRENCY).alias("currency"),
        F.when(ok, F.col("payable")).otherwise(F.lit(0)).cast(MONEY_TYPE).alias("payable_amount"),
        F.when(ok, F.col("checksum")).otherwise("").alias("checksum"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(ok, "").when(F.col("illegal"), ILLEGAL_MESSAGE).otherwise(RANGE_MESSAGE).alias("error"),
    )


# Fields of the first line that stand for the whole invoice.
HEAD_FIELDS = ("issue_date", "supplier_name", "supplier_tax_id", "customer_name", "customer_tax_id")


def invoice_batch(df: DataFrame, profile: Profile, row_id: str, parse_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents and registry of a table of invoice lines; ``row_id`` is the line's place in its file."""
    lines = lines_from_table(df, profile, row_id, parse_text)
    chunk = [f"floor(row_id / {PART_LINES})"]
    docs = documents(nested_lines(lines, ["row_id"], chunk, HEAD_FIELDS))
    return docs, registry(docs)


def payload_document(payloads: DataFrame) -> DataFrame:
    """Documents of ready invoices, one struct per row: id, issue_date, supplier, customer, lines, totals."""
    def party(who: str) -> list[Column]:
        fields = payloads.schema[who].dataType.fieldNames()
        return [F.col(f"{who}.{f}").alias(f"{who}_{f}") for f in PARTY_FIELDS if f in fields]

    lines = F.transform(
        "lines",
        lambda x: F.struct(
            x["id"].alias("id"), x["description"].alias("description"), x["quantity"].alias("quantity"),
            x["unit_price"].alias("unit_price"), x["tax_percent"].alias("tax_percent"),
            x["line_extension_amount"].alias("line_net"),
        ),
    )
    amounts = ("line_extension_amount", "tax_exclusive_amount", "tax_inclusive_amount", "payable_amount")
    flat = payloads.select(
        F.col("id").alias("invoice_id"), "issue_date", F.coalesce("currency", F.lit(CURRENCY)).alias("currency"),
        *party("supplier"), *party("customer"), lines.alias("lines"), *[f"totals.{a}" for a in amounts],
    )
    currency = F.col("currency")
    body = F.array_join(F.transform("lines", lambda x: line_xml(x["id"], x, currency)), "")
    document = F.concat(head_xml(flat.columns, currency), body, tail_xml(currency, amounts))
    return flat.select("invoice_id", document.alias("document"))
