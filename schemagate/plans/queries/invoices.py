"""Queries of the invoice batch: orders are invoices, line items their lines."""

from pyspark.sql import functions as F

from schemagate.functions.dates import date_prefix
from schemagate.operators import invoices as op
from schemagate.plans.queries.base import load, query
from schemagate.plans.skew import fits_broadcast, lookup_join, split_join

LINE = ("l_linenumber", "l_partkey", "l_suppkey")
# Equal lines of an order differ in nothing that a document shows.
ORDER = (*LINE, "quantity", "rate")
# Coarse steps of that order, to number the lines of one huge invoice piece by piece.
CHUNK = ["l_linenumber", "floor(l_partkey / 1000)"]


def raw_lines(spark, sf):
    """Line items priced by their part."""
    prices = load(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("description"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price"),
    )
    items = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), *LINE, "l_returnflag",
        F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), F.col("l_tax").cast("decimal(4,2)").alias("rate"),
    )
    # A few parts may have most of the lines.
    return lookup_join(items, prices, "l_partkey") if fits_broadcast(prices) else split_join(items, prices, "l_partkey")


def line_ids(spark, sf):
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("invoice_id"))


def lines(spark, sf):
    taxed = raw_lines(spark, sf).withColumn("tax_percent", (F.col("rate") * 100).cast("decimal(7,2)"))
    return op.line_amounts(taxed, tax_rate=F.col("rate"))


LINES_SQL = """
  select l_orderkey as invoice_id, l_linenumber, l_partkey, l_suppkey, p_name as description, l_quantity::decimal(12,2) as quantity,
    p_retailprice::decimal(12,2) as unit_price, (l_tax::decimal(4,2) * 100)::decimal(18,2) as tax_percent, l_tax::decimal(4,2) as rate,
    round_even(l_quantity::decimal(12,2) * p_retailprice::decimal(12,2), 2)::decimal(18,2) as line_net,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) as line_no
  from lineitem join part on l_partkey = p_partkey"""
TAXED_SQL = f"select *, round_even(line_net * rate, 2)::decimal(18,2) as line_tax from ({LINES_SQL})"
TOTALS_SQL = f"""select invoice_id, count(*) as line_count, sum(line_net)::decimal(18,2) as net, sum(line_tax)::decimal(18,2) as tax,
  (sum(line_net) + sum(line_tax))::decimal(18,2) as payable, arg_min(l_suppkey, line_no) as l_suppkey from ({TAXED_SQL}) group by invoice_id"""


@query(f"""select invoice_id, line_no, l_linenumber, l_partkey, l_suppkey, quantity, unit_price, line_net, line_tax from ({TAXED_SQL})""")
def einvoice_lines(spark, sf):
    numbered = op.number_lines(lines(spark, sf), ORDER, CHUNK)
    return numbered.select("invoice_id", "line_no", *LINE, "quantity", "unit_price", "line_net", "line_tax")


RAW_AMOUNT = """case mod(l_orderkey, 5) when 0 then cast(l_extendedprice as decimal(18,3))::string when 1 then ' 12.345'
    when 2 then 'n/a' when 3 then null else cast(l_quantity as decimal(18,3))::string || '5' end"""


@query(f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(round_even(try_cast(v as decimal(28,10)), 2), 0)::decimal(18,2) as amount
  from (select *, {RAW_AMOUNT} as v from lineitem)""")
def money_amounts(spark, sf):
    raw = load(spark, sf, "lineitem").withColumn("v", F.expr(RAW_AMOUNT))
    return raw.select("l_orderkey", *LINE, op.money(F.col("v")).alias("amount"))


LARGE = "case mod(l_orderkey, 7) when 0 then '12345678901234567.00' when 1 then '1e40' else cast(l_quantity as decimal(18,3))::string end"


@query(f"""select l_orderkey as invoice_id, count(*) as line_count, case when bool_or(large) then 0 else sum(net) end::decimal(18,2) as payable_amount,
  case when bool_or(large) then 'error' else 'ok' end as status, case when bool_or(large) then '{op.RANGE_MESSAGE}' else '' end as error from
  (select l_orderkey, mod(l_orderkey, 7) in (0, 1) and l_linenumber = 1 as large, l_quantity::decimal(18,2) as net from lineitem) group by l_orderkey""")
def invoice_amount_range(spark, sf):
    """An amount beyond 16 digits before the point makes its invoice fail, and no other."""
    raw = load(spark, sf, "lineitem").withColumn("v", F.expr(f"case when l_linenumber = 1 then {LARGE} else cast(l_quantity as decimal(18,3))::string end"))
    priced = raw.select(
        F.col("l_orderkey").alias("invoice_id"), *LINE, F.lit("x").alias("description"), F.lit(1).cast("decimal(18,2)").alias("quantity"),
        op.money(F.col("v")).alias("unit_price"), F.lit(0).cast("decimal(18,2)").alias("tax_percent"),
    )
    nested = op.nested_lines(op.line_amounts(priced), [*LINE, "unit_price"], CHUNK)
    whole = op.documents(nested.withColumn("issue_date", F.lit("2025-01-10"))).select("invoice_id", "line_count")
    registry = op.registry(op.documents(nested.withColumn("issue_date", F.lit("2025-01-10"))), unique_names=True)
    found = registry.select(F.col("invoice_id").cast("bigint").alias("invoice_id"), "payable_amount", "status", "error")
    return whole.join(found, "invoice_id").select("invoice_id", "line_count", "payable_amount", "status", "error")


@query(TOTALS_SQL)
def einvoice_totals(spark, sf):
    return op.invoice_totals(lines(spark, sf), ORDER, ["l_suppkey"])


@query(f"""select invoice_id, 0::bigint as part_no, count(*) as line_count, sum(line_net)::decimal(18,2) as array_net,
  min(line_no) filter (line_net = top) as dearest_line
  from (select *, max(line_net) over (partition by invoice_id) as top from ({TAXED_SQL})) group by invoice_id""")
def einvoice_nested_lines(spark, sf):
    """Size, total and position of the dearest line, all read from the nested arrays."""
    nested = op.nested_lines(lines(spark, sf), ORDER, CHUNK, ids=line_ids(spark, sf))
    nets = F.transform("lines", lambda x: x["line_net"])
    total = F.aggregate(nets, F.lit(0).cast("decimal(18,2)"), lambda acc, x: (acc + x).cast("decimal(18,2)"))
    return nested.select(
        "invoice_id", "part_no", "line_count", total.alias("array_net"),
        (F.array_position(nets, F.array_max(nets)) + F.col("first_line") - 1).alias("dearest_line"),
    )


CUSTOMER_NAME = "case when mod(o_custkey, 5) = 0 then c_name || ' & Sons <BG>' else c_name end"


def heads(spark, sf):
    """Issue date and customer of each invoice."""
    people = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lookup_join(orders, people, "o_custkey").select(
        F.col("o_orderkey").alias("invoice_id"),
        date_prefix(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("issue_date"),
        F.expr(CUSTOMER_NAME).alias("customer_name"),
        F.concat(F.lit("BG"), F.col("o_custkey").cast("string")).alias("customer_tax_id"),
    )


def suppliers(spark, sf):
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("supplier_name"))


def invoice_documents(spark, sf):
    nested = op.nested_lines(lines(spark, sf), ORDER, CHUNK, ["l_suppkey"], ids=line_ids(spark, sf))
    named = lookup_join(nested, suppliers(spark, sf), "l_suppkey")
    return op.documents(named.join(heads(spark, sf), "invoice_id"))


def _tag(tag: str, value: str, attribute: str = "") -> str:
    return f"'<{tag}{attribute}>' || {value} || '</{tag}>' || chr(10)"


def _esc(value: str) -> str:
    return f"replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


EUR = ' currencyID="EUR"'
NL = " || chr(10) || "
LINE_XML_SQL = (
    f"""'  <cac:InvoiceLine>'{NL}'    ' || {_tag('cbc:ID', 'line_no::varchar')} || '    ' ||
    {_tag('cbc:InvoicedQuantity', 'quantity::varchar', ' unitCode="EA"')} || '    ' ||
    {_tag('cbc:LineExtensionAmount', 'line_net::varchar', EUR)} || '    <cac:Item>'{NL}'      ' ||
    {_tag('cbc:Description', _esc('description'))} || '    </cac:Item>'{NL}'    <cac:Price>'{NL}'      ' ||
    {_tag('cbc:PriceAmount', 'unit_price::varchar', EUR)} || '    </cac:Price>'{NL} case when tax_percent > 0 then
    '    <cac:TaxTotal>'{NL}'      <cac:TaxSubtotal>'{NL}'        ' || {_tag('cbc:Percent', 'tax_percent::varchar')} ||
    '      </cac:TaxSubtotal>'{NL}'    </cac:TaxTotal>' || chr(10) else '' end || '  </cac:InvoiceLine>' || chr(10)"""
)
NAMESPACE_SQL = " ".join(f'{n}="{u}"' for n, u in op.NAMESPACES)


def _party_sql(role: str, name: str, tax_id: str | None = None) -> str:
    scheme = (
        f"'      <cac:PartyTaxScheme>'{NL}'        ' || {_tag('cbc:CompanyID', tax_id)} || '      </cac:PartyTaxScheme>'{NL}"
        if tax_id else ""
    )
    return f"'  <cac:{role}>'{NL}'    <cac:Party>'{NL}'      ' || {_tag('cbc:Name', _esc(name))} || {scheme} '    </cac:Party>'{NL}'  </cac:{role}>' || chr(10)"


DOCUMENT_SQL = f"""
  '<?xml version=''1.0'' encoding=''UTF-8''?>'{NL}'<Invoice {NAMESPACE_SQL}>'{NL}'  ' || {_tag('cbc:CustomizationID', "'1.0'")} ||
  '  ' || {_tag('cbc:ProfileID', "'bii04'")} || '  ' || {_tag('cbc:ID', 't.invoice_id::varchar')} || '  ' ||
  {_tag('cbc:IssueDate', "strftime(o_orderdate, '%Y-%m-%d')")} || '  ' || {_tag('cbc:DocumentCurrencyCode', "'EUR'")} ||
  {_party_sql('AccountingSupplierParty', 's_name')} ||
  {_party_sql('AccountingCustomerParty', CUSTOMER_NAME, "'BG' || o_custkey::varchar")} || body ||
  '  <cac:LegalMonetaryTotal>'{NL}'    ' || {_tag('cbc:LineExtensionAmount', 'net::varchar', EUR)} || '    ' ||
  {_tag('cbc:TaxExclusiveAmount', 'net::varchar', EUR)} || '    ' || {_tag('cbc:TaxInclusiveAmount', 'payable::varchar', EUR)} ||
  '    ' || {_tag('cbc:PayableAmount', 'payable::varchar', EUR)} || '  </cac:LegalMonetaryTotal>'{NL}'</Invoice>' || chr(10)"""
DOCUMENTS_SQL = f"""
  select t.invoice_id, payable, line_count, {DOCUMENT_SQL} as document from ({TOTALS_SQL}) t
  join (select invoice_id, string_agg({LINE_XML_SQL}, '' order by line_no) as body from ({LINES_SQL}) group by invoice_id) b
    on t.invoice_id = b.invoice_id
  join orders on o_orderkey = t.invoice_id join customer on c_custkey = o_custkey join supplier on s_suppkey = t.l_suppkey"""


@query(f"""select invoice_id::varchar as invoice_id, 'inv_' || invoice_id::varchar || '.xml' as file_path, 'EUR' as currency,
  payable as payable_amount, sha256(document) as checksum, 'ok' as status, '' as error from ({DOCUMENTS_SQL})""")
def einvoice_registry(spark, sf):
    # The ids are digits only, so no two of them make the same file name.
    return op.registry(invoice_documents(spark, sf), unique_names=True)


@query(f"select invoice_id, 0::bigint as part_no, line_count, length(document) as chars, md5(document) as digest from ({DOCUMENTS_SQL})")
def einvoice_xml_checksum(spark, sf):
    whole = op.whole_documents(invoice_documents(spark, sf), ["line_count"])
    return whole.select("invoice_id", F.lit(0).cast("bigint").alias("part_no"), "line_count", "chars", F.col("md5").alias("digest"))


# Control characters are put into the ids of some customers' invoices, spaces and case into others.
ODD_ID = """case mod(o_custkey, 9) when 0 then 'A' || chr(7) || cast(o_orderkey as string) when 1 then 'INV ' || cast(o_orderkey as string)
    when 2 then 'A/' || cast(o_custkey as string) when 3 then 'a?' || cast(o_custkey - 1 as string) else cast(o_orderkey as string) end"""


def _odd(df, spark, sf):
    ids = load(spark, sf, "orders").selectExpr("o_orderkey as invoice_id", f"{ODD_ID} as odd_id")
    return df.join(ids, "invoice_id").drop("invoice_id").withColumnRenamed("odd_id", "invoice_id")


def odd_lines(spark, sf):
    return _odd(lines(spark, sf), spark, sf)


ODD_LINE_SQL = f"select t.* exclude (invoice_id), {ODD_ID} as invoice_id from ({TAXED_SQL}) t join orders on o_orderkey = t.invoice_id"
SAFE_SQL = "'inv_' || left(regexp_replace(lower(invoice_id), '[^a-z0-9._-]', '_', 'g'), 80)"


@query(f"""
with o as (select invoice_id, sum(line_net + line_tax)::decimal(18,2) as payable, {SAFE_SQL} as safe from ({ODD_LINE_SQL}) group by invoice_id),
n as (select *, count(*) over (partition by safe) as sharing, contains(invoice_id, chr(7)) as bad from o)
select invoice_id, case when bad then '' when sharing > 1 then safe || '_' || left(sha256(invoice_id), 8) || '.xml' else safe || '.xml' end as file_path,
  case when bad then 0 else payable end::decimal(18,2) as payable_amount, case when bad then 'error' else 'ok' end as status,
  case when bad then '{op.ILLEGAL_MESSAGE}' else '' end as error from n
""")
def invoice_status(spark, sf):
    """Ids with characters XML forbids fail alone; ids that make one file name get a suffix."""
    nested = op.nested_lines(odd_lines(spark, sf), ORDER, CHUNK, ids=_odd(line_ids(spark, sf), spark, sf))
    docs = op.documents(nested.withColumn("issue_date", F.lit("2025-01-10")))
    return op.registry(docs).select("invoice_id", "file_path", "payable_amount", "status", "error")


@query("""
select l_orderkey as invoice_id, min(c) as currency, min(c) = max(c) as one_currency from
  (select l_orderkey, case l_returnflag when 'R' then 'USD' else 'EUR' end as c from lineitem) group by l_orderkey
""")
def invoice_currency(spark, sf):
    coded = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), F.when(F.col("l_returnflag") == "R", "USD").otherwise("EUR").alias("currency")
    )
    return op.check_currency(coded)


@query(f"""
select invoice_id, payable, stated, case when abs(payable - stated) > 0.01 then 'totals_mismatch' end as totals_warning from
  (select invoice_id, payable, (payable + (mod(invoice_id, 4) * 0.01)::decimal(18,2))::decimal(18,2) as stated from ({TOTALS_SQL}))
""")
def invoice_totals_check(spark, sf):
    totals = op.invoice_totals(lines(spark, sf), ORDER)
    stated = totals.withColumn("stated", F.expr("cast(payable + mod(invoice_id, 4) * 0.01 as decimal(18,2))"))
    return op.check_totals(stated, "stated").select("invoice_id", "payable", "stated", "totals_warning")
