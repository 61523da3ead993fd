"""Queries of cleanup and scalar normalization."""

from pyspark.sql import functions as F

from schemagate.functions import booleans, dates, numbers, text
from schemagate.functions.unicode import compose_columns
from schemagate.operators import normalize as op
from schemagate.plans.queries.base import load, query, sql_strip
from schemagate.profiles import FieldSpec, NormalizationSpec, Profile

PLAIN_NUMBER = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"

RAW_LANG = """case mod(doc_id, 6) when 0 then 'N/A' when 1 then ' ' || chr(160) || lang || chr(9)
    when 2 then source when 3 then 'NULL' when 4 then '   ' else lang || ' ' || source end"""
TOKENS = ", ".join(f"'{t}'" for t in text.NULL_TOKENS)


@query(f"""
select doc_id, nullif({sql_strip('case when raw in (' + TOKENS + ') then null else raw end')}, '') as cell,
       length({sql_strip('text')}) as text_chars
from (select doc_id, {RAW_LANG} as raw, text from documents)
""")
def null_tokens_trim(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", F.expr(RAW_LANG).alias("cell"), "text")
    return op.clean_cells(docs).select("doc_id", "cell", F.length("text").cast("bigint").alias("text_chars"))


SPARSE_A = "case when mod(o_orderkey, 3) = 0 then null else o_orderstatus end"
SPARSE_B = "case when mod(o_orderkey, 5) = 0 then null else o_orderpriority end"


@query(f"""
select * from (select o_orderkey, {SPARSE_A} as status, {SPARSE_B} as priority from orders)
where status is not null or priority is not null
""")
def drop_empty_rows(spark, sf):
    sparse = load(spark, sf, "orders").selectExpr("o_orderkey", f"{SPARSE_A} as status", f"{SPARSE_B} as priority")
    return op.drop_empty_rows(sparse, ["status", "priority"])


@query(f"select o_orderkey, {SPARSE_A} as status, o_orderpriority as priority from orders")
def drop_empty_columns(spark, sf):
    sparse = load(spark, sf, "orders").selectExpr(
        "o_orderkey", f"{SPARSE_A} as status", "nullif(o_orderstatus, o_orderstatus) as blank", "o_orderpriority as priority"
    )
    return op.drop_empty_columns(sparse)


RAW_SEGMENT = "case when mod(c_custkey, 9) = 0 then 'nan' else c_mktsegment || ' ' || c_name end"


@query(f"""
select c_custkey, upper(raw) as upper_text, lower(raw) as lower_text
from (select c_custkey, nullif({RAW_SEGMENT}, 'nan') as raw from customer)
""")
def norm_string_case(spark, sf):
    raw = F.expr(RAW_SEGMENT)
    return load(spark, sf, "customer").select(
        "c_custkey",
        text.normalize_string(raw, "upper").alias("upper_text"),
        text.normalize_string(raw, "lower").alias("lower_text"),
    )


RAW_TITLE = "p_type || '-' || p_name || ' o''neil ' || p_brand || ' 3rd'"


@query(rf"""
select p_partkey, array_to_string(list_transform(regexp_extract_all(lower({RAW_TITLE}), '\pL+|\PL+'),
       lambda x: upper(left(x, 1)) || substr(x, 2)), '') as title_text
from part
""")
def norm_title(spark, sf):
    return load(spark, sf, "part").select("p_partkey", text.title_case(F.expr(RAW_TITLE)).alias("title_text"))


UNITS = "cast(floor(o_totalprice) as bigint)"
HEAD = f"cast(cast(floor(o_totalprice / 1000) as bigint) as string)"
TAIL = f"lpad(cast(mod({UNITS}, 1000) as string), 3, '0')"
RAW_INTEGER = f"""case mod(o_orderkey, 8) when 0 then {HEAD} || ' ' || {TAIL} when 1 then {HEAD} || ',' || {TAIL}
    when 2 then cast({UNITS} as string) || '.75' when 3 then 'about ' || {HEAD} when 4 then '-' || {HEAD} || '.9'
    when 5 then ' ' || {HEAD} || ' ' when 6 then {HEAD} || 'd' else '1,5' end"""


@query(f"""
select o_orderkey, case when regexp_matches(s, '{PLAIN_NUMBER}') then cast(trunc(try_cast(s as double)) as bigint) end as units
from (select o_orderkey, replace(replace({sql_strip(RAW_INTEGER)}, ' ', ''), ',', '') as s from orders)
""")
def norm_integer(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", numbers.parse_integer(F.expr(RAW_INTEGER)).alias("units"))


CENTS = "lpad(cast(mod(cast(round(o_totalprice * 100) as bigint), 100) as string), 2, '0')"
RAW_DECIMAL = f"""case mod(o_orderkey, 8) when 0 then {HEAD} || ' ' || {TAIL} || ',' || {CENTS}
    when 1 then {HEAD} || ',' || {TAIL} when 2 then cast({UNITS} as string) || '.' || {CENTS}
    when 3 then '1,' || {HEAD} || ',' || {TAIL} when 4 then {HEAD} || '.' || {TAIL} || ',' || {CENTS}
    when 5 then 'n/a' when 6 then {HEAD} || ' ' || {TAIL} else cast({UNITS} as string) || ',' || {CENTS} end"""


@query(f"""
with raw as (select o_orderkey, {sql_strip(RAW_DECIMAL)} as s from orders),
spaces as (select o_orderkey, replace(regexp_replace(s, ' ([0-9]{{1,3}})$', '.\\1'), ' ', '') as s from raw),
commas as (select o_orderkey, replace(regexp_replace(s, ',([0-9]{{1,3}})$', '.\\1'), ',', '') as s from spaces)
select o_orderkey, case when regexp_matches(s, '{PLAIN_NUMBER}') then try_cast(s as decimal(20,6)) end as amount from commas
""")
def norm_decimal_legacy(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", numbers.parse_decimal(F.expr(RAW_DECIMAL)).alias("amount"))


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PRICE_CENTS = "cast(round(l_extendedprice * 100) as bigint)"
RAW_EU = f"""case when l_extendedprice < 1000 then 'on request' else
    cast(cast(floor(l_extendedprice / 1000) as bigint) as string) || ' ' ||
    lpad(cast(mod(cast(floor(l_extendedprice) as bigint), 1000) as string), 3, '0') || ',' ||
    lpad(cast(mod({PRICE_CENTS}, 100) as string), 2, '0') end"""


@query(f"""
select {', '.join(LINE_KEY)}, case when l_extendedprice >= 1000 then
  cast(floor(l_extendedprice) as decimal(20,6)) + cast(mod({PRICE_CENTS}, 100) / 100 as decimal(20,6)) end::decimal(20,6) as price
from lineitem
""")
def norm_decimal_locale(spark, sf):
    price = numbers.parse_decimal_locale(F.expr(RAW_EU), " ", ",")
    return load(spark, sf, "lineitem").select(*LINE_KEY, price.alias("price"))


STYLES = {
    "european": f"{HEAD} || ' ' || {TAIL} || ',' || {CENTS}",
    "compact": f"cast({UNITS} as string) || ',' || {CENTS}",
    "american": f"'1,' || {HEAD} || ',' || {TAIL} || '.' || {CENTS}",
    "plain": f"cast({UNITS} as string) || '.' || {CENTS}",
    "wordy": "o_orderstatus",
}


def _style_sql(name: str) -> str:
    return f"""select '{name}' as "column", case when cd and st then ' ' when cd and not dd then '' when dd and ct then ',' else '' end
      as thousand_sep, case when cd and st then ',' when cd and not dd then ',' else '.' end as decimal_sep from (
      select bool_or(regexp_matches(v, '[0-9]') and regexp_matches(v, ',[^ ]*$')) as cd,
             bool_or(regexp_matches(v, '[0-9]') and regexp_matches(v, '[.][^ ]*$')) as dd,
             bool_or(regexp_matches(v, '[0-9]') and contains(v, ' ')) as st,
             bool_or(regexp_matches(v, '[0-9]') and regexp_matches(v, ',.*,')) as ct
      from (select {STYLES[name]} as v from orders))"""


@query(" union all ".join(_style_sql(n) for n in STYLES))
def infer_separators(spark, sf):
    styled = load(spark, sf, "orders").selectExpr(*[f"{e} as {n}" for n, e in STYLES.items()])
    return numbers.infer_separators(styled, list(STYLES))


Y, M, D = (f"cast({part}(o_orderdate) as string)" for part in ("year", "month", "day"))
M2, D2 = f"lpad({M}, 2, '0')", f"lpad({D}, 2, '0')"
RAW_DATE = f"""case mod(o_orderkey, 9) when 0 then {Y} || '-' || {M2} || '-' || {D2} when 1 then {D} || '.' || {M} || '.' || {Y}
    when 2 then {D2} || '/' || {M2} || '/' || {Y} when 3 then '12/' || {D2} || '/' || {Y} when 4 then {Y} || '-' || {M}
    when 5 then {D2} || '.' || {M2} || '.' || right({Y}, 2) when 6 then '31.02.' || {Y} when 7 then 'soon'
    else ' ' || {Y} || '-' || {M} || '-' || {D} || ' ' end"""


def _day(pattern: str, fmt: str) -> str:
    return f"case when regexp_matches(s, '{pattern}') then try_strptime(s, '{fmt}')::date end"


@query(f"""
select o_orderkey, coalesce({_day('^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$', '%Y-%m-%d')},
  {_day('^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$', '%d.%m.%Y')}, {_day('^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$', '%d/%m/%Y')},
  {_day('^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$', '%m/%d/%Y')}, {_day('^[0-9]{4}-[0-9]{1,2}$', '%Y-%m')},
  {_day('^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{2}$', '%d.%m.%y')}) as day
from (select o_orderkey, {sql_strip(RAW_DATE)} as s from orders)
""")
def norm_date_multi(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", dates.parse_date(F.expr(RAW_DATE)).alias("day"))


def _two(part: str) -> str:
    return f"lpad(cast({part}(ts) as string), 2, '0')"


EVENT_SECOND = "lpad(cast(cast(floor(second(ts)) as int) as string), 2, '0')"
RAW_MOMENT = f"""case mod(event_id, 5)
    when 0 then cast(year(ts) as string) || '-' || {_two('month')} || '-' || {_two('day')} || ' ' || {_two('hour')} || ':' || {_two('minute')} || ':' || {EVENT_SECOND}
    when 1 then cast(year(ts) as string) || '-' || {_two('month')} || '-' || {_two('day')} || 'T' || {_two('hour')} || ':' || {_two('minute')}
    when 2 then {_two('day')} || '.' || {_two('month')} || '.' || cast(year(ts) as string) || ' ' || {_two('hour')} || ':' || {_two('minute')}
    when 3 then {_two('day')} || '/' || {_two('month')} || '/' || cast(year(ts) as string) else event_type end"""


@query("""
select event_id, case mod(event_id, 5) when 0 then date_trunc('second', ts) when 1 then date_trunc('minute', ts)
  when 2 then date_trunc('minute', ts) when 3 then date_trunc('day', ts)::timestamp end as moment from events
""")
def norm_datetime(spark, sf):
    return load(spark, sf, "events").select("event_id", dates.parse_datetime(F.expr(RAW_MOMENT)).alias("moment"))


RAW_WORD = """case l_returnflag when 'A' then ' Да ' when 'N' then case l_linestatus when 'F' then 'INACTIVE' else 'не' end
    else case when mod(l_orderkey, 3) = 0 then '1' when mod(l_orderkey, 3) = 1 then 'активен' else l_linestatus end end"""


@query(f"""
select {', '.join(LINE_KEY)}, case when s in ('да', 'yes', 'true', '1', 'активен', 'active') then true
  when s in ('не', 'no', 'false', '0', 'неактивен', 'inactive') then false end as flag
from (select *, lower({sql_strip(RAW_WORD)}) as s from lineitem)
""")
def norm_boolean(spark, sf):
    return load(spark, sf, "lineitem").select(*LINE_KEY, booleans.parse_boolean(F.expr(RAW_WORD)).alias("flag"))


RAW_EMAIL = """case mod(c_custkey, 4) when 0 then c_name || '@example.com' when 1 then ' ' || replace(c_name, '#', '.') || '@Example.COM '
    when 2 then replace(c_name, '#', '+') || '@' || c_mktsegment || '.bg' else replace(c_name, '#', '@') || '@example' end"""


@query(f"""
select c_custkey, case when regexp_matches(s, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}$') then s end as email
from (select c_custkey, lower({sql_strip(RAW_EMAIL)}) as s from customer)
""")
def norm_email(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", text.normalize_email(F.expr(RAW_EMAIL)).alias("email"))


RAW_PHONE = """case mod(c_custkey, 3) when 0 then '+359 (2) ' || cast(c_custkey as string) || '-77.88'
    when 1 then 'ext. none' else '00' || right(c_name, 9) end"""


@query(f"select c_custkey, nullif(regexp_replace({RAW_PHONE}, '[^0-9]', '', 'g'), '') as phone from customer")
def norm_phone(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", text.normalize_phone(F.expr(RAW_PHONE)).alias("phone"))


RAW_URL = """case mod(page_id, 4) when 0 then ' ' || url when 1 then replace(replace(url, 'https://', ''), 'http://', '')
    when 2 then url || ' copy' else url end"""


@query(f"""
select page_id, case when regexp_matches(u, '^https?://[^\\s<>"]+$') then u end as address
from (select page_id, case when starts_with(s, 'http://') or starts_with(s, 'https://') then s else 'https://' || s end as u
      from (select page_id, {sql_strip(RAW_URL)} as s from pages))
""")
def norm_url(spark, sf):
    return load(spark, sf, "pages").select("page_id", text.normalize_url(F.expr(RAW_URL)).alias("address"))


@query("select doc_id, sha256(text) as text_sha from documents")
def norm_unicode(spark, sf):
    """Full-width letters put into every text come back as plain ones."""
    wide = load(spark, sf, "documents").select("doc_id", F.translate("text", "aeio12", "ａｅｉｏ１２").alias("text"))
    return compose_columns(wide, ["text"]).select("doc_id", F.sha2("text", 256).alias("text_sha"))


#: Letters with their marks behind them, and the same letters in one piece.
LOOSE, JOINED = "Раи\u0306он И\u0306ога cafe\u0301 U\u0308ber", "Район Йога café Über"


@query(f"select c_custkey, nfc_normalize(c_name || ' {LOOSE}') as loose, c_mktsegment || ' {JOINED}' as joined, length(nfc_normalize(c_name || ' {LOOSE}')) as n_chars from customer")
def norm_unicode_marks(spark, sf):
    """Letters and marks become one letter where there is one; composed letters stay as they are."""
    rows = load(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(f" {LOOSE}")).alias("loose"), F.concat("c_mktsegment", F.lit(f" {JOINED}")).alias("joined"))
    return compose_columns(rows, ["loose", "joined"]).withColumn("n_chars", F.length("loose").cast("bigint"))


RAW_FILE = "' ' || p_name || ' (' || p_type || ') ' || p_brand || repeat('/x', cast(p_size as int)) || '.CSV '"


@query(f"select p_partkey, left(regexp_replace(lower({sql_strip(RAW_FILE)}), '[^a-z0-9._-]', '_', 'g'), 80) as file_name from part")
def safe_filename(spark, sf):
    return load(spark, sf, "part").select("p_partkey", text.safe_filename(F.expr(RAW_FILE)).alias("file_name"))


ORG = "'Município №' || cast(c_nationkey as string) || '!!'"
LONG_NAME = "c_name || repeat(' ' || c_mktsegment, cast(mod(c_custkey, 12) as int))"


@query(f"""
select c_custkey, case when length(n) > 90 then left(n, 80) || '-' || left(md5(f), 8) else n end as slug
from (select c_custkey, f, trim(regexp_replace(lower(f), '[^\\pL\\pN]+', '-', 'g'), '-') as n
      from (select c_custkey, {ORG} || '-' || {LONG_NAME} as f from customer))
""")
def package_slug(spark, sf):
    return load(spark, sf, "customer").select(
        "c_custkey", text.package_slug(F.expr(ORG), F.expr(LONG_NAME)).alias("slug")
    )


PATH = """'in/' || cast(page_id as string) || case mod(page_id, 7) when 0 then '.CSV' when 1 then '.xlsx' when 2 then '.xls'
    when 3 then '.json' when 4 then '.pdf' when 5 then '.tar.gz' else '' end"""


@query("""
select page_id, case mod(page_id, 7) when 0 then 'text/csv'
  when 1 then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' when 2 then 'application/vnd.ms-excel'
  when 3 then 'application/json' when 4 then 'application/pdf' else 'application/octet-stream' end as mime_type from pages
""")
def mime_type(spark, sf):
    return load(spark, sf, "pages").select("page_id", text.mime_type(F.expr(PATH)).alias("mime_type"))


@query("select o_orderkey, 'c' || cast(o_custkey as string) || '_org_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') as export_name from orders")
def export_base_name(spark, sf):
    dataset = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return load(spark, sf, "orders").select(
        "o_orderkey", text.export_base_name(F.lit("org"), dataset, F.col("o_orderdate")).alias("export_name")
    )


ORDER_PROFILE = Profile(
    "orders_text",
    {
        "order_no": FieldSpec(("Order",), "integer", required=True),
        "ordered_on": FieldSpec(("Date",), "date", format=("DD.MM.YYYY",)),
        "amount": FieldSpec(("Total",), "decimal"),
        "priority": FieldSpec(("Priority",), "string", transformation="title"),
        "open": FieldSpec(("Open",), "boolean", default=False),
    },
    normalization=NormalizationSpec(date_formats=("%Y-%m-%d",)),
)
ORDER_TEXT = {
    "Order": "cast(o_orderkey as string)",
    "Date": f"case when mod(o_orderkey, 2) = 0 then {D2} || '.' || {M2} || '.' || {Y} else {Y} || '-' || {M2} || '-' || {D2} end",
    "Total": f"cast({UNITS} as string) || ',' || {CENTS}",
    "Priority": "' ' || o_orderpriority || ' '",
    "Open": "case o_orderstatus when 'O' then 'Да' when 'F' then 'не' else '-' end",
}
ORDER_MAPPING = {"Order": "order_no", "Date": "ordered_on", "Total": "amount", "Priority": "priority", "Open": "open"}


def order_text(spark, sf):
    """Orders as a file of text columns would bring them."""
    return load(spark, sf, "orders").selectExpr(*[f"{e} as `{n}`" for n, e in ORDER_TEXT.items()])


NORMALIZED_ORDER = """o_orderkey as order_no, o_orderdate::date as ordered_on, cast(o_totalprice as decimal(18,2))::decimal(20,6) as amount,
  case o_orderpriority when '1-URGENT' then '1-Urgent' when '2-HIGH' then '2-High' when '3-MEDIUM' then '3-Medium'
  when '4-NOT SPECIFIED' then '4-Not Specified' else '5-Low' end as priority"""


@query(f"select {NORMALIZED_ORDER}, case o_orderstatus when 'O' then true when 'F' then false end as open from orders")
def normalize_table(spark, sf):
    mapped, _ = op.apply_mapping(order_text(spark, sf), ORDER_MAPPING)
    return op.normalize_table(mapped, ORDER_PROFILE)


@query(f"select {NORMALIZED_ORDER}, o_orderstatus = 'O' as open from orders")
def normalize_with_defaults(spark, sf):
    mapped, _ = op.apply_mapping(order_text(spark, sf), ORDER_MAPPING)
    return op.normalize_table(mapped, ORDER_PROFILE, apply_defaults=True)


@query("select c_custkey, sha256(c_name) as c_name, c_mktsegment from customer")
def redact_fields(spark, sf):
    people = load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return op.redact_columns(people, ["c_name", "phone"])


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey > 0 order by o_orderkey limit 10")
def preview(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return op.preview(rows, "o_orderkey", 10, after=0)
