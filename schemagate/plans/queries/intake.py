"""Queries of file intake, over texts and listings made from the tables."""

from pyspark.sql import functions as F

from schemagate.operators import normalize
from schemagate.plans.queries.base import load, query
from schemagate.sources import files as op
from schemagate.sources.records import split_records


@query("select doc_id, sha256(text) as checksum, n_chars from documents")
def row_checksum(spark, sf):
    content = load(spark, sf, "documents").select("doc_id", "n_chars", F.encode("text", "UTF-8").alias("content"))
    return content.select("doc_id", F.sha2("content", 256).alias("checksum"), "n_chars")


@query("select doc_id, case when mod(doc_id, 4) = 0 then 'windows-1251' else 'UTF-8' end as encoding from documents")
def encoding_detect(spark, sf):
    """A lone lead byte at the end of some texts makes them invalid UTF-8."""
    text = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.unhex(F.lit("D0")))).otherwise(text)
    return load(spark, sf, "documents").select("doc_id", op.detect_encoding(content).alias("encoding"))


SEPARATED = "case mod(doc_id, 5) when 0 then replace(text, ',', ';') when 1 then replace(text, ' ', chr(9)) when 2 then replace(text, '.', '|') when 3 then replace(text, ',', '') else text end"


def _count(c: str) -> str:
    return f"(length(t) - length(replace(t, {c}, '')))"


@query(f"""select doc_id, case when greatest(a, b, c, d) = 0 or a = greatest(a, b, c, d) then ',' when b = greatest(a, b, c, d) then ';'
  when c = greatest(a, b, c, d) then chr(9) else '|' end as delimiter
  from (select doc_id, {_count("','")} as a, {_count("';'")} as b, {_count("chr(9)")} as c, {_count("'|'")} as d
        from (select doc_id, {SEPARATED} as t from documents))""")
def delimiter_detect(spark, sf):
    """Delimiter by the whole text."""
    return load(spark, sf, "documents").select("doc_id", op.detect_delimiter(F.expr(SEPARATED)).alias("delimiter"))


@query("""select doc_id, row_id, len(string_split(line, ',')) as width, md5(replace(line, ',', '|')) as plain,
  md5(line || '|' || row_id || '||"x"') as quoted from (select doc_id, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as row_id from (select doc_id, replace(text, '"', '') as text from documents))""")
def delimited_rows(spark, sf):
    """Lines of the documents as rows of cells: as they are, and as one quoted cell among others."""
    lines = load(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split(F.replace("text", F.lit('"'), F.lit("")), "\n")).alias("row_id", "line")
    )
    comma = F.lit(",")
    wrapped = F.concat(F.lit('"'), F.col("line"), F.lit('",'), F.col("row_id").cast("string"), F.lit(',,"""x"""'))
    cells = lines.select(
        "doc_id", F.col("row_id").cast("bigint").alias("row_id"), op.split_cells(F.col("line"), comma).alias("cells"),
        op.split_cells(wrapped, comma).alias("wrapped"),
    )
    return cells.select(
        "doc_id", "row_id", F.size("cells").cast("bigint").alias("width"), F.md5(F.array_join("cells", "|")).alias("plain"),
        F.md5(F.array_join("wrapped", "|")).alias("quoted"),
    )


LETTERS, PAGE = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"


@query(f"""select doc_id, md5(case when mod(doc_id, 3) = 1 then translate(t, '{LETTERS}', '{PAGE}') else text end) as decoded
  from (select doc_id, text, 'x' || regexp_replace(text, '[^ -~]', '', 'g') as t from documents)""")
def decode_texts(spark, sf):
    """Bytes of a code page become Cyrillic text; UTF-8, with a byte order mark or without, stays as it is."""
    plain = F.concat(F.lit("x"), F.regexp_replace("text", "[^ -~]", ""))
    paged = F.encode(F.translate(plain, LETTERS, "".join(chr(b) for b in PAGE.encode("cp1251"))), "ISO-8859-1")
    utf8 = F.encode(F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("\ufeff"), "text")).otherwise(F.col("text")), "UTF-8")
    content = F.when(F.col("doc_id") % 3 == 1, paged).otherwise(utf8)
    return load(spark, sf, "documents").select("doc_id", F.md5(op.decode(content)).alias("decoded"))


@query("""select c_name, c_custkey as "Column_1", c_mktsegment as "Column_2" from customer""")
def cleanup_names(spark, sf):
    """Names are stripped, columns without one are numbered."""
    raw = load(spark, sf, "customer").select(F.col("c_name").alias(" c_name "), F.col("c_custkey").alias(" "), F.col("c_mktsegment").alias("Unnamed: 7"))
    return normalize.name_unnamed(raw)


@query("select o_orderkey as row_id, cast(o_custkey as varchar) as customer, o_orderpriority as priority from orders where o_orderkey > 100")
def reheader_rows(spark, sf):
    """Rows below the header row, under its names."""
    raw = load(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("string").alias("c0"), F.col("o_orderpriority").alias("c1"))
    return normalize.reheader(raw, "row_id", 100, ["customer", "priority"])


MIXED = "replace(replace(text, '\"', ''), chr(13), '')"


@query(f"""select doc_id, row_id, md5(case mod(row_id, 3) when 0 then left(line, 10) || chr(10) || substr(line, 11) when 1 then line || 'x' else replace(line, ',', ';') end || '|' || row_id) as cells
  from (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) - 1 as row_id from (select doc_id, {MIXED} as t from documents))""")
def mixed_rows(spark, sf):
    """Lines of the documents as records: over two lines, with text behind the closing quote, or plain and followed by an empty line."""
    lines = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.posexplode(F.split(F.expr(MIXED), "\n")).alias("i", "line"))
    line, n = F.col("line"), F.concat(F.lit(","), F.col("i").cast("string"))
    two = F.array(F.concat(F.lit('"'), F.substring(line, 1, 10)), F.concat(F.expr("substr(line, 11)"), F.lit('"'), n))
    plain = F.array(F.concat(F.replace(line, F.lit(","), F.lit(";")), n), F.lit("\r"))
    record = F.when(F.col("i") % 3 == 0, two).when(F.col("i") % 3 == 1, F.array(F.concat(F.lit('"'), line, F.lit('"x'), n, F.lit("\r")))).otherwise(plain)
    physical = lines.select("file_id", "i", F.posexplode(record).alias("k", "value"))
    physical = physical.select("file_id", F.expr("2L * i + k").alias("line_id"), "value").withColumn("chunk", F.expr("(line_id + 1) div 7"))
    rows = split_records(physical, ",").rows
    return rows.select(F.col("file_id").cast("bigint").alias("doc_id"), "row_id", F.md5(F.array_join("cells", "|")).alias("cells"))


@query("select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as row_no from orders")
def row_numbers(spark, sf):
    return op.contiguous_ids(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


LISTING = """'up/' || source || '/' || lang || '/' || cast(doc_id as string) || case mod(doc_id, 5) when 0 then '.csv' when 1 then '.XLSX'
    when 2 then '.txt' when 3 then '.pdf' else '.xls' end"""


def listing(spark, sf):
    return load(spark, sf, "documents").selectExpr(f"{LISTING} as path", "n_chars as length", "timestamp_seconds(n_chars) as modificationTime")


@query(f"""select {LISTING} as path, n_chars as length, case when mod(doc_id, 5) = 3 then 'unsupported_extension' else 'file_too_large' end as reason
  from documents where mod(doc_id, 5) = 3 or n_chars > 4000""")
def admission_errors(spark, sf):
    return op.rejected(listing(spark, sf), max_bytes=4000)


@query(f"""select source as org_id, lang as dataset_id, arg_max(path, (n_chars, path)) as path, max(n_chars) as age from
  (select *, {LISTING} as path from documents where mod(doc_id, 5) in (0, 1, 4)) group by source, lang""")
def newest_inputs(spark, sf):
    return op.newest_inputs(listing(spark, sf)).select("org_id", "dataset_id", "path", F.unix_seconds("modificationTime").alias("age"))
