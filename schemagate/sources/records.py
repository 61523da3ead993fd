"""Records of delimited files whose quoted cells may hold line breaks, for files of any size.

Files are read as lines, so one large file spreads over many tasks. Whether a line starts inside a quoted cell depends
on all lines before it, but each line on its own is one of four maps from "inside or not" before to after it: it may
keep that, turn it round, or end inside or outside whatever was before. Maps compose, so each chunk of a file (what one
task reads of it) is summed up to one map by a window, and a scan over the chunks of a file, one row each, tells every
chunk how it starts. Record numbers are summed up in the same scan. Lines are shuffled once, by chunk; only records
that span lines are gathered, each on its own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Delimiters in order of preference.
DELIMITERS = (",", ";", "\t", "|")
#: Files whose formats are sent to every task; about 200 bytes each.
FEW_FILES = 100_000
# The upper half of a code page as Latin-1 reads it, and as the Cyrillic page does.
LATIN, CYRILLIC = "".join(map(chr, range(128, 256))), bytes(range(128, 256)).decode("cp1251", "replace")
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'
LINES = "file_id string, chunk bigint, line_id bigint, value string"


def decode_bytes(content: Column, valid: Column) -> Column:
    """Text of bytes: UTF-8 where they are valid in it, else the Cyrillic code page."""
    # Spark itself decodes by this code page only under a legacy setting.
    return F.when(valid, content.cast("string")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), LATIN, CYRILLIC))


def delimiter_of(counts: Sequence[Column]) -> Column:
    """The delimiter of the highest count, the first of equals; comma if all are zero."""
    counted = [F.struct(n.alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("delimiter")) for i, (n, d) in enumerate(zip(counts, DELIMITERS))]
    best = F.array_max(F.array(*counted))
    return F.when(best["n"] > 0, best["delimiter"]).otherwise(DELIMITERS[0])


def _by_delimiter(delimiter: Column | str, make) -> Column:
    """``make`` of the delimiter; patterns stay literals, so that each is compiled once."""
    if isinstance(delimiter, str):
        return make(delimiter)
    chosen = F.when(delimiter == DELIMITERS[0], make(DELIMITERS[0]))
    for d in DELIMITERS[1:]:
        chosen = chosen.when(delimiter == d, make(d))
    return chosen


def split_cells(line: Column, delimiter: Column | str) -> Column:
    """Cells of a delimited record; quoted cells may hold delimiters, line breaks and doubled quotes.

    What follows the closing quote of a cell belongs to the cell. A column of delimiters holds those of DELIMITERS.
    """
    inner = f'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)\\z'

    def cell(c: Column) -> Column:
        part = lambda k: F.regexp_extract(c, inner, k)
        return F.when(F.startswith(c, F.lit('"')) & c.rlike(inner), F.concat(F.replace(part(1), F.lit('""'), F.lit('"')), part(2))).otherwise(c)

    def cells(d: str) -> Column:
        sep = re.escape(d)
        # Possessive, so that long cells neither backtrack nor recurse.
        found = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(f'{sep}({_QUOTED}"[^{sep}]*+|[^{sep}]*+)'), F.lit(1))
        return F.when(F.contains(line, F.lit('"')), F.transform(found, cell)).otherwise(F.split(line, sep, -1))

    return _by_delimiter(delimiter, cells)


def ends_quoted(line: Column, delimiter: Column | str) -> Column:
    """Whether a line that starts outside of quotes ends inside a quoted cell."""
    def open_(d: str) -> Column:
        sep = re.escape(d)
        cell = f'(?:{_QUOTED}"[^{sep}]*+|(?!")[^{sep}]*+)'
        return line.rlike(f"^(?:{cell}{sep})*+{_QUOTED}\\z")

    return _by_delimiter(delimiter, open_)


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of files as (file_id, chunk, line_id, value): bytes as they are, up to each line feed.

    A chunk is the part of a file that one task reads, named by its first byte; line ids grow along it.
    """
    if not paths:
        return spark.createDataFrame([], LINES)
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    # Spark's metadata name a file by its URL, listings by its path.
    path = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), r"^(\w+):///", "$1:/")
    return lines.select(
        path.alias("file_id"), F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("line_id"), "value"
    )


def file_formats(lines: DataFrame, delimiter: str | None = None) -> DataFrame:
    """(file_id, utf8, quoted, sep) of each file: from all of its bytes, by sums that combine before the shuffle."""
    raw = F.col("value")
    counts = [F.sum((F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit(d), F.lit("")))).cast("bigint")) for d in DELIMITERS]
    facts = lines.groupBy("file_id").agg(
        F.bool_and(F.is_valid_utf8(raw)).alias("utf8"), F.bool_or(F.contains(raw, F.lit('"'))).alias("quoted"),
        *[n.alias(f"n{i}") for i, n in enumerate(counts)],
    )
    sep = F.lit(delimiter) if delimiter else delimiter_of([F.col(f"n{i}") for i in range(len(DELIMITERS))])
    return facts.select("file_id", "utf8", "quoted", sep.alias("sep"))


def _pieces(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Lines as text without byte order mark, cut at lone carriage returns too, with the break that followed each."""
    text = decode_bytes(F.col("value").cast("binary"), F.col("utf8"))
    cut = lines.join(formats, "file_id").select(
        "file_id", "chunk", "line_id", "quoted", "sep", F.posexplode(F.split(F.regexp_replace(text, "^\ufeff", ""), "\r(?!\\z)", -1)).alias("piece", "part")
    )
    # a carriage return is left at the end of the last piece of a line only, before the line feed
    last = F.lead("piece").over(Window.partitionBy("file_id", "chunk").orderBy("line_id", "piece"))
    end = F.when(F.endswith("part", F.lit("\r")), "\r\n").when(last > F.col("piece"), "\r").otherwise("\n")
    return cut.select("file_id", "chunk", "line_id", "piece", "quoted", "sep", F.regexp_replace("part", "\r\\z", "").alias("line"), end.alias("end"))


def _after_first(pieces: DataFrame, skip_rows: int) -> DataFrame:
    """Without the first lines of each file."""
    place = F.row_number().over(Window.partitionBy("file_id", "chunk").orderBy("line_id", "piece"))
    before = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("file_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("file_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"))
    placed = pieces.withColumn("place", place).join(starts, ["file_id", "chunk"])
    return placed.filter(F.col("lines_before") + F.col("place") > skip_rows).drop("place", "lines_before")


def _composed(rows: DataFrame, window: Window, fixed: Column, turned: Column) -> DataFrame:
    """Running composition of maps along a window, as ``is_fixed`` and ``parity``.

    ``fixed`` is the state after a map that has only one, else null; ``turned`` is 1 for the map that turns the state
    round. From state s, the state after a row is its parity, turned round by s unless it is fixed.
    """
    along = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"set_to": fixed, "turns": F.sum(turned).over(along)})
    last = F.last(F.when(F.col("set_to").isNotNull(), F.struct(F.col("set_to").alias("v"), F.col("turns").alias("t"))), ignorenulls=True).over(along)
    rows = rows.withColumn("last_set", last)
    parity = (F.col("turns") - F.coalesce("last_set.t", F.lit(0)) + F.coalesce("last_set.v", F.lit(0))) % 2
    return rows.withColumns({"is_fixed": F.col("last_set").isNotNull(), "parity": parity.cast("int")}).drop("set_to", "turns", "last_set")


@dataclass
class Records:
    """Rows (file_id, row_id, cells), and the files (file_id) that end inside a quoted cell and gave no rows."""

    rows: DataFrame
    unclosed: DataFrame


def split_records(lines: DataFrame, delimiter: str | None = None, skip_rows: int = 0, few_files: bool = False) -> Records:
    """Records of lines (file_id, chunk, line_id, value); row ids count those that are not empty from 0 in each file.

    ``skip_rows`` lines in front are left out, empty ones among them. Line feeds, carriage returns and both together
    end a record; inside a quoted cell they stay as they are. An empty line is no record. ``few_files`` sends the
    files' formats to every task.
    """
    formats = file_formats(lines, delimiter)
    pieces = _pieces(lines, F.broadcast(formats) if few_files else formats)
    if skip_rows:
        pieces = _after_first(pieces, skip_rows)
    sep = delimiter or F.col("sep")
    outside = F.col("quoted") & ends_quoted(F.col("line"), sep)
    inside = ~F.col("quoted") | ends_quoted(F.concat(F.lit('"'), F.col("line")), sep)
    pieces = pieces.withColumns({"from_out": outside, "from_in": inside}).drop("quoted")

    along = Window.partitionBy("file_id", "chunk").orderBy("line_id", "piece")
    to = lambda flag: F.col(flag).cast("int")
    state = _composed(pieces, along, F.when(F.col("from_out") == F.col("from_in"), to("from_out")), (F.col("from_out") & ~F.col("from_in")).cast("int"))
    state = state.withColumns({"out0": F.col("parity"), "out1": F.when(F.col("is_fixed"), F.col("parity")).otherwise(1 - F.col("parity"))})
    state = state.withColumns({f"in{s}": F.coalesce(F.lag(f"out{s}").over(along), F.lit(s)) for s in (0, 1)})
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = {f"begun{s}": F.sum(((F.col(f"in{s}") == 0) & (F.col("line") != "")).cast("bigint")).over(so_far) for s in (0, 1)}
    state = state.withColumns(begun).drop("from_out", "from_in")

    ends = state.groupBy("file_id", "chunk").agg(F.max_by(F.struct("is_fixed", "parity", "begun0", "begun1"), F.struct("line_id", "piece")).alias("e"))
    over = Window.partitionBy("file_id").orderBy("chunk")
    ends = _composed(ends.select("file_id", "chunk", "e.*").withColumnsRenamed({"is_fixed": "f", "parity": "p"}), over, F.when(F.col("f"), F.col("p")), (~F.col("f") & (F.col("p") == 1)).cast("int"))
    ends = ends.withColumn("start", F.coalesce(F.lag("parity").over(over), F.lit(0)))
    begun_there = F.when(F.col("start") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunks = ends.select(
        "file_id", "chunk", "start", F.coalesce(F.sum(begun_there).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.last("parity").over(whole).alias("at_end"),
    )

    pick = lambda name: F.when(F.col("start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    placed = state.join(chunks.filter("at_end = 0"), ["file_id", "chunk"]).select(
        "file_id", "chunk", "line_id", "piece", "sep", "line", "end", pick("in").alias("starts"), pick("out").alias("stops"),
        (F.col("before") + pick("begun") - 1).alias("row_id"),
    )
    one_line = (F.col("starts") == 0) & (F.col("stops") == 0)
    single = placed.filter(one_line & (F.col("line") != "")).select("file_id", "row_id", "sep", "line")
    parts = F.sort_array(F.collect_list(F.struct("chunk", "line_id", "piece", "line", "end")))  # the lines of one record
    several = placed.filter(~one_line).groupBy("file_id", "row_id", "sep").agg(parts.alias("parts"))
    body = F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda x: F.concat(x["line"], x["end"]))
    several = several.select("file_id", "row_id", "sep", F.concat(F.array_join(body, ""), F.element_at("parts", -1)["line"]).alias("line"))
    rows = single.unionByName(several).select("file_id", "row_id", split_cells(F.col("line"), sep).alias("cells"))
    return Records(rows, chunks.filter("at_end = 1").select("file_id").distinct())


def read_records(spark: SparkSession, paths: Sequence[str], delimiter: str | None = None, skip_rows: int = 0, max_rows: int | None = None) -> Records:
    """Records of files with any mix of encodings and delimiters; ``max_rows`` rows are read after the first of each."""
    done = split_records(read_lines(spark, paths), delimiter, skip_rows, len(paths) <= FEW_FILES)
    return done if max_rows is None else Records(done.rows.filter(F.col("row_id") <= max_rows), done.unclosed)
