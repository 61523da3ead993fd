"""Token ids as shuffled planes: ids in blocks of fixed size, each block transposed into byte or bit planes.

A block of n 32-bit ids becomes 4 byte planes (all lowest bytes, then all second bytes, ...) or 32 bit planes;
planes of high places are nearly constant and compress to nothing. Each plane is compressed with zstandard.
The store is two tables: `blocks` (part, block, n_ids, planes, pieces of documents) and `index`, the chunk
index (part, block, start, n_ids, stored_bytes). They are written by Spark's own writer, so a lost executor's
files are never seen, and any file system that Spark knows will do.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemagate.llm.common import of_worker, slices

END_ID = 2
BLOCK_IDS = 65536
#: Words whose ids a worker remembers; only a matter of speed.
REMEMBERED = 800_000
#: Words whose ids are gathered at once.
GATHERED = 200_000
#: Bytes of texts that are encoded at once, unless one text alone is longer.
TOGETHER = 16 << 20
PIECES = "array<struct<doc_id:bigint,row:int,piece:int,n:int>>"
BLOCKS = f"part int, block int, first bigint, n_ids int, planes array<binary>, pieces {PIECES}"


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of 32-bit ids, lowest place first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    rows = raw.T if kind == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.ascontiguousarray(row).tobytes()) for row in rows]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids again; 4 planes are bytes, 32 are bits."""
    unpack = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(unpack.decompress(p), np.uint8) for p in planes]) if n else np.zeros((len(planes), 0), np.uint8)
    raw = rows.T if len(planes) == 4 else np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def gathered(ids: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of rows joined, and where each begins and the last ends; row n is ids[edges[n] : edges[n + 1]]."""
    size = edges[rows + 1] - edges[rows]
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return ids[np.arange(ends[-1]) + np.repeat(edges[rows] - ends[:-1], size)], ends


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word is among others, -1 for those that are not."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Encoder:
    """Ids of whole texts through the tokenizers library.

    The vocabulary's pre-tokenizer always breaks before a space that follows something other than white space,
    around a single line break, and between a letter or digit and marks. So words between such places are encoded
    on their own, each distinct one once and many in one call; texts with other white space than single spaces and
    line breaks are cut only before single spaces. Texts that hold an added token, such as <|endoftext|>, are encoded
    whole, as the library finds these before all else.

    A word stands for itself after a space. One that begins with a line break or a space stands for itself as it is;
    words of lines hold neither, so the first word of a line has its line break in front. Arrow splits texts
    and numbers distinct words; ids of known words lie in one array, from which texts are gathered.
    """

    _odd, _gap = re.compile(r"\s\s"), re.compile(r"(?<=\S) ")
    _marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # of words alone
        added = sorted((re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), reverse=True)
        self.added = re.compile("|".join(added) or "(?!)")
        self.line = self._ids("\n")
        opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        opens[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True
        breaks = np.zeros_like(opens)
        breaks[self.line] = True
        #: by what is before a word: where it starts in joined ids
        self.starts = {" ": opens, "\n": breaks}
        #: rows of known words in ids, between edges
        self.known, self.ids, self.edges = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    @cached_property
    def whole(self):
        """The tokenizer of texts that hold added tokens; few tasks need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _one(self, word: str) -> np.ndarray:
        """Ids of a word alone. What follows its line break may be white space, so that is encoded without it."""
        return np.concatenate([self.line, self._ids(word[1:])]) if word[:1] == "\n" else self._ids(word if word[:1] == " " else f" {word}")

    def _encode(self, words: pa.Array, before: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Words, all after a space or all with a line break in front, with their joined ids and the number of each."""
        for at in range(0, len(words), 2000):
            own = words[at : at + 2000]
            part = own.to_numpy(zero_copy_only=False).tolist()
            joined = "".join(part) if before == "\n" else " " + " ".join(part)
            if joined.split() == ([w[1:] for w in part] if before == "\n" else part):  # no white space in any
                ids = self._ids(joined)
                start = np.flatnonzero(self.starts[before][ids])
                if len(start) == len(part):
                    yield own, ids, np.diff(start, append=len(ids))
                    continue
            if len(part) > 50:  # set the odd ones apart
                bare = [w[1:] if before == "\n" else w for w in part]
                plain = [w for w, x in zip(part, bare, strict=True) if x.split() == [x]]
                if len(plain) < len(part):
                    yield from self._encode(pa.array(plain, pa.large_string()), before)
                    part = [w for w, x in zip(part, bare, strict=True) if x.split() != [x]]
            each = [self._one(w) for w in part]
            yield pa.array(part, pa.large_string()), np.concatenate(each), np.array([len(x) for x in each])

    def _add(self, words: pa.Array, ids: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Remember words and their ids; their rows."""
        self.known = pa.concat_arrays([self.known, words])
        self.ids = np.concatenate([self.ids, *ids])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
        return np.arange(len(self.known) - len(words), len(self.known))

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Remember distinct words, none of them known; marks at their end are encoded apart. Their rows in ids."""
        heads = pc.ascii_rtrim(words, characters=self._marks)
        cut = np.flatnonzero(pc.not_equal(pc.binary_length(heads), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        marked = np.zeros(len(words), bool)
        marked[cut] = [h != "" and (h[-1].isalpha() or "0" <= h[-1] <= "9") for h in heads.take(pa.array(cut)).to_numpy(zero_copy_only=False)]
        whole, heads, words = words.filter(pa.array(~marked)), heads.filter(pa.array(marked)), words.filter(pa.array(marked))
        parts = pc.unique(pa.concat_arrays([whole, heads]))  # the whole words first
        at = places(parts, self.known)
        new = parts.filter(pa.array(at < 0))
        line = pc.starts_with(new, "\n")
        made = [x for before, own in ((" ", pc.invert(line)), ("\n", line)) for x in self._encode(new.filter(own), before)]
        learnt = pa.concat_arrays([new[:0], *(w for w, _, _ in made)])
        at[at < 0] = self._add(learnt, [x for _, x, _ in made], [x for _, _, x in made])[places(new, learnt)]
        rows = np.zeros(len(marked), np.int64)
        rows[~marked] = at[: len(whole)]
        if len(words):
            tails = pa.array([w[n:] for w, n in zip(words.to_numpy(zero_copy_only=False), pc.utf8_length(heads).to_pylist(), strict=True)], pa.large_string()).dictionary_encode()
            own = [self._ids(t) for t in tails.dictionary.to_pylist()]
            ends = self.edges[-1] + np.cumsum([len(x) for x in own])
            joined = np.stack([at[places(heads, parts)], len(self.known) + tails.indices.to_numpy()], 1).ravel()
            ids, edges = gathered(np.concatenate([self.ids, *own]), np.concatenate([self.edges, ends]), joined)
            rows[marked] = self._add(words, [ids], [np.diff(edges[::2])])
        return rows

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct words in ids; where too many are remembered, only these are kept."""
        rows = places(words, self.known)
        new = words.filter(pa.array(rows < 0))
        if len(self.known) + len(new) > REMEMBERED:
            old = rows[rows >= 0]
            self.known, (self.ids, self.edges) = self.known.take(pa.array(old)), gathered(self.ids, self.edges, old)
            rows[rows >= 0] = np.arange(len(old))
        if len(new):
            rows[rows < 0] = self._learn(new)
        return rows

    def _words(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words; the number of each word of all texts, in turn; edges in these; and the place of each text between edges."""
        odd = {i: self._gap.split(t) for i, t in enumerate(texts) if t and self._odd.search(t)}
        lines = pa.array([None if not t or i in odd else "\n" + t.replace("\n", " \n") for i, t in enumerate(texts)], pa.large_string())
        cut = pc.split_pattern(lines, " ")
        words, edges, at = cut.flatten(), cut.offsets.to_numpy().astype(np.int64), np.arange(len(texts))
        if odd:  # these come last
            rest = [w for first, *more in odd.values() for w in (f"\n{first}", *(f" {w}" if w[:1] in (" ", "\n") else w for w in more))]
            words, edges = pa.concat_arrays([words, pa.array(rest, pa.large_string())]), np.concatenate([edges, edges[-1] + np.cumsum([len(w) for w in odd.values()])])
            at[[*odd]] = np.arange(len(odd)) + len(texts)
        words = words.dictionary_encode()
        return words.dictionary, words.indices.to_numpy(), edges, at

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian ids of each text; null counts as empty. Every text is a list of lines, a line a list of words."""
        whole = {i: np.array(self.whole.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4").tobytes() for i, t in enumerate(texts) if t and self.added.search(t)}
        words, numbers, edges, order = self._words([None if i in whole else t for i, t in enumerate(texts)])
        rows, i = self._rows(words)[numbers], 0
        del texts, words, numbers  # not needed while texts are given out
        for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(edges[order + 1] - edges[order]) // GATHERED)) + 1):
            own, at = gathered(rows, edges, part)
            ids, bounds = gathered(self.ids, self.edges, own)
            raw, bounds = ids.tobytes(), (4 * bounds[at]).tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield whole[i] if i in whole else raw[a + 4 * len(self.line) : b]  # without the break before the first line
                i += 1


def together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together up to a number of bytes, larger ones cut by rows: a call of the encoder costs as much as what it remembers."""
    held, full = [], 0
    for batch in slices(batches, 10_000, size):
        if held and full + batch.nbytes > size:
            yield pa.Table.from_batches(held)
            held, full = [], 0
        held.append(batch)
        full += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def write_ids(documents: DataFrame, folder: str, vocabulary: str, *, block_ids: int = BLOCK_IDS, kind: str = "byte", level: int = 3, end_id: int = END_ID) -> None:
    """Encode (doc_id, text) in ascending doc_id order and write blocks and chunk index below `folder`.

    Null text: only the end id. Null doc_id sorts first; rows with one doc_id are ordered by a hash of their text.
    A document may span blocks: each block lists its pieces of documents. No rows: two empty tables. Other columns
    are not read.
    """
    spark = documents.sparkSession
    ordered = documents.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = of_worker(("encoder", vocabulary), lambda: Encoder(vocabulary)), TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("pieces", pa.list_(pa.struct([("doc_id", pa.int64()), ("row", pa.int32()), ("piece", pa.int32()), ("n", pa.int32())])))])
        held, room, pieces, block, row = [], block_ids, [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "first": block * block_ids, "n_ids": len(ids), "planes": to_planes(ids, kind, level), "pieces": pieces}], schema)

        for batch in together(batches, TOGETHER):
            for doc_id, data in zip(batch["doc_id"].to_pylist(), encoder(batch["text"].to_pylist()), strict=True):
                data, at, piece = data + end, 0, 0
                while at < len(data):
                    taken = data[at : at + 4 * room]
                    held.append(taken)
                    pieces.append({"doc_id": doc_id, "row": row, "piece": piece, "n": len(taken) // 4})
                    at, piece, room = at + len(taken), piece + 1, room - len(taken) // 4
                    if not room:
                        yield flush()
                        held, room, pieces, block = [], block_ids, [], block + 1
                row += 1
        if held:
            yield flush()

    ordered.mapInArrow(encode, BLOCKS).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block", "first", "n_ids", F.aggregate("planes", F.lit(0).cast("bigint"), lambda n, p: n + F.octet_length(p)).alias("stored_bytes"))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as the write had tasks
    parts = parts.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_start"))
    index = blocks.join(parts, blocks["part"] == parts["_part"]).select("part", "block", (F.col("_start") + F.col("first")).alias("start"), "n_ids", "stored_bytes")
    index.write.parquet(f"{folder}/index")


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of documents from the files: doc_id, part, row, piece, start, n_tokens, ids (array of int)."""
    return _read(spark, folder, "ids array<int>", lambda ids: ids.astype(np.int32))


def _read(spark: SparkSession, folder: str, column: str, make) -> DataFrame:
    blocks, index = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), spark.read.schema("part int, block int, start bigint, n_ids int, stored_bytes bigint").parquet(f"{folder}/index")
    placed = blocks.join(index.select("part", "block", "start"), ["part", "block"])

    kind = pa.list_(pa.int32()) if "array" in column else pa.int64()

    def decode(batches):
        for batch in slices(batches, 16):
            pieces, offsets = batch["pieces"].values, batch["pieces"].offsets.to_numpy()
            doc_id, row, piece, n = (pieces.field(k)[int(offsets[0]) : int(offsets[-1])] for k in range(4))
            sizes, made, starts = n.to_numpy().astype(np.int64), [], [np.zeros(0, np.int64)]
            for r in range(batch.num_rows):
                own = sizes[offsets[r] - offsets[0] : offsets[r + 1] - offsets[0]]
                ids, at = from_planes(batch["planes"][r].as_py(), batch["n_ids"][r].as_py()), np.cumsum(own) - own
                made += [make(ids[a : a + k]) for a, k in zip(at.tolist(), own.tolist(), strict=True)]
                starts.append(batch["start"][r].as_py() + at)
            part = np.repeat(batch["part"].to_numpy(), np.diff(offsets))
            columns = [doc_id, pa.array(part), row, piece, pa.array(np.concatenate(starts)), pa.array(sizes), pa.array(made, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "row", "piece", "start", "n_tokens", column.split()[0]])

    return placed.mapInArrow(decode, f"doc_id bigint, part int, row int, piece int, start bigint, n_tokens bigint, {column}")


def _applied(matrix: list[int], v: int) -> int:
    """A matrix over bits, given by its columns, times the bits of v."""
    out = 0
    for column in matrix:
        if v & 1:
            out ^= column
        v >>= 1
    return out


#: Matrices that take a crc32 past 1, 2, 4, ... zero bits; as many as were asked for.
_ZEROS = [[0xEDB88320] + [1 << n for n in range(31)]]


def _shifted(crc: int, size: int) -> int:
    """A crc32 as if `size` zero bytes followed: one matrix for each bit of size, each made once."""
    for n in range(size.bit_length()):
        while len(_ZEROS) <= n + 3:
            _ZEROS.append([_applied(_ZEROS[-1], c) for c in _ZEROS[-1]])
        if size >> n & 1:
            crc = _applied(_ZEROS[n + 3], crc)
    return crc


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """crc32 of joined byte strings from (crc32, length in bytes) of each."""
    out = 0
    for crc, size in pieces:
        out = _shifted(out, size) ^ crc
    return out


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; pieces meet by their checksums, never whole."""
    pieces = _read(spark, folder, "crc bigint", lambda ids: zlib.crc32(np.ascontiguousarray(ids, "<u4")))
    docs = pieces.groupBy("part", "row").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("piece", "crc", "n_tokens"))).alias("pieces"),
    )

    def combine(batches):
        for batch in batches:
            pieces, offsets = batch["pieces"].values, batch["pieces"].offsets.to_numpy()
            crcs, sizes = pieces.field("crc").to_numpy(), pieces.field("n_tokens").to_numpy()
            crc = crcs[offsets[:-1]].copy()
            for i in np.flatnonzero(np.diff(offsets) > 1):
                own = slice(offsets[i], offsets[i + 1])
                crc[i] = joined_crc([(c, 4 * n) for c, n in zip(crcs[own].tolist(), sizes[own].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(combine, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
