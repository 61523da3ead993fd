"""SentencePiece encoding and decoding with batched numpy Viterbi.

Text becomes words (a space is the piece mark, one stands in front), distinct words of equal length form a matrix,
and all its rows advance together: rolling hashes of all substrings probe the sorted keys of the pieces, and for
each end position a maximum over piece lengths stores a backpointer. Unigram models maximise the sum of scores. In
BPE models the merge order decides, not a sum: there a piece may end a prefix only if merging would keep it apart
from the piece before it, which exactly one candidate satisfies, so the maximum is taken over the compatible ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from schemagate.llm.common import mix64, share, shared, slices

MARK = "▁"
#: Words a task remembers, and characters of a matrix; only matters of speed and memory.
REMEMBERED, CELLS = 300_000, 1 << 18
#: Pairs of pieces whose compatibility a task remembers, as a power of two.
MEMO_BITS = 20
_gap = re.compile(r"(?<=[^ ▁])(?=[ ▁])")


class Pieces:
    """The vocabulary of a SentencePiece model as arrays.

    Models with byte fallback, identity normalisation and no removal of white space, as most public ones are.
    """

    def __init__(self, path: str, bpe: bool = True):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bpe, self.size = bpe, len(sp)
        self.byte = np.zeros(256, np.int32)
        self.text: list[str | int | None] = [None] * self.size
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(self.size)]
        for i in range(self.size):
            if sp.is_byte(i):
                self.text[i] = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte[self.text[i]] = i
            elif not special[i]:
                self.text[i] = sp.id_to_piece(i)
        self.ids = {t: i for i, t in enumerate(self.text) if isinstance(t, str)}
        encoded = [bytes([t]) if isinstance(t, int) else (t or "").encode("utf-8", "surrogatepass") for t in self.text]
        self.bytes, self.width = np.frombuffer(b"".join(encoded), np.uint8), np.array([len(x) for x in encoded])
        self.start = np.cumsum(self.width) - self.width
        self.score = np.array([*(sp.get_score(i) for i in range(self.size)), -1e9])
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("pieces that span words are not supported")
        self.longest = max(map(len, self.ids))
        # of each piece: the rank of the merge that makes it (-1: a single character) and its two parts
        self.rank = np.full(self.size + 1, -1, np.int64)
        self.left, self.right = np.full(self.size + 1, -1, np.int64), np.full(self.size + 1, -1, np.int64)
        usable = self._parts() if bpe else self.ids
        keys = {t: i for t, i in self.ids.items() if t in usable}
        hashes = np.array([self._hash(np.array([[ord(c) for c in t]], np.uint64))[-1][0, 0] for t in keys], np.uint64)
        order = np.argsort(hashes)
        self.key, self.key_id = hashes[order], np.array(list(keys.values()), np.int64)[order]
        if len(np.unique(self.key)) < len(self.key):
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)  # by the highest bits of a key, spares most probes
        self.maybe[self.key >> np.uint64(44)] = True
        self.tested, self.verdict = np.full(1 << MEMO_BITS, -1, np.int64), np.zeros(1 << MEMO_BITS, bool)

    def _parts(self) -> set[str]:
        """Fill rank, left, right; the pieces that merging their own characters arrives at."""
        pairs, reached = {}, set()
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                if t[:k] in self.ids and t[k:] in self.ids:
                    pairs[self.ids[t[:k]] * (self.size + 1) + self.ids[t[k:]]] = -self.score[i]
        for t, i in self.ids.items():
            symbols, last = list(t), None
            while len(symbols) > 1:
                best = max(((self.score[self.ids[a + b]], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.ids), default=None)
                if best is None:
                    break
                k = -best[1]
                last = symbols[k : k + 2]
                symbols[k : k + 2] = ["".join(last)]
            if len(symbols) == 1:
                reached.add(t)
                if last:
                    self.rank[i], self.left[i], self.right[i] = round(-self.score[i]), *(self.ids.get(p, self.size) for p in last)
        order = np.argsort(np.fromiter(pairs, np.int64))
        self.pair = np.fromiter(pairs, np.int64)[order]
        self.pair_rank = np.rint(np.fromiter(pairs.values(), float)[order]).astype(np.int64)
        return reached

    @staticmethod
    def _hash(codes: np.ndarray, longest: int | None = None) -> list[np.ndarray]:
        """Hashes of the substrings of length 1, 2, ... at every start, for rows of code points."""
        out, h = [], np.zeros_like(codes)
        for length in range(1, min(longest or codes.shape[1], codes.shape[1]) + 1):
            span = codes.shape[1] - length + 1
            h = mix64(h[:, :span] * np.uint64(0x9E3779B97F4A7C15) + codes[:, length - 1 :] + np.uint64(1))
            out.append(h)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As `_compatible`, remembering pairs: each has one place, the latest pair there is kept."""
        key = a * (self.size + 1) + b
        place = (mix64(key.view(np.uint64)) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        good = self.verdict[place]
        new = np.flatnonzero(self.tested[place] != key)
        if len(new):
            good[new] = self._compatible(a[new], b[new])
            self.verdict[place[new]] = good[new]
            self.tested[place[new]] = key[new]
        return good

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Would merging keep pieces a and b, side by side, apart?

        Both are taken apart again, latest merge first; they join wrongly if at some point the two parts that touch
        have a merge of lower rank than the one being undone (of equal rank: if the undone one is further right).
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            key = a * (self.size + 1) + b
            k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            joins = (self.pair[k] == key) & (self.pair_rank[k] < limit)
            good[at[joins]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            undo_a = rank_a > rank_b
            limit = np.where(undo_a, rank_a, rank_b + 1)
            going = ~joins & ((rank_a >= 0) | (rank_b >= 0))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            at, a, b, limit = at[going], a[going], b[going], limit[going]
        return good

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of equal length, characters outside the vocabulary as bytes."""
        rows, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(rows, length).astype(np.uint64)
        found = np.full((self.longest + 1, rows, length), -1, np.int64)
        for n, h in enumerate(self._hash(codes, self.longest), 1):
            row, start = np.nonzero(self.maybe[h >> np.uint64(44)])
            h = h[row, start]
            k = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
            found[n, row, start] = np.where(self.key[k] == h, self.key_id[k], -1)
        found[1] = np.where(found[1] < 0, self.size, found[1])  # stands for a character as bytes
        last, size = np.full((rows, length + 1), -1, np.int64), np.zeros((rows, length + 1), np.int64)
        best = np.full((rows, length + 1), -np.inf)
        best[:, 0] = 0
        for end in range(1, length + 1):
            most = min(self.longest, end)
            piece = np.stack([found[n, :, end - n] for n in range(1, most + 1)], axis=1)
            start = end - np.arange(1, most + 1)
            value = np.where(piece >= 0, self.score[piece] + (0 if self.bpe else best[:, start]), -np.inf)
            if self.bpe:
                r, n = np.nonzero((piece >= 0) & (start > 0))
                value[r, n] = np.where(self.compatible(last[r, start[n]], piece[r, n]), value[r, n], -np.inf)
            n = np.argmax(value, axis=1)
            pick = np.arange(rows)
            best[:, end], last[:, end], size[:, end] = value[pick, n], piece[pick, n], n + 1
        # all rows follow their backpointers together, from the end to the front
        ids, left = np.zeros((rows, length), "<i4"), np.full(rows, length)
        end, pick = np.full(rows, length), np.arange(rows)
        while len(pick):
            left[pick] -= 1
            ids[pick, left[pick]] = last[pick, end]
            end = end - size[pick, end]
            pick, end = pick[end > 0], end[end > 0]
        out = [row[k:] for row, k in zip(ids, left.tolist(), strict=True)]
        for r in np.flatnonzero((ids == self.size).any(axis=1)):
            chars, at = [], 0
            for i in out[r].tolist():
                chars += [self.byte[x] for x in words[r][at].encode("utf-8", "surrogatepass")] if i == self.size else [i]
                at += 1 if i == self.size else len(self.text[i])
            out[r] = np.array(chars, "<i4")
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; runs of byte pieces are read as UTF-8, the mark in front goes. Control ids have no text."""
        size = self.width[ids]
        # byte k of the text is byte k - (start in the text) of its piece
        source = np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.bytes[source].tobytes().decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


class Encoder:
    """Ids of whole texts; distinct words are encoded once, in matrices of bounded size."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        cut = [_gap.split(" " + t) if t else [] for t in texts]
        new = {w for c in cut for w in c}
        if len(new) + len(self.known) > REMEMBERED:
            self.known = {}
        by_length: dict[int, list[str]] = {}
        for w in new - self.known.keys():
            by_length.setdefault(len(w), []).append(w)
        for length, words in by_length.items():
            step = max(1, CELLS // (length * self.pieces.longest))
            for at in range(0, len(words), step):
                part = words[at : at + step]
                self.known.update((w, ids.tobytes()) for w, ids in zip(part, self.pieces.viterbi([w.replace(" ", MARK) for w in part]), strict=True))
        for c in cut:
            yield b"".join(map(self.known.__getitem__, c))


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def encode_texts(documents: DataFrame, model: str, *, bpe: bool = True, column: str = "ids") -> DataFrame:
    """`documents` with its piece ids (array of int) and whether decoding them gives the text again (`round_trip`).

    Null text: null ids and round_trip. Empty text: no ids. A text that holds the piece mark itself decodes with
    spaces there, and is no round trip. Rows are independent; a column already named so is replaced.
    """
    pieces = Pieces(model, bpe)
    sent = share(documents.sparkSession, pieces)  # of the size of the vocabulary
    names = [c for c in documents.columns if c not in (column, "round_trip")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared(sent))
        for batch in slices(batches, 500):
            texts = batch["text"].to_pylist()
            flat = [np.frombuffer(b, "<i4") for b in encoder(texts)]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
            null = pa.array([t is None for t in texts])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*flat, np.zeros(0, "<i4")])), mask=null)
            trip = pa.array([None if t is None else encoder.pieces.decode(f) == t for t, f in zip(texts, flat, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), ids, trip], [*names, column, "round_trip"])

    kept = documents.select(*names)
    return kept.mapInArrow(encode, _schema(kept, f"`{column}` array<int>, round_trip boolean"))


def decode_ids(encoded: DataFrame, model: str, *, column: str = "ids") -> DataFrame:
    """`encoded` with the text of its ids in `decoded`; null ids give null."""
    sent = share(encoded.sparkSession, Pieces(model, bpe=False))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(sent)
        for batch in slices(batches, 500):
            texts = [None if v is None else pieces.decode(np.array(v, np.int64)) for v in batch[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(decode, _schema(encoded, "decoded string"))
