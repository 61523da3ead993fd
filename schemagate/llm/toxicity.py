"""Toxicity: class-conditional Kneser-Ney models of words as byte sequences, and a calibrated score.

One model learns the words of toxic texts, one those of ordinary texts. Orders up to SHARED use continuation counts
of both classes together, so rare expressions of either class fall back on common ground; higher orders are kept by
class. A word's evidence is the difference of its two log-likelihoods, computed once per distinct word; a text's
features are that evidence per byte of the text and its strongest words per byte, put on a scale by logistic
regression on labelled texts that the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagate.llm.common import fold, share, shared, slices

ORDER, SHARED, DISCOUNT = 6, 3, 0.75
#: At most so many labelled rows of each class are learnt from (half for the models, half for the scale).
FIT_ROWS = 3000
REMEMBERED = 300_000
#: Bytes that separate words here: ASCII but letters, so that marks at a word's edge do not hide it.
_SPACED = bytes(c if chr(c).isalpha() or c >= 0x80 else 32 for c in range(256)).lower()
START, END = 1, 2


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split() if text else []


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, packed): each byte of each word and its end, packed with the ORDER - 1 bytes before it (start marks in front)."""
    text = np.frombuffer(b"".join(bytes([START] * (ORDER - 1)) + w + bytes([END]) for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + ORDER for w in words], np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    packed = text.copy()
    for k in range(1, ORDER):
        packed[k:] |= text[:-k] << np.uint64(8 * k)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = place >= ORDER - 1
    return row[use], packed[use]


def _low(packed: np.ndarray, order: int) -> np.ndarray:
    return packed & np.uint64((1 << 8 * order) - 1)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, weights, len(unique))


@dataclass
class Level:
    """One order: discounted shares of seen n-grams and backoff weights of seen contexts, a column per class."""

    gram: np.ndarray
    share: np.ndarray
    context: np.ndarray
    weight: np.ndarray


class Models:
    """Kneser-Ney models of both classes from weighted words."""

    def __init__(self, words: list[list[bytes]], times: list[np.ndarray]):
        grams = []
        for w, t in zip(words, times, strict=True):
            row, packed = ngrams(w)
            grams.append(_summed(packed, t[row].astype(float)))
        self.levels: list[Level] = []
        for order in range(1, ORDER + 1):
            tables = [self._counts(g, order) for g in grams]
            if order <= SHARED:  # one table for both
                both = _summed(np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables]))
                tables = [both, both]
            self.levels.append(self._level(tables))

    @staticmethod
    def _counts(gram: tuple[np.ndarray, np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts at the highest order; below, in how many different bytes an n-gram continues to the left."""
        if order == ORDER:
            return gram
        longer = np.unique(_low(gram[0], order + 1))
        return _summed(_low(longer, order), np.ones(len(longer)))

    @staticmethod
    def _level(tables: list[tuple[np.ndarray, np.ndarray]]) -> Level:
        gram = np.unique(np.concatenate([t[0] for t in tables]))
        context = np.unique(gram >> np.uint64(8))
        share, weight = np.zeros((len(gram), 2)), np.ones((len(context), 2))
        for c, (keys, counts) in enumerate(tables):
            at = np.searchsorted(context, keys >> np.uint64(8))
            total, kinds = np.bincount(at, counts, len(context)), np.bincount(at, minlength=len(context))
            seen = total > 0
            weight[seen, c] = DISCOUNT * kinds[seen] / total[seen]
            share[np.searchsorted(gram, keys), c] = (counts - DISCOUNT) / total[at]
        return Level(gram, share, context, weight)

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not words:
            return np.zeros(0)
        row, packed = ngrams(words)
        packed, back = np.unique(packed, return_inverse=True)
        p = np.full((len(packed), 2), 1 / 256)
        for order, level in enumerate(self.levels, 1):
            if not len(level.gram):
                continue
            key = _low(packed, order)
            context = key >> np.uint64(8)
            at = np.minimum(np.searchsorted(level.context, context), len(level.context) - 1)
            known = np.flatnonzero(level.context[at] == context)
            p[known] *= level.weight[at[known]]
            at = np.minimum(np.searchsorted(level.gram, key[known]), len(level.gram) - 1)
            hit = level.gram[at] == key[known]
            p[known[hit]] += level.share[at[hit]]
        return np.bincount(row, (np.log(p[:, 1]) - np.log(p[:, 0]))[back], len(words))


class Scorer:
    """Features of whole texts, remembering the evidence of words."""

    def __init__(self, models: Models):
        self.models, self.known = models, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: evidence per byte, and the sums of the 1, 2, 4 strongest words, squashed; zeros without words."""
        cut = [tokens(t) for t in texts]
        new = {w for c in cut for w in c}
        if len(new) + len(self.known) > REMEMBERED:
            self.known = {}
        new = list(new - self.known.keys())
        for at in range(0, len(new), 50_000):
            self.known.update(zip(new[at : at + 50_000], self.models.evidence(new[at : at + 50_000]).tolist(), strict=True))
        out = np.zeros((len(texts), 5))
        for r, c in enumerate(cut):
            if c:
                e = np.fromiter(map(self.known.__getitem__, c), float, len(c))
                size = sum(map(len, c)) + len(c)
                top = np.sort(e)[::-1][:4]
                out[r] = np.tanh(e.sum() / size), *(top[0], top[:2].sum(), top[:4].sum()), top[:2].sum() / np.log(size + 2)
        return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps; (mean, spread, weights with the constant last)."""
    mean, spread = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        change = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(len(w)), z.T @ (y - p) - 1e-1 * w)
        w += np.clip(change, -2, 2)
    return mean, spread, w


def train(documents: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, modulus: int = 5, held_out: int = 0) -> tuple[Models, tuple]:
    """Models and scale from at most `rows` labelled documents of each class outside the held-out fold, first by a hash of their id."""
    known = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", modulus) != held_out)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("toxic = 1").orderBy(*order).limit(rows).unionAll(known.where("toxic = 0").orderBy(*order).limit(rows))
    sample = documents.select("doc_id", "text").join(chosen, "doc_id").withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in slices(batches, 500):
            sums = {0: Counter(), 1: Counter()}
            for t, y in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
                sums[y].update(tokens(t.as_py()))
            for y, c in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(c), pa.int32()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["toxic", "word", "n"])

    counted = sample.where("half = 0").select("text", "toxic").mapInArrow(count, "toxic int, word binary, n bigint").groupBy("toxic", "word").agg(F.sum("n").alias("n")).toPandas()
    sides = [counted[counted["toxic"] == y].sort_values("word") for y in (0, 1)]
    models = Models([[bytes(w) for w in s["word"]] for s in sides], [s["n"].to_numpy() for s in sides])
    sent = share(documents.sparkSession, models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared(sent))
        for batch in slices(batches, 500):
            x = scorer.features(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    seen = sample.where("half = 1").select("doc_id", "text", "toxic").mapInArrow(measure, "doc_id bigint, toxic int, x array<double>").toPandas().sort_values(["doc_id", "toxic"])
    x = np.array(seen["x"].tolist()).reshape(len(seen), 5)
    return models, logistic(x, seen["toxic"].to_numpy(float))


def classify(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.5, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text). Null, empty and wordless texts score as texts without evidence; without labels all score 0.5."""
    sent = share(documents.sparkSession, train(documents, labels, modulus=modulus, held_out=held_out))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, (mean, spread, w) = shared(sent)
        scorer = Scorer(models)
        for batch in slices(batches, 500):
            x = (scorer.features(batch["text"].to_pylist()) - mean) / spread
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))], ["doc_id", "score"])

    out = documents.select("doc_id", "text").mapInArrow(apply, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
