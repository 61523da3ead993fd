"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), linear in the number of features of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagate.llm.common import fold, share, shared, slices, words_of

WORDS, FACTORS = 1 << 14, 8
#: At most so many labelled rows are fitted, the first by a hash of their id.
FIT_ROWS = 6000
THRESHOLD = 0.7
#: Edges of the bins of each statistic: shares, mean word length, logarithms of sizes.
SHARES = np.array([0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
LENGTHS = np.array([2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 10, 12, 15.0])
LOGS = np.arange(0.5, 15.5)
BINS = 16
#: Byte classes: other letters (beyond ASCII), lower, upper, digit, white space, and the marks counted one by one.
MARKS = b".,;:!?|*%$&#@/\\<>{}[]()\"'-_=+~^"
_CLASS = np.full(256, 6, np.uint8)
_CLASS[0x80:] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[list(MARKS)] = 5
N_STATS = 5 + 1 + 1 + len(MARKS) + 8
FEATURES = WORDS + N_STATS * BINS


def statistics(text: str, words: list[bytes], n_chars: int | None) -> np.ndarray:
    """Bins of the structure statistics and of the length that the metadata states (last bin if it states none)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    by_class = np.bincount(_CLASS, weights=counts, minlength=7)
    size, n = max(1, len(raw)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    shares = [
        *(by_class[[0, 1, 2, 3, 4]] / size), by_class[5] / size, by_class[6] / size, *(counts[list(MARKS)] / size),
        len(set(words)) / n, len(set(lines)) / len(lines), sum(not w[-1:].isalnum() for w in words) / n, sum(x[:1].isupper() for x in lines) / len(lines),
    ]
    bins = np.searchsorted(SHARES, shares, side="right")
    more = [
        np.searchsorted(LENGTHS, sum(map(len, words)) / n), np.searchsorted(LOGS, np.log1p(len(words))), np.searchsorted(LOGS, np.log1p(len(text) / len(lines))),
        BINS - 1 if n_chars is None or n_chars < 0 else min(np.searchsorted(LOGS, np.log1p(n_chars)), BINS - 2),
    ]
    return WORDS + np.arange(N_STATS) * BINS + np.concatenate([bins, more]).astype(np.int64)


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words with values of unit length in all, statistics with 1 over the root of their number."""
    text = text or ""
    words = words_of(text)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(WORDS)
    index, times = np.unique(hashed.astype(np.int64), return_counts=True)
    value = np.sqrt(times)
    value = value / max(1.0, np.sqrt((value * value).sum()))
    stats = statistics(text, words, n_chars)
    return np.concatenate([index, stats]), np.concatenate([value, np.full(len(stats), N_STATS**-0.5 * 3)])


@dataclass
class Machine:
    """Weights; `raw` scores a batch given as one list of features with the row of each."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def sums(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.factors[index] * value[:, None]
        first = np.stack([np.bincount(row, v[:, f], rows) for f in range(v.shape[1])], axis=1)
        pairs = (first**2).sum(1) - np.bincount(row, (v * v).sum(1), rows)
        return self.bias + np.bincount(row, self.linear[index] * value, rows) + pairs / 2, first

    def score(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(row, index, value, rows)[0], -35, 35)))


def fit(parts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Logistic loss, Adam over batches of rows; gradients by the same sums as the score."""
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)))
    moments = [np.zeros((FEATURES, FACTORS + 1)), np.zeros((FEATURES, FACTORS + 1))]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 256):
            chosen = order[at : at + 256]
            row = np.repeat(np.arange(len(chosen)), [len(parts[i][0]) for i in chosen])
            index, value = (np.concatenate([parts[i][k] for i in chosen]) for k in (0, 1))
            raw, first = m.sums(row, index, value, len(chosen))
            slope = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[chosen]) / len(chosen)
            each = slope[row] * value
            grad = np.empty((FEATURES, FACTORS + 1))
            grad[:, 0] = np.bincount(index, each, FEATURES) + decay * m.linear
            for f in range(FACTORS):
                own = m.factors[index, f]
                grad[:, f + 1] = np.bincount(index, each * (first[row, f] - own * value), FEATURES) + decay * m.factors[:, f]
            step += 1
            moments[0] += 0.1 * (grad - moments[0])
            moments[1] += 0.001 * (grad * grad - moments[1])
            change = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
            m.linear -= change[:, 0]
            m.factors -= change[:, 1:]
            m.bias -= rate * slope.sum()
    return m


def _with_length(documents: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in documents.columns else F.lit(None).cast("bigint")
    return documents.select("doc_id", "text", n_chars.alias("n_chars"))


def train(documents: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, modulus: int = 4, held_out: int = 2) -> Machine:
    """Fit on at most `rows` labelled documents outside the held-out fold. Null labels do not count; without any label, every score is 0.5."""
    known = labels.where(F.col("quality").isNotNull() & (fold("doc_id", modulus) != held_out)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    sample = _with_length(documents).join(known, "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            made = [features(t, n) for t, n in zip(batch["text"].to_pylist(), batch["n_chars"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array([i.astype("<i4").tobytes() for i, _ in made]), pa.array([v.astype("<f4").tobytes() for _, v in made])], ["doc_id", "quality", "index", "value"])

    got = sample.select("doc_id", "text", "n_chars", "quality").mapInArrow(extract, "doc_id bigint, quality int, index binary, value binary").toPandas()
    got = got.assign(size=got["index"].map(len)).sort_values(["doc_id", "quality", "size"], ignore_index=True)
    parts = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for i, v in zip(got["index"], got["value"], strict=True)]
    return fit(parts, got["quality"].to_numpy(np.float64))


def score(documents: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """`documents` with the score of each whole text. Null text counts as empty; a null n_chars is a value of its own."""
    sent = share(documents.sparkSession, machine)  # FEATURES * (FACTORS + 1) numbers
    names = [c for c in documents.columns if c != column]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared(sent)
        for batch in slices(batches, 500):
            lengths = batch["n_chars"].to_pylist() if "n_chars" in names else [None] * batch.num_rows
            made = [features(t.as_py(), n) for t, n in zip(batch["text"], lengths, strict=True)]
            row = np.repeat(np.arange(len(made)), [len(i) for i, _ in made])
            index, value = (np.concatenate([m[k] for m in made]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(machine.score(row, index, value, len(made)))], [*names, column])

    kept = documents.select(*names)
    return kept.mapInArrow(apply, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{column}` double")


def classify(documents: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text[, n_chars])."""
    machine = train(documents, labels, modulus=modulus, held_out=held_out)
    out = score(_with_length(documents), machine)
    return out.select("doc_id", F.coalesce(fold("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns whatever they are called, whose score reaches the threshold; repeated rows are judged each."""
    name = "score"
    while name in documents.columns:
        name += "_"
    return score(documents, train(documents, labels), name).where(F.col(name) >= threshold).drop(name)
