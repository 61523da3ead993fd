"""Language-model scoring with Brown classes: exchange clustering, class transitions, word emissions.

p(text) = product over tokens of p(class | class before) * p(word | class). Word counts cover the whole training
corpus. The most frequent words are clustered among themselves: in each round one pass over the corpus counts, per
word, the classes left and right of it, and every word moves to the class that makes these most likely (exchange, in
batch form: all words, then every other one in turn, so that neighbours do not swap for ever). Then every other word
of some occurrences is exchanged against these classes, in Spark tables that grow with the vocabulary. Only words
below that count, unseen ones included, belong to classes by spelling, whose emissions keep a share for unseen words.

Texts are tokenised twice, to count words and to write their ids; all later passes read ids. Words outside the
lexicon are joined to their counts and classes, one row per document and distinct word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagate.llm.common import fold, keep, share, shared, slices, words_of

#: Words clustered in rounds; words whose counts travel to executors; classes by exchange and by spelling; rounds;
#: occurrences from which any word is exchanged.
CLUSTERED, LEXICON, CLASSES, SPELLINGS, ROUNDS, FEWEST = 16384, 131072, 32, 8, 3, 3
ALPHA = 0.1
#: Weight of the class unigram in a transition.
BACKOFF = 5.0
#: Distinct words after which a task hands on its counts.
HELD = 400_000
#: Gains are summed as whole numbers, so that reruns agree.
UNIT = 1 << 20
ENDS = CLASSES + SPELLINGS
ALL = ENDS + 1


def spelling(word: bytes) -> int:
    """Spelling class: crc32 of the last two bytes."""
    return CLASSES + zlib.crc32(word[-2:]) % SPELLINGS


def spelling_column(word: str) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % SPELLINGS + CLASSES).cast("int")


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all words of (text), with one end per document under the empty word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, 500):
            for text in batch["text"]:
                held.update(words_of(text.as_py()))
            held[b""] += batch.num_rows
            if len(held) > HELD:
                yield flush()
        yield flush()

    return documents.select("text").mapInArrow(count, "word binary, n bigint").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Frequent words, most frequent first, with counts and classes; the first `clustered` of them are in the rounds."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    clustered: int

    @property
    def class_of(self) -> np.ndarray:
        return self.classes[: self.clustered]


def frequent(seen: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """At most so many of the most frequent words and their counts.

    A histogram over steps of the counts gives the threshold, so no task merges candidates of all others.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    bins = sorted(((r.step, r.v) for r in seen.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).collect()), reverse=True)
    total, least = 0, None
    for k, v in bins:
        if total + v > most:
            break
        total, least = total + v, k
    if least is None:
        return [], np.zeros(0, np.int64)
    got = seen.where(step >= least).select("word", "n").toArrow()
    order = sorted(zip(got["n"].to_pylist(), got["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    return [w for _, w in order], np.array([n for n, _ in order], np.int64)


IDS = "row bigint, doc_id bigint, learnt boolean, at binary, rare array<binary>, rare_class binary"


def to_ids(documents: DataFrame, words: list[bytes]) -> DataFrame:
    """(doc_id, learnt, text) as lexicon ids: `at` holds an int32 per token, -1 - k for the k-th distinct other word."""
    sent = share(documents.sparkSession, words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: i for i, w in enumerate(shared(sent))}
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 500):
            ats, rares, kinds = [], [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                at = list(map(ids.get, words))
                others: dict[bytes, int] = {}
                if None in at:
                    at = [others.setdefault(w, -1 - len(others)) if i is None else i for i, w in zip(at, words, strict=True)]
                ats.append(np.array(at, np.int32).tobytes())
                rares.append(list(others))
                kinds.append(bytes(map(spelling, others)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + batch.num_rows)), batch["doc_id"], batch["learnt"], pa.array(ats, pa.binary()), pa.array(rares, pa.list_(pa.binary())), pa.array(kinds, pa.binary())],
                ["row", "doc_id", "learnt", "at", "rare", "rare_class"],
            )
            row += batch.num_rows

    return documents.select("doc_id", "learnt", "text").mapInArrow(encode, IDS)


class Tokens:
    """The tokens of a batch of documents in one run: an end before, between and after them."""

    def __init__(self, batch: pa.RecordBatch):
        at = batch["at"].to_pylist()
        self.documents = len(at)
        sizes = np.fromiter(map(len, at), np.int64, len(at)) // 4
        self.of = np.repeat(np.arange(len(at)), sizes)
        self.place = np.arange(len(self.of)) + self.of + 1
        self.spelled = np.frombuffer(b"".join(batch["rare_class"].to_pylist()), np.uint8).astype(np.int64)
        first = np.cumsum([0, *map(len, batch["rare_class"].to_pylist())])[:-1]
        self.first = first
        self.at = np.frombuffer(b"".join(at), np.int32).astype(np.int64)
        self.rest = np.flatnonzero(self.at < 0)
        #: which of all other words of the batch
        self.other = first[self.of[self.rest]] - 1 - self.at[self.rest]

    def values(self, known: np.ndarray, others: np.ndarray) -> np.ndarray:
        """What each token has, of lexicon words and of others."""
        out = known[np.maximum(self.at, 0)] if len(known) else np.zeros(len(self.at), others.dtype)
        out[self.rest] = others[self.other]
        return out

    def path(self, classes: np.ndarray) -> np.ndarray:
        out = np.full(len(self.of) + self.documents + 1, ENDS, np.int64)
        out[self.place] = classes
        return out


def class_counts(ids: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class bigrams (ALL, ALL) and, per clustered word, counts of the classes left and right of it.

    Their size is that of the parameters, whatever the corpus.
    """
    sent = share(ids.sparkSession, (lexicon.classes, lexicon.clustered))
    size = ALL * ALL + 2 * lexicon.clustered * ALL

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, clustered = shared(sent)
        total = np.zeros(size, np.int64)
        for batch in slices(batches, 500):
            t = Tokens(batch)
            path = t.path(t.values(classes, t.spelled))
            some = np.flatnonzero((t.at >= 0) & (t.at < clustered))
            base, place = ALL * ALL + t.at[some] * (2 * ALL), t.place[some]
            for cells in (path[:-1] * ALL + path[1:], base + path[place - 1], base + ALL + path[place + 1]):
                np.add.at(total, cells, 1)
        cell = np.flatnonzero(total)
        for k in range(0, len(cell), 100_000):
            part = cell[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])

    got = ids.where("learnt").select("at", "rare_class").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[got["cell"].to_numpy()] = got["n"].to_numpy()
    sides = total[ALL * ALL :].reshape(-1, 2, ALL)
    return total[: ALL * ALL].reshape(ALL, ALL), sides[:, 0], sides[:, 1]


def transitions(bigrams: np.ndarray) -> np.ndarray:
    """p(next class | class), backed off to the classes' own shares."""
    unigram = (bigrams.sum(0) + 1) / (bigrams.sum() + len(bigrams))
    return (bigrams + BACKOFF * unigram) / (bigrams.sum(1, keepdims=True) + BACKOFF)


def exchanged(lexicon: Lexicon, bigrams: np.ndarray, left: np.ndarray, right: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """Classes after each movable word moved to where its neighbours and its share of the class are most likely."""
    p = np.log(transitions(bigrams))
    n = lexicon.counts[: lexicon.clustered, None]
    mass = np.bincount(lexicon.class_of, n[:, 0], CLASSES)
    gain = left @ p[:, :CLASSES] + right @ p[:CLASSES].T
    others = np.tile(mass, (len(n), 1))
    others[np.arange(len(n)), lexicon.class_of] -= n[:, 0]
    gain -= n * np.log(others + n)
    return np.where(movable, np.argmax(gain, axis=1), lexicon.class_of)


def other_classes(ids: DataFrame, lexicon: Lexicon, bigrams: np.ndarray, fewest: int) -> DataFrame:
    """(word, class) of every word outside the rounds that occurs often enough: an exchange against the classes made.

    A row per word and neighbouring class of a slice of texts; the words are its keys, and none is among the most
    frequent, so no key is hot.
    """
    spark = ids.sparkSession
    sent = share(spark, (lexicon.words[lexicon.clustered :], lexicon.classes, lexicon.clustered))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, clustered = shared(sent)
        total = np.zeros(len(words) * 2 * ALL, np.int32)
        names = ["word", "cell", "n"]
        for batch in slices(batches, 2000):
            t = Tokens(batch)
            path = t.path(t.values(classes, t.spelled))
            some = np.flatnonzero(t.at >= clustered)
            for which, cells in ((some, (t.at[some] - clustered) * (2 * ALL)), (t.rest, t.other * (2 * ALL))):
                cells = np.concatenate([cells + path[t.place[which] - 1], cells + ALL + path[t.place[which] + 1]])
                if which is some:
                    np.add.at(total, cells, 1)
                else:
                    cell, n = np.unique(cells, return_counts=True)
                    yield pa.RecordBatch.from_arrays([batch["rare"].flatten().take(pa.array(cell // (2 * ALL))), pa.array((cell % (2 * ALL)).astype(np.int32)), pa.array(n.astype(np.int64))], names)
        held, own = np.flatnonzero(total), pa.array(words, pa.binary())
        for k in range(0, len(held), 100_000):
            part = held[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([own.take(pa.array(part // (2 * ALL))), pa.array((part % (2 * ALL)).astype(np.int32)), pa.array(total[part].astype(np.int64))], names)

    p = np.log(transitions(bigrams))
    gains = np.rint(np.concatenate([p[:, :CLASSES], p[:CLASSES].T]) * UNIT).astype(np.int64)
    mass = np.bincount(lexicon.class_of, lexicon.counts[: lexicon.clustered], CLASSES)
    table = spark.createDataFrame([(k, *map(int, g)) for k, g in enumerate(gains)], "cell int, " + ", ".join(f"g{k} bigint" for k in range(CLASSES)))
    rows = ids.where("learnt").select("at", "rare_class", "rare").mapInArrow(count, "word binary, cell int, n bigint")
    found = rows.repartition("word").join(F.broadcast(table), "cell").groupBy("word").agg(
        F.sum(F.when(F.col("cell") < ALL, F.col("n")).otherwise(0)).alias("n"), *(F.sum(F.col("n") * F.col(f"g{k}")).alias(f"g{k}") for k in range(CLASSES))
    ).where(F.col("n") >= fewest)
    gain = F.array(*(F.col(f"g{k}") / UNIT - F.col("n") * F.log(F.lit(float(mass[k])) + F.col("n")) for k in range(CLASSES)))
    return found.select("word", gain.alias("gain")).select("word", (F.array_position("gain", F.array_max("gain")) - 1).cast("int").alias("class"))


def train(ids: DataFrame, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS, fewest: int = FEWEST) -> tuple[Lexicon, DataFrame]:
    """The lexicon with its classes, and (word, class) of all exchanged words as a kept table."""
    spark = ids.sparkSession
    clustered = min(len(words), CLUSTERED)
    classes = np.array([zlib.crc32(w[-2:]) // SPELLINGS % CLASSES if k < clustered else spelling(w) for k, w in enumerate(words)], np.int64)
    lexicon = Lexicon(words, counts, classes, clustered)
    turn = np.arange(clustered)
    for r in range(rounds):
        bigrams, left, right = class_counts(ids, lexicon)
        lexicon.classes[:clustered] = exchanged(lexicon, bigrams, left, right, (turn % 2 == r % 2) if r else turn >= 0)
    # the last count is one exchange old, which is as good a measure for the words that follow
    others = keep(other_classes(ids, lexicon, bigrams if rounds else class_counts(ids, lexicon)[0], fewest), "lm-others")
    place = {w: k for k, w in enumerate(words[clustered:], clustered)}
    if place:
        outside = spark.createDataFrame([(w,) for w in place], "word binary")
        for row in others.join(F.broadcast(outside), "word").collect():  # no more than the lexicon has
            lexicon.classes[place[bytes(row["word"])]] = row["class"]
    own = spark.createDataFrame(list(zip(words[:clustered], map(int, lexicon.class_of), strict=True)), "word binary, class int")
    return lexicon, own.unionByName(others)


PATHS = "doc_id bigint, learnt boolean, tokens bigint, known bigint, base double, emit double, path binary"


def to_paths(ids: DataFrame, lexicon: Lexicon, vocabulary: DataFrame) -> DataFrame:
    """Each document's classes, known tokens, and logs of its words' counts, smoothed (base) and as emitted (emit).

    `vocabulary` (word, n, class) gives those of the words outside the lexicon.
    """
    hits = ids.select("row", F.posexplode("rare").alias("k", "word")).join(vocabulary, "word").groupBy("row").agg(F.collect_list(F.struct("k", "n", "class")).alias("hits"))
    sent = share(ids.sparkSession, (lexicon.counts, lexicon.classes))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, classes = shared(sent)
        for batch in slices(batches, 500):
            t = Tokens(batch)
            n, c = np.zeros(len(t.spelled), np.int64), t.spelled.copy()
            sizes = [len(h) if h.is_valid else 0 for h in batch["hits"]]
            found = batch["hits"].flatten()
            if len(found):
                k, times, kind = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                at = np.repeat(t.first, sizes) + k
                n[at], c[at] = times, kind
            times, path = t.values(counts, n), t.values(classes, c)
            smooth = np.log10(times + ALPHA)
            exact = np.where(path < CLASSES, np.log10(np.maximum(times, 1)), smooth)
            of, rows = t.of, t.documents
            edge = np.searchsorted(of, np.arange(rows + 1))
            raw = path.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["learnt"], pa.array(np.diff(edge) + 1), pa.array(np.bincount(of[times > 0], minlength=rows)), pa.array(np.bincount(of, smooth, rows)), pa.array(np.bincount(of, exact, rows)),
                 pa.array([raw[a:b] for a, b in zip(edge, edge[1:], strict=False)], pa.binary())],
                ["doc_id", "learnt", "tokens", "known", "base", "emit", "path"],
            )

    return ids.join(hits, "row", "left").select("doc_id", "learnt", "at", "rare_class", "hits").mapInArrow(resolve, PATHS)


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Class paths of a batch with ends around them, and the document of each transition."""
    paths = batch["path"].to_pylist()
    end = bytes([ENDS])
    run = np.frombuffer(end + b"".join(p + end for p in paths), np.uint8).astype(np.int64)
    return run, np.repeat(np.arange(len(paths)), [len(p) + 1 for p in paths])


def path_bigrams(paths: DataFrame) -> np.ndarray:
    """Class bigrams of the training documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL * ALL, np.int64)
        for batch in slices(batches, 1000):
            run, _ = _runs(batch)
            total += np.bincount(run[:-1] * ALL + run[1:], minlength=ALL * ALL)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ALL * ALL)), pa.array(total)], ["cell", "n"])

    got = paths.where("learnt").select("path").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ALL * ALL, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(ALL, ALL)


def class_mass(vocabulary: DataFrame) -> np.ndarray:
    """log10 of what each class's words share: their counts, and a part for unseen words in classes by spelling."""
    mass, kinds = np.zeros(ALL), np.zeros(ALL)
    for row in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[row["class"]], kinds[row["class"]] = row.n, row.v
    spelled = np.arange(ALL) >= CLASSES
    out = np.log10(np.where(spelled, mass + ALPHA * (kinds + 1), np.maximum(mass, 1)))
    out[ENDS] = 0
    return out


def score_texts(documents: DataFrame, *, modulus: int = 10, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text).

    Null text counts as empty (its end is still a token). Repeated rows are scored each; rows of a null doc_id are
    neither held out nor learnt from. Without training texts all words are unseen and scores stay finite. Other
    columns are not read.
    """
    learnt = F.coalesce(fold("doc_id", modulus) != held_out, F.lit(False))
    rows = documents.select("doc_id", learnt.alias("learnt"), "text")
    counts = keep(word_counts(rows.where("learnt")), "lm-counts")
    total, distinct, ends = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.expr("word = X''"), F.col("n")).otherwise(0))).first()
    total, ends = total or 0, ends or 0
    seen = counts.where("word != X''")
    words, n = frequent(seen, LEXICON)
    ids = keep(to_ids(rows, words), "lm-ids")
    lexicon, classes = train(ids, words, n)
    vocabulary = keep(seen.join(classes, "word", "left").select("word", "n", F.coalesce("class", spelling_column("word")).alias("class")), "lm-words")
    least = int(n[-1]) if len(n) else 0
    rest = vocabulary.where(F.col("n") < least) if least else vocabulary
    paths = keep(to_paths(ids, lexicon, rest), "lm-paths")
    move = np.log10(transitions(path_bigrams(paths)))
    sent = share(documents.sparkSession, (move, class_mass(vocabulary)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move, spread = shared(sent)
        step = (move - spread[None, :]).ravel()
        for batch in slices(batches, 1000):
            run, of = _runs(batch)
            score = np.bincount(of, step[run[:-1] * ALL + run[1:]], batch.num_rows) + batch["emit"].to_numpy()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tokens"], batch["known"], batch["base"], pa.array(score)], ["doc_id", "tokens", "known", "base", "score"])

    out = paths.select("doc_id", "tokens", "known", "base", "emit", "path").mapInArrow(apply, "doc_id bigint, tokens bigint, known bigint, base double, score double")
    mass = float(np.log10(total + ALPHA * (distinct + 1)))
    return out.select(
        "doc_id", F.coalesce(fold("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.lit(1 if ends else 0)).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.lit(float(np.log10(ends + ALPHA))) - F.col("tokens") * F.lit(mass)).alias("base_score"), "score",
    )
