"""Clusters, shards and manifests against brute force, and on nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from schemagate.llm import centroids, kdshards, merkle, mixing, quality, queries

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, x string, dots string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, v string, copy int, tree string, i int, shard int"


def vector_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.4, 64).astype(np.float32).tolist(), 1, 0, "x", "y") for i in range(n)]
    rows += [(n, None, 1, 0, "", ""), (n + 1, [1.0] * 63, 1, 0, "", ""), (n + 2, [1.0] * 63 + [None], 1, 0, "", ""), (n + 3, [float("nan")] * 64, 1, 0, "", "")]
    rows += [(n + 4, [float("inf")] + [0.0] * 63, 1, 0, "", ""), (n + 5, [0.0] * 64, None, 0, "", ""), (n + 6, [1e30] * 64, 1, 0, "", "")]
    return [*rows, rows[0], rows[3], (None, rows[5][1], 1, 0, "", ""), (n + 7, rows[7][1], 1, 0, "", "")]


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256.0 * float(v))) for v in e]) for i, e, *_ in rows if e and len(e) == 64 and all(v is not None and np.isfinite(v) and abs(v) < 2**18 for v in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:k]]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centres] for _, x in kept]
        return [(row.index(min(row)), min(row)) for row in d]

    for _ in range(rounds):
        own = defaultdict(list)
        for (_, x), (c, _) in zip(kept, assign(), strict=True):
            own[c].append(x)
        centres = [[sum(v) // len(own[c]) for v in zip(*own[c], strict=True)] if own[c] else centres[c] for c in range(len(centres))]
    found = assign()
    each = defaultdict(int)
    for c, d in found:
        each[c] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, each[c], sum(each.values()), marks[c]) for (i, _), (c, d) in zip(kept, found, strict=True)]


@pytest.mark.parametrize("n,k,rounds", [(120, 7, 4), (3, 40, 5), (60, 40, 1)])
def test_clusters_equal_brute_force(spark, n, k, rounds):
    rows = vector_rows(n) if n > 3 else vector_rows(8)[:3]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), clusters=k, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_clusters(rows, k, rounds)))


def test_clusters_without_vectors(spark):
    none = spark.createDataFrame([(1, None, 1, 0, "", "")], VECTORS)
    assert centroids.cluster_vectors(none).collect() == [] and centroids.cluster_vectors(none.where("false")).count() == 0


def test_products_follow_changes_of_any_size():
    rng = np.random.default_rng(3)
    for big in (300, 2**26):
        x, old, new = (rng.integers(-big, big, (n, 64)) for n in (50, 9, 9))
        new[2], new[4, :60] = old[2], old[4, :60]
        assert (centroids.added_products(x, new - old, x @ old.T) == x @ new.T).all()


def doc_rows():
    rng = np.random.default_rng(5)
    rows = [(i, "w" * int(rng.integers(1, 3000)), ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i % 7}", int(rng.integers(1, 99)) if i % 11 else None, 0, "v", 9, "t", 3, 1) for i in range(600)]
    rows += [(601, None, None, None, None, 0, "", 0, "", 0, 0), (602, "", "en", "é", 1, 0, "", 0, "", 0, 0), (None, "no id", "en", "x", 2, 0, "", 0, "", 0, 0), (604, "ü" * 50_000, "en", "x", 2, 0, "", 0, "", 0, 0)]
    return rows + [(700, "same row again", "fr", "hot", 14, 0, "", 0, "", 0, 0)] * 300 + [(5, "another text", "en", "hot", 1, 0, "", 0, "", 0, 0)]


def check_shards(rows, got, shards, spread):
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size[s] for s in range(shards)) <= spread


@pytest.mark.parametrize("shards", [16, 5, 1])
def test_shards_are_near_equal(spark, shards, monkeypatch):
    monkeypatch.setattr(kdshards, "LAST", 20)
    monkeypatch.setattr(kdshards, "BUCKETS", 8)  # so that values, keys and copies are all searched
    monkeypatch.setattr(kdshards, "COPIES", 64)
    rows = [r for r in doc_rows() if r[0] != 604]
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    got = kdshards.shard_documents(frame, shards=shards).collect()
    check_shards(rows, got, shards, 4 * 3001)
    again = kdshards.shard_documents(frame.repartition(2), shards=shards).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_of_long_few_and_no_documents(spark):
    check_shards(doc_rows(), kdshards.shard_documents(spark.createDataFrame(doc_rows(), DOCS)).collect(), 16, 110_000)
    few = doc_rows()[:3]
    check_shards(few, kdshards.shard_documents(spark.createDataFrame(few, DOCS)).collect(), 16, 3001)
    assert kdshards.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    rows = doc_rows()[:400]
    total = sum(len(r[1]) + 1 for r in rows)
    got = kdshards.shard_documents(spark.createDataFrame(rows, DOCS), target_bytes=total // 7 + 1).collect()
    check_shards(rows, got, 7, 3 * 3001)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Root, and per row its leaf, subroot, proof, folded root, straight from the definition."""
    def leaf(r, change=lambda t: t):
        texts = [r[0], r[3], r[2], r[4], None if r[1] is None else change(r[1])]
        return H(*("-" if t is None else f"{len(str(t).encode())}:{t}" for t in texts))

    def climb(digests):
        steps = [[] for _ in digests]
        place = list(range(len(digests)))
        while len(digests) > 1:
            for k, p in enumerate(place):
                run = digests[p // 8 * 8 : p // 8 * 8 + 8]
                steps[k].append((run[: p % 8], run[p % 8 + 1 :]))
            digests = [H(*digests[a : a + 8]) for a in range(0, len(digests), 8)]
            place = [p // 8 for p in place]
        return digests[0], steps

    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = climb([leaf(r) for r in by[x]])
    root, tops = climb([trees[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for r, own in zip(by[x], trees[x][1], strict=True):
            way = own + tops[k]
            folded = leaf(r, lambda t: t.translate(lower)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            for b, a in way:
                folded = H(*b, folded, *a)
            out.append((r[0], leaf(r), trees[x][0], root, H(*(d for b, a in way for d in (*b, *a))), folded, folded == root))
    return out


@pytest.mark.parametrize("n", [None, 1, 2, 8, 9])
def test_manifest_equals_brute_force(spark, n):
    rows = doc_rows()[:n]
    rows = [(*r[:1], r[1] and r[1][:20] + "ÄBC", *r[2:]) for r in rows]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_manifest(rows)))


def test_manifest_of_several_rounds(spark, monkeypatch):
    """Blocks of eight leaves, so that messages cross three rounds; 600 rows of one language and a hot repeated row."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(*r[:2], "en" if r[0] and r[0] % 50 else f"l{r[0]}", *r[3:]) for r in doc_rows()]
    # tasks import the module anew, with its own LEVELS
    monkeypatch.setattr(merkle, "levels_left", lambda m: int(m > 1))
    got = merkle.manifest(spark.createDataFrame(rows, DOCS))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_manifest(rows)))


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_shards_of_sample_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_kd_shards"](spark, sf_dir)
    assert {(r.law, r.grown_shard) for r in got.collect()} == {("bytes", None)}
    check_shards([(r.doc_id, r.text) for r in docs], got.collect(), 16, 2 * max(len((r.text or "").encode()) for r in docs))


def test_stages_pass_on_columns_of_any_name(spark):
    """Columns named like those that the mixing and quality stages work with come out as they went in."""
    names = ["_size", "_key", "size", "key", "part", "words", "epochs", "cut_key", "cut_size", "cut_words", "of", "doc", "target", "score", "_score", "score_"]
    rows = [(i, f"some words of document {i} " * (i % 5 + 1), ["a", "b", None][i % 3], *[f"{n}{i}" for n in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert all(r[n] == f"{n}{r.doc_id}" for r in mixed.collect() for n in names)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    kept = quality.accepted(docs.withColumn("n_chars", F.length("text").cast("long")), labels, threshold=0.0)
    assert kept.columns == [*docs.columns, "n_chars"] and kept.count() == 30 and all(r[n] == f"{n}{r.doc_id}" for r in kept.collect() for n in names)
