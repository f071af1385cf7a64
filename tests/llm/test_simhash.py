import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.bktree import Forest, block_masks
from tessera.llm.queries import op5


def classes(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def plain_fingerprint(text):
    words = bytes(ord(chr(c).lower()) if 65 <= c <= 90 else c for c in text.encode()).split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute(rows):
    fps = [plain_fingerprint(t or "") for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    own = classes(len(rows), links)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if own[m] == own[k] and rows[m][0] is not None]
        out.append((i, f"{fps[k]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def result(df):
    rows = df.select("doc_id", simhash.fingerprint_hex().alias("h"), "component_id").collect()
    return sorted(((r.doc_id, r.h, r.component_id) for r in rows), key=str)


def test_forest_finds_the_classes_of_all_pairs():
    rng = np.random.default_rng(3)
    fps = []
    for base in rng.integers(0, 2**63, 60):
        for _ in range(int(rng.integers(1, 25))):
            x = int(base)
            for bit in rng.integers(0, 64, int(rng.integers(0, 6))):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = np.array(fps, np.uint64)  # with repeats
    n = len(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for radius in (3, 4):
        want = classes(n, zip(*(x.tolist() for x in np.nonzero(near <= radius))))
        i, j = Forest(np.zeros(n, np.int64), fps).links(radius, np.arange(n))
        assert (near[i, j] <= radius).all() and classes(n, zip(i.tolist(), j.tolist())) == want
        masks = block_masks(radius)
        t, at = np.repeat(np.arange(len(masks)), n), np.tile(np.arange(n), len(masks))
        i, j = Forest(simhash.shard_of(t, fps[at], masks), fps[at]).links(radius, np.arange(len(at)))
        assert classes(n, zip(at[i].tolist(), at[j].tolist())) == want


def test_dense_group_gives_a_spanning_forest_only():
    rng = np.random.default_rng(5)
    fps = np.unique(np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, 4))) for _ in range(5000)], np.uint64))
    i, _ = Forest(np.zeros(len(fps), np.int64), fps).links(4, np.arange(len(fps)))
    assert len(i) < len(fps)


def test_refused_pairs_are_not_used():
    fps = np.array([0, 1, 3], np.uint64)
    refuse = lambda i, j: np.minimum(i, j) + np.maximum(i, j) == 1  # noqa: E731  0 and 1
    i, j = Forest(np.zeros(3, np.int64), fps).links(4, np.arange(3), refuse)
    assert classes(3, zip(i.tolist(), j.tolist())) == [0, 0, 0] and all({a, b} != {0, 1} for a, b in zip(i.tolist(), j.tolist()))


def test_edge_cases(docs_of):
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    base = " ".join(f"word{k}" for k in range(400))
    rows = [
        (5, base), (3, base), (9, base + " more"), (9, base + " more"), (None, base), (4, ""), (2, None), (7, " \t\n "), (8, "one two"), (11, "ONE\x0btwo"),
        (12, long), (13, long + " end"), (14, "Übung É x"), (15, "übung É x"),
    ]
    assert result(simhash.near_duplicates(docs_of(rows))) == brute(rows)
    assert simhash.near_duplicates(docs_of(rows)).columns == ["doc_id", "fp", "component_id"]
    assert result(simhash.near_duplicates(docs_of([]))) == []


def test_registered_query_against_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in op5(spark, small).collect()), key=str)
    assert got == brute(rows)


def test_keep_one_keeps_the_smallest_of_each_class(docs_of):
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(5, base), (3, base), (3, base), (None, "other text here at all"), (20, "clean words stand alone here")]
    kept = simhash.keep_one(docs_of(rows))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 20]
    assert kept.columns == docs_of(rows).columns


def test_keep_one_tells_rows_apart(docs_of):
    """A doc_id that repeats with another text, null ids, null and empty texts: one row of each class, none lost."""
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(3, base), (5, base), (5, "another text that stands alone"), (None, base), (7, None), (6, ""), (None, "only here without an id"), (None, "only here without an id")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs_of(rows)).collect()), key=str)
    assert kept == sorted([(3, base), (5, "another text that stands alone"), (6, ""), (None, "only here without an id")], key=str)
    assert simhash.keep_one(docs_of([])).collect() == []


def test_hot_classes_are_joined_apart(docs_of, monkeypatch):
    from tessera.llm import common

    base = " ".join(f"word{k}" for k in range(400))
    rows = [(k, base if k % 2 else f"{base} tail{k}") for k in range(40)] + [(100 + k, f"text {k} " * 9) for k in range(20)]
    want = brute(rows)
    for hot in (1, 3, 10**6):
        monkeypatch.setattr(common, "HOT", hot)
        assert result(simhash.near_duplicates(docs_of(rows))) == want


def test_partitions_do_not_matter(docs_of):
    random.seed(2)
    rows = [(k, " ".join(random.choice("abcdefgh") * 3 for _ in range(random.randrange(0, 40)))) for k in range(200)]
    df = docs_of(rows)
    assert result(simhash.near_duplicates(df.repartition(1))) == result(simhash.near_duplicates(df.repartition(9, F.rand(1)))) == brute(rows)
