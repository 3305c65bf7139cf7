import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from turnout.llm import simhash


def brute_print(text, words=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not parts:
        return 0
    grams = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(pairs):
    prints = [(i, brute_print(t)) for i, t in pairs]
    roots = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 4:
                old, new = roots[a], roots[b]
                roots = [new if r == old else r for r in roots]
    least = {r: min(prints[k][0] for k in range(len(pairs)) if roots[k] == r) for r in roots}
    return sorted((prints[k][0], f"{prints[k][1]:016x}", least[roots[k]]) for k in range(len(pairs)))


def test_documents(documents):
    rng = np.random.default_rng(3)
    words = [f"W{i}é" for i in range(60)]
    long = list(rng.choice(words, 4000))
    pairs = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (9, " x y")]
    for k in range(40):
        copy = list(long)
        for _ in range(k % 7):
            copy[rng.integers(len(copy))] = "changed"
        pairs.append((100 - k, " ".join(copy)))
    pairs += [(200 + k, " ".join(rng.choice(words, rng.integers(1, 30)))) for k in range(100)]
    pairs.append((9, " x y"))
    for extra in (False, True):
        out = simhash.near_duplicates(documents(*pairs, extra=extra))
        assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()) == brute(pairs)
    assert simhash.near_duplicates(documents()).count() == 0


def test_null_ids(documents):
    out = simhash.near_duplicates(documents((None, "a b"), (None, "c d e"), (7, "a b"))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 7), (7, 7)]
    kept = simhash.deduplicate(documents((None, "a b"), (7, "a b"), (8, "a b"), (7, "a b")))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 7]


def test_deduplicate_keeps_the_first_of_each_group(documents):
    rng = np.random.default_rng(6)
    words = [f"W{i}é" for i in range(60)]
    pairs = [(4, None), (2, ""), (3, " \t\n"), (9, " x y"), (9, " x y"), (7, "X  y")]
    for k in range(30):
        copy = list(rng.choice(words, rng.integers(200, 300)))
        for id_ in (500 - k, 700 + k):
            pairs.append((id_, " ".join(copy)))
            copy[rng.integers(len(copy))] = "changed"
    kept = simhash.deduplicate(documents(*pairs, extra=True))
    assert kept.columns == documents(extra=True).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _, root in brute(pairs) if i == root})
    assert simhash.deduplicate(documents()).count() == 0


def test_deduplicate_with_maps_and_repeated_ids(spark):
    rows = [(1, "a b", {"k": 1}), (1, "a b", {"k": 1}), (1, "a b", {"k": 2}), (1, "other words", {"k": 1}),
            (2, "other words", None), (None, "a b", None), (None, "a b", {"k": 3})]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, row_key map<string, int>"))
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == [(0, "a b"), (1, "a b"), (1, "other words")]


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 900, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))] +
                          [base[:1] ^ np.uint64(x) for x in rng.integers(0, 2**18, 700)])
    fps = np.unique(np.concatenate([base, near]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    i, j = np.nonzero(apart <= 4)
    expected = simhash.local_components(len(fps), i, j)
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    for sizes in ({"chunk": 100}, {"sample": 200}, {"chunk": 100, "sample": 200, "deep": 100},
                  {"chunk": 50, "sample": 100, "deep": 300, "at_once": 60}):
        found = simhash.links(frame, len(fps), leaf=64, **sizes).collect()
        a, b = (np.array([place[r[k]] for r in found]) for k in (0, 1))
        assert (apart[a, b] <= 4).sum() >= 0
        assert np.array_equal(simhash.local_components(len(fps), a, b), expected)


def test_large_leaves_grow_on(spark):
    """At ten and at a hundred times the sample no task compares more than two chunks, and the leaves
    of the second level are far below those of the first."""
    fps = np.unique(np.random.default_rng(8).integers(0, 2**64, 20000, dtype=np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")

    def sizes(*keys, **how):
        rows = simhash.in_leaves(frame, len(fps), leaf=64, **how).groupBy(*keys).agg(
            F.countDistinct("fp").alias("n"))
        return rows.agg(F.max("n").alias("most")).first().most

    for sample in (2000, 200):
        first = sizes("leaf", "node", sample=sample)
        how = {"chunk": 500, "sample": sample, "deep": 1000, "at_once": 2000}
        assert sizes("leaf", "node", "pair", **how) <= 1200
        assert sample == 2000 or 2 * sizes("leaf", "node", **how) < first
