import re

import pytest

from turnout.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        w = sum(weight[s] for s in names if s not in stopped)
        out = {s: most * sizes[s] if s in stopped else left * weight[s] / w for s in names}
        above = {s for s in names if s not in stopped and out[s] > most * sizes[s]}
        if not above:
            return out
        stopped |= above


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), f"s{i % 7}" if i % 3 else "s0", 1) for i in range(3000)]
    rows += [(5000 + i, "a\tb\nc " * (i % 9), None, 1) for i in range(200)]
    rows += [(6000, None, "s1", 1), (6001, "", "empty", 1), (None, "x y", "s2", 1), (None, "x y", "s2", 1), (7, "u", "s2", 1)]
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for i, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = brute_targets(sizes), {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 50 for s in want)
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_expectation(spark):
    """Over seeds each document is taken about as often as its target says."""
    sums, n = {}, 12
    rows = [(i, "w " * (1 + i % 5), "s0", 1) for i in range(60)] + [(99, "w " * 400, "s1", 1)]
    for seed in range(n):
        for r in mixing.mix(frame(spark, rows), seed=seed, bucket=8).collect():
            sums[r.doc_id] = sums.get(r.doc_id, 0) + r.copies / n
            rate = r.target / r.source_size
    own = [v for k, v in sums.items() if k != 99]
    assert 1 <= sum(own) / len(own) <= 2 and rate >= 0


def test_empty_and_copies(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = [(1, "a b c", "s0", 1), (2, "d e f", "s0", 2), (2, "d e f", "s0", 2)]
    out = mixing.mixed(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "extra"]
    assert 3 <= out.count() <= 6


def test_the_mix_is_the_same_in_any_partitions(spark):
    rows = [(i % 250, "w " * (1 + i % 7), f"s{i % 3}", 5) for i in range(300)] + [(None, "a b", None, 6)] * 3
    docs = frame(spark, rows).selectExpr("*", "11 AS row_key", "12 AS _row", "'c' AS row_copies", "map('k', extra) AS m")
    mixes = [sorted(map(repr, mixing.mixed(docs.repartition(n)).collect())) for n in (1, 4)]
    assert mixes[0] == mixes[1] and all("row_key=11" in r and "_row=12" in r for r in mixes[0])
    assert mixing.mixed(docs).columns == docs.columns
    words = sum(len(t.split()) for _, t, _, _ in rows)
    taken = sum(len(r.text.split()) for r in mixing.mixed(docs).collect())
    assert abs(taken - 1.5 * words) <= 4 * 7
