import math
from fractions import Fraction

import numpy as np
import pytest

from turnout.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors):
    """(n, integers, exact covariance as floats) of the vectors that count."""
    kept = [(k, v) for k, v in vectors
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] + [1000000] * (dims - len(v)) for _, v in kept]
    n, sums = len(x), [sum(r[d] for r in x) for d in range(dims)]
    cov = [[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n ** 3)) if n else 0.0
            for j in range(dims)] for i in range(dims)]
    deviation = [sum((n * r[d] - sums[d]) ** 2 for d in range(dims)) for r in x]
    return n, [k for k, _ in kept], np.array(x, object), sums, np.array(cov), deviation


def check(spark, vectors, count=32, schema=SCHEMA):
    out = whitening.components(spark.createDataFrame(vectors, schema).repartition(3), count=count).collect()
    n, keys, x, sums, cov, deviation = brute(vectors)
    values, units = np.linalg.eigh(cov)
    order = np.argsort(-values)[:count]
    assert sorted((r.vec_id, r.component) for r in out) == sorted(
        (k, c + 1) for k in keys for c in range(len(order)))
    assert sorted((r.vec_id, r.deviation) for r in out if r.component == 1) == sorted(
        (k, d if d < 2 ** 63 else None) for k, d in zip(keys, deviation))
    assert all(r.n == n and r.identity_error <= 1e-4 for r in out)
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(row, sums)] for row in x])
    flat = values[order] <= values[order][0] * len(sums) * np.finfo(float).eps
    for c, k in enumerate(order):
        own = {r.vec_id: r for r in out if r.component == c + 1}
        if flat[c]:
            assert all(r.whitened is None for r in own.values())
            continue
        expected = centred @ units[:, k] / math.sqrt(values[k])
        got = np.array([own[key].whitened for key in keys])
        gap = min(np.abs(got - expected).max(), np.abs(got + expected).max())
        assert gap < 1e-7 * max(1, np.abs(expected).max())
        share = {r.explained for r in own.values()}
        assert len(share) == 1 and abs(share.pop() - values[k] / np.trace(cov)) <= 1e-9
    return out


def test_random_vectors(spark):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) / 40
    check(spark, [(i, v.tolist()) for i, v in enumerate(mixed)])


def test_a_few_components_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (500, 3)) * 10 ** 6 + 7
    low = x.min(axis=0)
    bits = np.array([int(v).bit_length() for v in x.max(axis=0) - low])
    counts = whitening.popcounts(whitening.planes(x, low, bits))
    dim, bit = np.repeat(np.arange(3), bits), np.concatenate([np.arange(b) for b in bits])
    for i in range(3):
        for j in range(i, 3):
            found = sum(int(counts[min(a, b), max(a, b)]) << int(bit[a] + bit[b])
                        for a in np.flatnonzero(dim == i) for b in np.flatnonzero(dim == j))
            assert found == int(((x - low)[:, i] * (x - low)[:, j]).sum())
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)))]
    expected = check(spark, vectors, count=2)
    monkeypatch.setattr(whitening, "BLOCK", 16)
    assert [r.deviation for r in sorted(check(spark, vectors, count=2))] == [r.deviation for r in sorted(expected)]


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))]
    vectors += [(100, None), (101, [1.0, None, 2.0, 0.0]), (102, [math.nan] * 4), (103, [0.0, math.inf, 0.0, 0.0]),
                (104, []), (105, [0.5]), (106, [0.0] * 4), (7, [0.25, 0.5, 1.0, 2.0])]
    out = check(spark, vectors[:-1])
    assert not {100, 101, 102, 103} & {r.vec_id for r in out} and {104, 105, 106} <= {r.vec_id for r in out}
    frame = spark.createDataFrame(vectors + [(None, [1.0] * 4)], SCHEMA).selectExpr(
        "*", "1 AS deviation", "'x' AS whitened", "2 AS key", "3 AS n")
    twice = whitening.components(frame)
    assert twice.where("vec_id = 7").count() == 8 and twice.where("vec_id IS NULL").count() == 4
    model = whitening.fit(frame)
    assert whitening.transformed(frame, model).columns == ["vec_id", "embedding", "key", "n", "deviation", "whitened"]


def test_large_and_constant_entries(spark):
    rng = np.random.default_rng(5)
    wide = [(i, [float(v), 3.0, 1e9 * float(w), float(v)]) for i, (v, w) in enumerate(rng.normal(size=(50, 2)))]
    out = check(spark, wide)
    assert {r.deviation for r in out} == {None} or any(r.deviation is None for r in out)
    huge = [(i, [1e37 * i, 1.0]) for i in range(4)]
    assert len(whitening.components(spark.createDataFrame(huge, SCHEMA)).collect()) == 8
    same = whitening.components(spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], SCHEMA)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, None, 0.0)] * 4


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [None])]])
def test_no_vectors(spark, rows):
    out = whitening.components(spark.createDataFrame(rows, SCHEMA))
    assert out.collect() == [] and dict(out.dtypes)["component"] == "int"


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    out = queries.QUERIES["op13_embedding_whitening"](spark, folder)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                          ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    n, keys, x, sums, cov, deviation = brute(rows)
    got = out.collect()
    assert len(got) == 32 * len(keys) and {r.n for r in got} == {n}
    assert {r.vec_id: r.deviation for r in got} == dict(zip(keys, deviation))
    top = np.sort(np.linalg.eigvalsh(cov))[::-1][:32] / np.trace(cov)
    assert np.allclose(top, [next(r.explained for r in got if r.component == c) for c in range(1, 33)], rtol=1e-9)
