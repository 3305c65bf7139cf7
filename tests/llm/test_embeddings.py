import numpy as np
import pytest

from turnout.llm import embeddings


def brute(rows, least=0.9):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(e is not None and np.isfinite(e) for e in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            good[k] = x / np.linalg.norm(x)
    n, root = [0] * len(rows), list(range(len(rows)))
    for a in good:
        for b in good:
            if b < a and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least:
                n[a] += 1
                n[b] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    ids = [i for i, _ in rows]
    low = {r: min((ids[k] for k in range(len(rows)) if root[k] == r and ids[k] is not None), default=None) for r in root}
    return sorted(((ids[k], n[k], low[root[k]]) for k in range(len(rows))), key=repr)


@pytest.mark.parametrize("chunk", [4096, 60])
@pytest.mark.parametrize("reach, kind", [(0.2, "double"), (None, "double"), (None, "float")])
def test_near_duplicates(spark, chunk, reach, kind):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(60):
        base = rng.normal(size=32)
        for _ in range(1 + g % 5):
            rows.append((len(rows), [float(x) for x in (base + 0.25 * rng.normal(size=32))]))
    hot = rng.normal(size=32)
    rows += [(1000 + k, [float(x) for x in (hot + 0.2 * rng.normal(size=32))]) for k in range(150)]
    rows += [(2000 + k, [float(x) for x in hot]) for k in range(40)]
    rows += [(1, rows[0][1]), (None, rows[0][1]), (3000, None), (3001, []), (3002, [0.0] * 32), (3003, [float("nan")] * 32),
             (3004, [None] * 32), (3005, [1e300] * 32), (3006, [2e300] * 32), (3007, [1.0, 0.0]), (3008, [2.0, 0.0]), (None, None)]
    if kind == "float":  # single precision has no 1e300
        rows = [(i, v and [None if e is None else float(np.float32(min(e, 1e30))) if e == e else e for e in v]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                                  f"vec_id long, embedding array<{kind}>, cell int, v string")
    out = embeddings.near_duplicates(frame, cell=40, chunk=chunk, reach=reach).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr)
    expected = brute(rows)
    assert len(got) == len(expected)
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    assert not wrong if reach is None else len(wrong) <= 0.02 * len(rows), wrong[:5]
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"cell": 50, "chunk": 30}])
def test_default_loses_no_pair_of_a_dense_cluster(spark, sizes):
    """A hot cluster just above the bound with a centre for every few members."""
    rng = np.random.default_rng(2)
    hot = rng.normal(size=64)
    hot /= np.linalg.norm(hot)
    noise = rng.normal(size=(500, 64)) / 8
    rows = [(k, [float(e) for e in hot + 0.34 * x]) for k, x in enumerate(noise)]
    rows += [(1000 + k, [float(e) for e in rng.normal(size=64)]) for k in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = embeddings.near_duplicates(frame, **sizes)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert links[:500].sum() > 1000
    assert {r.vec_id: r.n_links for r in out.collect()} == {i: int(n) for (i, _), n in zip(rows, links)}


@pytest.mark.parametrize("size, spread", [(64, 1.0), (64, 0.3), (10, 1.0), (30, 0.05)])
def test_bounded_products_lose_nothing(size, spread):
    """Blocks with few and with many near pairs, few and many coordinates."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=size) + spread * rng.normal(size=(700, size))
    x = np.concatenate([x, x[:60] + 0.05 * rng.normal(size=(60, size))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    short = embeddings._bounds(x, embeddings.turned(x[:100]))
    pairs = {p for low in range(0, len(x), 200)
             for p in zip(*map(list, embeddings._near(x, short, low, min(low + 200, len(x)), 0.9)))}
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert pairs == set(zip(a, b))


def test_measured_recall_of_a_smaller_reach(spark):
    """A reach of 0.15 keeps 0.99 of the links between cells of spread groups."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 64))
    x = np.concatenate([base + 0.28 * rng.normal(size=(500, 64)) for _ in range(4)])
    frame = spark.createDataFrame([(k, [float(e) for e in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = int((x @ x.T >= 0.9).sum()) - len(x)
    found = sum(r.n_links for r in embeddings.near_duplicates(frame, cell=50, reach=0.15).collect())
    assert 0.99 * links <= found <= links
