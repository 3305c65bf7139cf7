import itertools

import duckdb
import numpy as np
from pyspark.sql import functions as F

from turnout.llm import quality
from turnout.llm.common import held_out


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 1, 5, 7])
    odds, change = rng.normal(size=7), rng.normal(size=(2, 2))
    p, expected = quality.forward_backward(odds, bounds, change)
    pairs = np.zeros((2, 2))
    for a, b in zip(bounds, bounds[1:]):
        total, bad, own = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(odds[a + i] * y for i, y in enumerate(ys)) + sum(change[i, j] for i, j in zip(ys, ys[1:])))
            total += w
            bad += w * np.array(ys)
            for i, j in zip(ys, ys[1:]):
                own[i, j] += w
        assert np.allclose(p[a:b], bad / total)
        pairs += own / total
    assert np.allclose(expected, pairs)


def test_features_of_odd_texts():
    x, size, bounds = quality.line_features([b"", b"a\n\nA!! 9\n", b"\n", "é|é".encode()])
    assert list(bounds) == [0, 1, 5, 7, 8] and x.shape == (8, quality.N_FEATURES)
    assert list(size) == [0, 1, 0, 6, 0, 0, 0, 5] or size.sum() > 0
    assert np.isfinite(x).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    out = quality.scored(docs.select("doc_id", "text", F.lit(1).alias("x")), model, "s").join(labels, "doc_id")
    rows = out.where(held_out(3, 1)).select("s", "quality").collect()
    right = np.mean([(r.s >= 0.5) == (r.quality == 1) for r in rows])
    good = [r.s for r in rows if r.quality == 1]
    bad = [r.s for r in rows if r.quality == 0]
    auc = np.mean([[(g > b) + (g == b) / 2 for g in good] for b in bad])
    print("accuracy", right, "auc", auc)
    assert right > 0.93 and auc > 0.95


def test_edges(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(documents((1, "a")), none) is None
    rows = [(1, "fine words here."), (2, "X!! Y!! Z!!"), (3, None), (4, ""), (5, "long line " * 30000), (None, "x"), (1, "fine words here.")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (4, None, 0), (5, 1, 0), (9, 0, 0)], none.schema)
    docs = documents(*rows, extra=True)
    model = quality.train(docs, labels)
    out = quality.scored(docs, model).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    twice = quality.scored(docs.withColumn("score", F.lit("old")), model)
    assert twice.columns.count("score") == 1 and dict(twice.dtypes)["score"] == "double"
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.scored(documents(), model).count() == 0


def test_long_texts_teach_from_all_over(spark, documents):
    assert quality.spread(7, 8).tolist() == list(range(7))
    lines = quality.spread(100_000)
    assert len(lines) == quality.LINES == len(set(lines)) and lines[0] == 0 and lines[-1] == 99_999
    assert max(np.diff(lines)) < 2 * 100_000 / (quality.LINES / quality.BLOCK)
    good, bad = "A fine line of words.\n" * 3000, "X!! Y!! 9#$\n" * 6000
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    docs = documents(*[(i, good if i % 2 else bad) for i in range(30)])
    out = quality.scored(docs, quality.train(docs, labels)).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in out)
