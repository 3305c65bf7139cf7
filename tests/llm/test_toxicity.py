import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from turnout.llm import toxicity
from turnout.llm.common import held_out


def brute(scores):
    """Maximal scoring segments: the best run, then the same left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = max((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
    i, n = -best[2], -best[1]
    right = [(a + i + n, b + i + n, s) for a, b, s in brute(scores[i + n:])]
    return brute(scores[:i]) + [(i, i + n, best[0])] + right


@given(st.lists(st.sampled_from([-1.75, -0.5, 0.8125, 2.0, 3.25, -4.0]), max_size=24))
@settings(max_examples=300, deadline=None)
def test_segments(scores):
    found = toxicity.segments(np.array(scores))
    expected = brute(scores)
    assert sum(s for *_, s in found) == sum(s for *_, s in expected)
    assert max((s for *_, s in found), default=0) == max((s for *_, s in expected), default=0)


def test_decay():
    share, scores = np.array([0.1, 0.9]), np.array([2.0, -1.0])
    root = toxicity.decay(share, scores)
    assert abs((share * np.exp(root * scores)).sum() - 1) < 1e-6 and root > 0.01


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where(held_out(4, 2)).select("score", "toxic").collect()
    wrong = [(r.score, r.toxic) for r in rows if (r.score >= 0.3) != (r.toxic == 1)]
    print(len(rows), wrong)
    assert len(wrong) <= 0.1 * len(rows)  # few labels at this size
    assert toxicity.passages(docs, model).count() > 0


def test_edges(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(documents((1, "a")), none) is None
    rows = [(i, "fine words here") for i in range(10)] + [(20 + i, "bad awful thing here") for i in range(10)]
    rows += [(40, None), (41, ""), (None, "bad awful"), (1, "fine words here"), (42, "fine " * 100000)]
    labels = spark.createDataFrame([(i, 1, int(i >= 20)) for i in range(30)] + [(None, 1, 1), (40, 1, 0), (41, 0, None)],
                                   none.schema)
    docs = documents(*rows, extra=True)
    out = toxicity.scored(docs, toxicity.train(docs, labels))
    assert out.count() == len(rows) and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    twice = toxicity.scored(docs.selectExpr("*", "'old' AS score"), toxicity.train(docs, labels))
    assert twice.columns.count("score") == 1 and twice.where("score BETWEEN 0 AND 1").count() == len(rows)
    assert toxicity.scored(documents(), None).count() == 0
