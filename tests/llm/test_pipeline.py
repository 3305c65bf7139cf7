import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_simhash import brute as near
from turnout.llm import queries

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, copies, leaks and odd rows; ids are not unique, texts may be null."""
    root = str(tmp_path_factory.mktemp("corpus"))
    duckdb.connect().execute(f"""
        COPY (SELECT * FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id LIMIT 150) TO '{root}/base.parquet'""")
    docs = spark.read.parquet(f"{root}/base.parquet").select(*DOCUMENTS)
    more = spark.createDataFrame(
        [(9001, None, "en", None, 0), (9002, "", "en", "s", 0), (None, "no id at all here", "en", "s", 17),
         (9003, "A fine line of words.\n" * 3, None, "s", 60), (9004, "A fine line of words.\n" * 3, "en", "s", 60),
         (9003, "A fine line of words.\n" * 3, None, "s", 60)], docs.schema)
    docs.union(more).write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    return root


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    for name, stage in stages.items():
        before, out = pairs(docs), stage(spark, docs, folder)
        if name != "token-ID / binary output":
            assert out.columns == DOCUMENTS
        out = corpus_pipeline.stored(out, "test-stage")
        if name == "quality classifier":
            assert 0.5 * len(before) < out.count() < len(before)
        elif name == "SimHash near-dedup":
            firsts = {i for i, _, root in near([p for p in before if p[0] is not None]) if i == root}
            assert sorted(i for i, _ in pairs(out) if i is not None) == sorted(firsts)
        elif name == "benchmark decontamination":
            bad = {i for i, _, n, _ in contaminated(before, items) if n}
            assert sorted(pairs(out), key=repr) == sorted((p for p in before if p[0] not in bad), key=repr)
        elif name == "mixing sources to target weights":
            words = lambda rows: sum(len((t or "").split()) for _, t in rows)
            assert set(pairs(out)) <= set(before)
            assert abs(words(pairs(out)) / words(before) - 1.5) < 0.35
        else:
            rows = out.orderBy("start").collect()
            assert sorted((r.doc_id for r in rows), key=repr) == sorted((i for i, _ in before), key=repr)
            assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
        docs = out


def test_empty_corpus(spark, folder, tmp_path):
    root = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0


def test_queries_are_registered():
    names = entry_points.queries()
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) == 1] == list(range(1, 11))
    assert "pipeline" in names and set(queries.SQL) <= set(queries.QUERIES) <= set(names)
