import re

from turnout.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    out = []
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, body in items:
            own = split(body)
            n = min(size, len(own))
            grams = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(words) - n + 1) if grams else ():
                if tuple(words[i:i + n]) in grams:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        out.append((doc, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, documents, docs, items, extra=False):
    frame = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.matches(documents(*docs, extra=extra), frame).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out), key=repr)


def test_matches(spark, documents):
    long = " ".join(f"w{i % 23}x{i}" for i in range(40))
    part = " ".join(long.split()[5:17])
    items = [(1, long), (2, "Short ITEM, three"), (3, "the"), (4, None), (5, "..."), (None, "null id item"),
             (2, "short item three"), (10, "a a a a a a a a a a a a"), (11, part + " Éa 日本")]
    docs = [(1, None), (2, ""), (3, f"x {part.upper()} y"), (3, f"x {part.upper()} y"), (4, "short-item/three the end"),
            (5, "a " * 30), (6, long + " " + long), (None, "null id item and the"), (None, "clean words"),
            (7, "short item four"), (8, " ".join(long.split()[:9])), (9, "pre " * 3000 + part), (12, part + " Éa 日本")]
    assert run(spark, documents, docs, items) == brute(docs, items)
    assert run(spark, documents, docs, items, extra=True) == brute(docs, items)
    named = documents(*docs).selectExpr("*", "1 AS _key", "2 AS hit_key", "3 AS key")
    clean = decontaminate.decontaminate(named, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == named.columns
    bad = {d for d, _, n, _ in brute(docs, items) if n and d}
    assert sorted((r.doc_id or 0) for r in clean.collect()) == [0] + sorted({d for d, _ in docs if d} - bad)


def test_long_text_of_a_frequent_pair(spark, documents):
    """Every place of the text is a shift of the items, and tasks see them in small batches."""
    items = [(1, "ab cd " * 8), (2, "cd ab " * 7 + "end"), (3, "ab cd"), (4, "ab " * 12)]
    docs = [(1, "ab cd " * 6000 + "end"), (2, "ab cd " * 4), (3, "x " * 50 + "cd ab"), (4, "ab x " * 3000), (5, None)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        assert run(spark, documents, docs, items) == brute(docs, items)
        assert run(spark, documents, [*docs, *docs], items) == brute([*docs, *docs], items)
    finally:
        spark.conf.set(size, before)


def test_empty(spark, documents):
    assert run(spark, documents, [(1, "a b")], []) == [(1, 2, 0, [])]
    assert run(spark, documents, [], [(1, "a b")]) == []


def test_proximity(spark, documents):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = documents((1, "alpha x beta gamma"), (2, "alpha beta"), (3, "beta y y y y y y alpha gamma"))
    assert decontaminate.proximity_matches(docs, items, 1).count() >= 1
