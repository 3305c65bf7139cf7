"""The kept id dictionary: dense numbers after merges, and only touched ranges written again."""

import random

from turnout.operators.id_ranges import IdDictionary, range_of


def numbers(d, run=None):
    return {r["id"]: r["number"] for r in d.numbers(run).collect()}


def dense(ids):
    return {x: i + 1 for i, x in enumerate(sorted({x or "NA" for x in ids}, key=str.encode))}


def frame(spark, ids):
    return spark.createDataFrame([(x,) for x in ids], "id string")


def test_three_merges_equal_dense_ranks(spark, tmp_path):
    rng = random.Random(3)
    pick = lambda n: ["".join(rng.choice("abcÄé😀Z019") for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    d, seen, runs = IdDictionary(spark, str(tmp_path / "ids"), range_ids=40), [], []
    for more in (pick(300), [*pick(200), None, "NA"], pick(500)):
        seen += more
        runs.append(d.update(frame(spark, more)))
        assert numbers(d) == dense(seen)
        assert all(r.n <= 80 for r in d.ranges())
    assert d.update(frame(spark, seen[:50])) == runs[-1]
    gone = set(rng.sample(sorted({x or "NA" for x in seen}), 150))
    d.update(frame(spark, ["new one"]), frame(spark, [*gone, "never there"]))
    left = [x for x in seen if (x or "NA") not in gone] + ["new one"]
    assert numbers(d) == dense(left)
    assert numbers(d, runs[-1]) == dense(seen)
    d.clean({d.current()})
    assert numbers(d) == dense(left)


def test_other_ranges_keep_their_files(spark, tmp_path):
    d = IdDictionary(spark, str(tmp_path / "ids"), range_ids=10)
    ids = [f"{i:04d}" for i in range(200)]
    d.update(frame(spark, ids))
    before = {r.least: r.folder for r in d.ranges()}
    run = d.update(frame(spark, ["0000a", "0000b"]))
    after = {r.least: r.folder for r in d.ranges()}
    assert sum(f.startswith(f"run={run}/") for f in after.values()) == 1
    assert sum(before.get(k) == f for k, f in after.items()) == len(after) - 1
    assert len(list((tmp_path / "ids" / f"run={run}").rglob("*.parquet"))) == 1
    assert numbers(d)["0199"] == 202 and numbers(d)["0000a"] == 2


def test_all_ids_gone(spark, tmp_path):
    d = IdDictionary(spark, str(tmp_path / "ids"))
    assert d.current() is None and d.ranges() == []
    d.update(frame(spark, ["a", "b"]))
    d.update(frame(spark, []), frame(spark, ["a", "b"]))
    assert numbers(d) == {}
    d.update(frame(spark, ["c"]))
    assert numbers(d) == {"c": 1}


def test_ranges_by_bounds(spark):
    bounds = ["b", "d", "f", "h", "j"]
    found = frame(spark, ["a", "b", "c", "d", "e", "h", "zz"]).select("id", range_of("id", bounds).alias("place"))
    assert {r["id"]: r["place"] for r in found.collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "h": 3, "zz": 4}
