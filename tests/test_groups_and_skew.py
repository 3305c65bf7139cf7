"""Group operators against brute force, with one group holding a third of all rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnout.operators import groups, identity, joins
from turnout.sinks.versions import all_but, exact_duplicates, stale_versions, unseen_versions


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    rows = [("hot", i, rng.randrange(5)) for i in range(2000)]
    rows += [(f"k{rng.randrange(500)}", i, rng.randrange(5)) for i in range(2000, 6000)]
    return rows


def test_group_max_with_ties(spark, rows, skewed):
    df = spark.createDataFrame(skewed, "k string, n int, v int")
    top = defaultdict(int)
    for k, _, v in skewed:
        top[k] = max(top[k], v)
    kept = groups.keep_group_max(df, ["k"], F.col("v"), drop_group_if_null=False)
    assert rows(kept) == sorted(((k, n, v) for k, n, v in skewed if v == top[k]), key=repr)


def test_group_stats_on_every_row(spark, rows, skewed):
    df = spark.createDataFrame(skewed, "k string, n int, v int")
    size = defaultdict(int)
    for k, _, _ in skewed:
        size[k] += 1
    counted = groups.with_group_stats(df, ["k"], F.count("*").alias("total"))
    assert rows(counted) == sorted(((k, n, v, size[k]) for k, n, v in skewed), key=repr)


def test_groups_are_repeated_only_on_demand(spark, rows, skewed):
    df = spark.createDataFrame(skewed, "k string, n int, v int")
    plain = groups.with_group_stats(df, ["k"], F.count("*").alias("total"))
    salted = groups.with_group_stats(df, ["k"], F.count("*").alias("total"), salts=8)
    assert rows(plain) == rows(salted)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (plain, salted)]
    assert "Generate" not in plans[0] and "Generate" in plans[1]


def test_group_with_a_null_value_is_dropped_whole(spark, rows):
    df = spark.createDataFrame(
        [("a", 1), ("a", None), ("b", 2), ("b", 2), ("b", 1), ("c", None), (None, 3)],
        "k string, v int")
    drop = groups.keep_group_max(df, ["k"], F.col("v"), drop_group_if_null=True)
    assert rows(drop) == [("b", 2), (None, 3)]
    keep = groups.keep_group_max(df, ["k"], F.col("v"), drop_group_if_null=False)
    assert rows(keep) == [("a", 1), ("b", 2), (None, 3)]
    plan = drop._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Join" not in plan


def test_null_ids_on_both_sides_meet(spark, rows):
    pairs = spark.createDataFrame([(None, 1, "p"), (None, 2, "p"), ("a", 1, "p")],
                                  "id string, year int, programme string")
    facts = spark.createDataFrame([(None, "x"), (None, "y"), ("b", "z")], "id string, sex string")
    assert rows(joins.attach_people(pairs, facts), "id", "year", "sex") == sorted(
        [(None, 1, "x"), (None, 1, "y"), (None, 2, "x"), (None, 2, "y"), ("a", 1, None)], key=repr)


def test_first_in_group_is_limited_before_the_shuffle(spark, rows, skewed):
    df = spark.createDataFrame(skewed, "k string, n int, v int")
    first = groups.first_in_group(df, ["k"], ["v", "n"])
    best = {}
    for k, n, v in skewed:
        best[k] = min(best.get(k, (v, n)), (v, n))
    assert rows(first) == sorted(((k, n, v) for k, (v, n) in best.items()), key=repr)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_stale_versions(spark, rows, skewed):
    catalog = spark.createDataFrame(
        [(k, f"v{n:05}", v) for k, n, v in skewed], "name string, version string, stored_at int")
    by_name = defaultdict(list)
    for k, n, v in skewed:
        by_name[k].append((v, f"v{n:05}"))
    expected = [(k, version, v) for k, all_of in by_name.items()
                for v, version in sorted(all_of, reverse=True)[3:]]
    assert rows(stale_versions(catalog, 3)) == sorted(expected, key=repr)


def test_exact_duplicates(spark, rows):
    files = [("d", f"f{i:04}", i % 7, "same" if i % 3 == 0 else f"text {i % 50}")
             for i in range(900)]
    files += [("other", "f0000", 0, "same"), ("d", "empty", 1, "")]
    df = spark.createDataFrame(files, "folder string, name string, modified int, content string")
    kept = {}
    for folder, name, age, text in files:
        key = (folder, text)
        kept[key] = min(kept.get(key, (age, name)), (age, name))
    expected = [(d, n, a) for d, n, a, x in files if kept[(d, x)] != (a, n)]
    assert rows(exact_duplicates(df)) == sorted(expected, key=repr)


def test_two_equal_files_lose_the_later_name(table, rows):
    df = table("folder string, name string, modified int, content string",
               ("d", "dup-1.csv", 1, "same\ncontent"), ("d", "dup-2.csv", 1, "same\ncontent"),
               ("d", "unique.csv", 1, "different"))
    assert rows(exact_duplicates(df), "name") == [("dup-2.csv",)]


def test_unseen_versions(table, rows):
    candidates = table("name string, fingerprint string, version string",
                       ("a", "1", "v2"), ("a", "1", "v1"), ("a", "2", "v3"), ("b", "1", "v4"))
    catalog = table("name string, fingerprint string", ("a", "2"), ("b", "9"))
    assert rows(unseen_versions(candidates, catalog), "name", "version") == [
        ("a", "v1"), ("b", "v4")]
    left = all_but(candidates, candidates.filter("version = 'v1'"), ["version"])
    assert left.count() == 3


def test_surrogate_ids_are_dense_and_sorted(spark, rows, skewed):
    ids = spark.createDataFrame([(k,) for k, _, _ in skewed] + [(None,)], "id string")
    numbers = identity.surrogate_ids(ids)
    expected = sorted({k for k, _, _ in skewed} | {"NA"})
    assert sorted(tuple(r) for r in numbers.collect()) == [
        (k, i) for i, k in enumerate(expected, start=1)]
    replaced = identity.with_surrogate_id(ids, numbers)
    assert replaced.count() == len(skewed) + 1
    assert replaced.agg(F.countDistinct("id")).first()[0] == len(expected)
    both = identity.with_surrogate_id(ids, numbers, into="number")
    assert both.filter("id IS NULL").first()["number"] == expected.index("NA") + 1


def test_people_join_with_shared_ids(spark, rows):
    pairs = [("EXTERNAL", 2019, f"p{i}") for i in range(5)] + [("1", 2019, "p"), ("2", 2019, "p")]
    facts = [("2019", "EXTERNAL", "F"), ("2019", "1", "F"), ("2020", "1", "M")]
    p = spark.createDataFrame(pairs, "id string, year int, programme string")
    f = spark.createDataFrame(facts, "updated string, id string, sex string")
    expected = []
    for i, y, prog in pairs:
        found = [(u, s) for u, j, s in facts if j == i] or [(None, None)]
        for u, s in found:
            expected.append((i, y, prog, u, "EXTERNAL" if i == "EXTERNAL" else s))
    assert rows(joins.attach_people(p, f)) == sorted(expected, key=repr)


def numbered(spark, tmp_path, pairs, facts):
    """Tables of pairs, facts and the numbers of all ids."""
    out = []
    ids = pairs.select("id").union(facts.select("id"))
    for name, df in (("pairs", pairs), ("facts", facts), ("numbers", identity.surrogate_ids(ids))):
        df.write.parquet(f"{tmp_path}/{name}")
        out.append(spark.read.parquet(f"{tmp_path}/{name}"))
    return out


def test_numbered_people_equal_the_plain_joins(spark, rows, tmp_path):
    pairs = spark.createDataFrame(
        [(i, y, p) for i in (None, "NA", "EXTERNAL", "x EXTERNAL", "a", "b", "") for y in (1, 2) for p in "pq"],
        "id string, year int, programme string")
    facts = spark.createDataFrame(
        [(u, i, s) for i in (None, "EXTERNAL", "x EXTERNAL", "a", "c") for u in "12" for s in ("F", None)],
        "updated string, id string, sex string")
    for case, people in enumerate((facts, facts.filter("id = 'a'"), facts.filter("false"))):
        p, f, n = numbered(spark, tmp_path / str(case), pairs, people)
        found = joins.attach_numbered_people(p, f, n)
        assert found.columns == ["id", "year", "programme", "number", "updated", "sex"]
        plain = joins.attach_people(p, f)
        assert rows(found.drop("number")) == rows(plain.select("id", "year", "programme", "updated", "sex"))
        number = {r.id: r.number for r in n.collect()}
        assert all(r.number == number["NA" if r.id is None else r.id] for r in found.collect())


def test_pairs_move_once_and_shared_ids_are_split(spark, tmp_path):
    many = 100_000
    pairs = spark.range(2 * many).selectExpr(
        "IF(id % 2 = 0, NULL, CAST(id AS string)) AS id", "2020 AS year",
        "CONCAT('p', IF(id % 2 = 0, id % 6, id)) AS programme").distinct()
    facts = spark.range(2 * many).selectExpr(
        "'2020' AS updated", "IF(id % 2 = 0, NULL, CAST(id AS string)) AS id", "CAST(id AS string) AS name")
    p, f, n = numbered(spark, tmp_path, pairs, facts)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = joins.attach_numbered_people(p, f, n)
        plan = joins.named_people(p, f, n)._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in found.filter("id IS NULL").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sum(sizes) == 3 * many  # every null pair with every null person
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 3, sizes
    assert plan.count("Exchange hashpartitioning") == 3  # pairs, numbers and people move once each
