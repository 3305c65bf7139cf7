"""Versioned tables, archives, year folders, sheets and column checks."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnout.checked import storage
from turnout.functions.fingerprint import fingerprint_text
from turnout.session import FREED, OPEN_FILES, written
from turnout.sinks import duplicates, versions
from turnout.sources import conformance, tables


@pytest.fixture
def frames(table):
    one = table("id int, value string", (1, "a"), (2, "b"))
    two = table("id int, value string", (1, "a"), (2, "b"), (3, "c"))
    return one, two


def test_uploads_are_archived_outside_the_year_folders(spark, frames, tmp_path):
    root = str(tmp_path)
    path = versions.archive_upload(frames[0], root, "2026", "sample")
    assert path.startswith(f"{root}/uploads/2026/sample/")
    assert spark.read.parquet(path).count() == 2
    assert not (tmp_path / "2026").exists()
    later = versions.archive_upload(frames[1], root, "2026", "sample")
    kept = versions.archived_uploads(spark, root, "2026", "sample")
    assert path != later and kept.count() == 5 and kept.select("upload").distinct().count() == 2


def test_a_lost_run_leaves_the_tables_of_the_last_one(spark, frames, tmp_path):
    target = versions.VersionedTables(spark, str(tmp_path))
    target.publish_all(dict(zip(("a", "b"), frames)))
    before = target.current_versions()
    broken = frames[0].selectExpr("CAST(raise_error('lost') AS INT) AS id", "value")
    with pytest.raises(Exception, match="lost"):
        target.publish_all({"a": frames[1], "b": broken})
    assert target.current_versions() == before and target.read("a").count() == 2


def test_published_years_are_partitions(spark, table, tmp_path):
    target = versions.VersionedTables(spark, str(tmp_path))
    target.publish_all({"studio": table("id string, year string", ("1", "2019"), ("2", "2020"))})
    chosen = target.read("studio").filter("year IN ('2020')")
    assert [r["id"] for r in chosen.collect()] == ["2"]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1][:60]


def test_the_log_is_compacted(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "COMPACT_FROM", 3)
    target = versions.VersionedTables(spark, str(tmp_path), keep=0)
    for n in range(1, 6):
        target.publish_all({"a": table("id int", *[(i,) for i in range(n)])})
    assert len(spark.read.parquet(target.log_path).inputFiles()) < 3
    assert target.versions("a").count() == 5 and target.read("a").count() == 5


def test_the_log_stays_bounded_over_many_runs(spark, table, tmp_path, monkeypatch):
    """Kept versions and the last publishes remain, with the rows of the runs since the compaction."""
    monkeypatch.setattr(versions, "COMPACT_FROM", 4)
    target, sizes = versions.VersionedTables(spark, str(tmp_path), keep=2), []
    for n in range(1, 25):
        target.publish_all({"a": table("id int", (n,))})
        if n % 6 == 0:
            sizes.append(target.log().count())
            assert [r["id"] for r in target.read("a").collect()] == [n]
            assert target.versions("a").count() == 2
            mirror = target.read("a", target.mirror_version("a"))
            assert [r["id"] for r in mirror.collect()] == [n - 1]
    # two kept versions and two publishes, then a store, a publish and a prune for each run
    assert max(sizes) <= 4 + 3 * 4, sizes


def test_duplicate_files_are_removed_in_every_folder(spark, tmp_path):
    for name, text, age in [("x/a", "one", 1), ("x/b", "one", 2), ("y/c", "one", 3), ("y/z/d", "two", 1),
                            ("y/z/e", "two", 1), ("y/z/f", "three", 0)]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (1e9 + age, 1e9 + age))
    assert versions.remove_duplicate_files(spark, str(tmp_path)) == 2
    left = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".crc")
    assert left == ["x/a", "y/c", "y/z/d", "y/z/f"]
    assert versions.remove_duplicate_files(spark, str(tmp_path)) == 0


@pytest.fixture
def copies(tmp_path):
    texts = {"x/a": "one", "x/b": "one", "x/c": "two", "x/d": "a long text", "x/e": "a long text", "x/f": "a 10ng text",
             "x/g h%20": "one", "x/i": "", "x/l": "", "y/a": "one", "y/j": "the only one of its size", "y/k": "a long text"}
    for age, (name, text) in enumerate(texts.items()):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
        os.utime(path, (1e9 + age, 1e9 + age))
    return str(tmp_path)


def names_of(found):
    return sorted(f"{r['folder'].rsplit('/', 1)[1]}/{r['name']}" for r in found.collect())


def test_sizes_come_before_contents(spark, copies):
    listed = duplicates.listed_files(spark, copies)
    sizes = duplicates.repeated_sizes(listed)
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1] and sizes.count() == 2
    hashed = duplicates.hashed_files(spark, copies, listed)
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [LessThanOrEqual(length" in plan and "GreaterThanOrEqual(length" in plan
    assert names_of(hashed) == ["x/a", "x/b", "x/c", "x/d", "x/e", "x/f", "x/g h%20"]
    assert names_of(duplicates.duplicate_files(spark, copies)) == ["x/b", "x/e", "x/g h%20"]


@pytest.mark.parametrize("limit", [0, 4])
def test_files_beyond_the_limit_are_hashed_in_blocks(spark, copies, limit, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 4)
    before = spark.conf.get(duplicates.LIMIT)
    spark.conf.set(duplicates.LIMIT, limit)
    try:
        assert names_of(duplicates.duplicate_files(spark, copies)) == ["x/b", "x/e", "x/g h%20"]
        assert versions.remove_duplicate_files(spark, copies) == 3
        assert names_of(duplicates.duplicate_files(spark, copies)) == []
    finally:
        spark.conf.set(duplicates.LIMIT, before)


def test_no_files_no_duplicates(spark, tmp_path):
    (tmp_path / "x").mkdir()
    assert versions.remove_duplicate_files(spark, str(tmp_path)) == 0


def test_columns_of_year_folders_go_by_name(spark, tmp_path, rows):
    for year, text in [("2019", "ID,Sex\n1,F\n"), ("2020", "Sex,ID\nM,2\n"), ("2021", "ID,Age\n3,30\n")]:
        (tmp_path / year).mkdir()
        (tmp_path / year / "From A.csv").write_text(text)
    found = tables.scan_year_folders(spark, str(tmp_path), "From*.csv")
    assert rows(found, "updated", "ID", "Sex", "Age") == [
        ("2019", "1", "F", None), ("2020", "2", "M", None), ("2021", "3", None, "30")]
    typed = tables.scan_year_folders(
        spark, str(tmp_path), "From*.csv", T.StructType.fromDDL("ID int, Sex string"))
    assert rows(typed) == [("2019", 1, "F"), ("2020", 2, "M"), ("2021", 3, None)]


def test_headers_of_many_files_take_one_job(spark, tmp_path, rows):
    for n in range(60):
        folder = tmp_path / str(2000 + n % 12)
        folder.mkdir(exist_ok=True)
        text = f"ID,Sex\n{n},F\n" if n % 3 else f'Sex,"ID"\nM,{n}\n' if n % 2 else f'"Sex",ID\nM,{n}\n'
        (folder / f"From {n}.csv").write_text(text)
    (tmp_path / "2003" / "From none.csv").write_text("")
    spark.sparkContext.setJobGroup("headers", "")
    try:
        found = tables.scan_year_folders(spark, str(tmp_path), "From*.csv", T.StructType.fromDDL("ID int, Sex string"))
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows(found, "ID") == sorted(((n,) for n in range(60)), key=repr)
    assert found.filter("Sex = 'F'").count() == 40
    assert jobs <= 10  # the first lines, and a header for each of three


def test_a_dirty_cell_is_null(spark, tmp_path, rows):
    (tmp_path / "2019").mkdir()
    (tmp_path / "2019" / "From.csv").write_text("ID,Sex\noops,F\n2,M\n")
    found = tables.scan_year_folders(spark, str(tmp_path), "From*.csv", T.StructType.fromDDL("ID int, Sex string"))
    assert rows(found) == [("2019", 2, "M"), ("2019", None, "F")]


def test_versions_only_when_content_changes(spark, frames, tmp_path):
    one, two = frames
    target = versions.VersionedTables(spark, str(tmp_path))
    first = target.write_if_changed(one, "all")
    assert first.changed and first.stored
    assert target.versions("all").count() == 1 and target.mirror_version("all") is None
    again = target.write_if_changed(one.orderBy(one.id.desc()), "all")
    assert not again.changed and target.versions("all").count() == 1
    second = target.write_if_changed(two, "all")
    assert second.changed and target.mirror_version("all") == first.version
    assert target.versions("all").count() == 2
    assert target.read("all").count() == 3 and target.read("all", first.version).count() == 2


def test_older_content_becomes_current_again(spark, frames, tmp_path):
    one, two = frames
    target = versions.VersionedTables(spark, str(tmp_path))
    first = target.write_if_changed(one, "all")
    target.write_if_changed(two, "all")
    back = target.write_if_changed(one, "all")
    assert back.changed and not back.stored and back.version == first.version
    assert target.read("all").count() == 2 and target.versions("all").count() == 2


def test_old_versions_are_pruned(spark, table, tmp_path):
    target = versions.VersionedTables(spark, str(tmp_path), keep=2)
    made = [target.write_if_changed(table("id int", *[(i,) for i in range(n)]), "all")
            for n in range(1, 5)]
    assert [m.pruned for m in made] == [[], [], [made[0].version], [made[1].version]]
    assert target.versions("all").count() == 2
    assert not (tmp_path / "all" / f"version={made[0].version}").exists()
    other = target.write_if_changed(table("id int", (1,)), "all_other")
    assert other.stored and target.versions("all").count() == 2


def test_number_of_kept_versions(monkeypatch):
    assert versions.versions_to_keep() == 5
    monkeypatch.setenv(versions.KEEP_VARIABLE, "2")
    assert versions.versions_to_keep() == 2
    monkeypatch.setenv(versions.KEEP_VARIABLE, "many")
    assert versions.versions_to_keep() == 0


def test_changed_any(spark, frames, tmp_path):
    target = versions.VersionedTables(spark, str(tmp_path))
    both = dict(zip(("a", "b"), frames))
    assert versions.changed_any(target.publish_all(both).values())
    assert not versions.changed_any(target.publish_all(both).values())
    with pytest.raises(LookupError):
        target.read("c")


def test_fingerprint_sees_rows_not_their_order(table):
    schema = "a string, b string"
    rows = [("x", None), (None, "x"), ("y", "z"), ("y", "z")]
    print_of = lambda *r: fingerprint_text(table(schema, *r))
    assert print_of(*rows) == print_of(*reversed(rows))
    assert print_of(*rows) != print_of(*rows[:3])
    assert print_of(("x", None)) != print_of((None, "x"))
    assert print_of(("y", "z"), ("y", "z"), ("x", "x")) != print_of(
        ("y", "z"), ("x", "x"), ("x", "x"))
    assert print_of().startswith("0|")


def test_reordering_has_no_fixed_number_of_partitions(spark):
    """A column with one value still gives partitions of bounded size."""
    rows = spark.range(0, 200_000, 1, 8).selectExpr("CAST(id AS STRING) AS id", "'x' AS degree")
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for size in sizes:
        spark.conf.set(size, "64k")
    try:
        seen = storage.reordered_by(rows, "degree").groupBy(F.spark_partition_id().alias("p")).agg(
            F.count("*").alias("n"), F.max("id")).collect()
    finally:
        for size in sizes:
            spark.conf.unset(size)
    assert sum(r["n"] for r in seen) == 200_000
    assert len(seen) > 3 and max(r["n"] for r in seen) < 50_000
    assert fingerprint_text(storage.reordered_by(rows, "degree")) == fingerprint_text(rows)


def test_year_folders(spark, tmp_path, rows):
    for year, name, text in [("2019", "From A.csv", "ID,Sex\n1,F\n"),
                             ("2020", "From B.csv", "ID,Sex\n2,NA\n"),
                             ("2020", "Original.csv", "ID,Sex\n3,M\n"),
                             ("uploads", "From C.csv", "ID,Sex\n4,M\n")]:
        (tmp_path / year).mkdir(exist_ok=True)
        (tmp_path / year / name).write_text(text)
    found = tables.scan_year_folders(spark, str(tmp_path), "From*.csv")
    assert rows(found, "updated", "ID", "Sex") == [("2019", "1", "F"), ("2020", "2", None)]


def test_sheets_as_text(table, rows):
    numbers = table("id int, tag string, extra string", (1, "a", "x"), (1, "a", "x"))
    texts = table("id string, tag string", ("b", "c"))
    assert rows(tables.union_sheets_as_text(numbers, texts), "id", "tag", "extra") == [
        ("1", "a", "x"), ("b", "c", None)]


def test_sheet_choices(table, rows):
    catalog = table("kind string, updated string, sheet string",
                    ("people", "2019", "Student"), ("people", "2020", "Student"),
                    ("people", "2020", "Notes"))
    assert rows(tables.sheet_choices(catalog)) == [("Student",)]
    assert rows(tables.sheet_choices(catalog.filter("sheet = 'Notes'"))) == [("None",)]
    assert rows(tables.sheet_choices(catalog.limit(0))) == [("None",)]
    assert not tables.has_required_sheet(catalog, "tags")
    assert tables.has_required_sheet(catalog.withColumnRenamed("sheet", "s").selectExpr(
        "kind", "updated", "'Tags' AS sheet"), "tags")


def test_tag_list_by_extension(spark, frames, tmp_path):
    versions.write_table(frames[0], str(tmp_path / "tags.csv"), "csv")
    versions.write_table(frames[0], str(tmp_path / "tags"))
    for name in ("tags.csv", "tags"):
        df = tables.scan_tag_list(spark, str(tmp_path / name))
        assert dict(df.dtypes) == {"id": "string", "value": "string"} and df.count() == 2


def test_column_checks(table):
    df = table("b int, a int, c int", (1, 2, 3))
    exact = conformance.compare_columns(df.columns, ["a", "b", "d"])
    assert not exact.ok and exact.missing == ["d"] and exact.extra == ["c"]
    assert conformance.conform(df, ["a", "b"], allow_extra=True).columns == ["a", "b"]
    assert conformance.conform(df, ["x"], ["a", "b", "c"]).columns == ["b", "a", "c"]
    with pytest.raises(conformance.ColumnMismatch, match="d"):
        conformance.conform(df, ["a", "b", "d"], allow_extra=True)
    assert conformance.tag_sheet_template(["Tag", "Curricula"]) == [
        "Tag", "Curricular", "Co-Curricular"]


def test_preview(spark):
    assert tables.preview(spark.range(500)).count() == 100


def test_published_tables_have_their_declared_types(spark, table, tmp_path, rows):
    path = str(tmp_path / "studio")
    df = table("id string, date date, purpose string, equipment string, comment string, "
               "programme string, timestamp timestamp_ntz, month string, year string",
               *[("1", None, "p", None, None, "x", None, "01/2024", "2024")] * 2)
    known = df.selectExpr("id", "DATE'2024-01-01' AS date", "purpose", "equipment", "comment",
                          "programme", "TIMESTAMP_NTZ'2024-01-01 10:00:00.25' AS timestamp",
                          "month", "year")
    versions.write_table(df.union(known), path, "csv")
    read = tables.scan_published(spark, "studio", path, "csv")
    assert [str(r["timestamp"]) for r in read.collect()] == ["2024-01-01 10:00:00.250000"]
    assert dict(read.dtypes)["year"] == "string"


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4).selectExpr("id % 7 AS year", "id % 100 AS id").distinct()
    before = shuffle_files(spark)
    kept = written(rows, "shuffled")
    versions.write_table(rows.hint("rebalance", "year"), str(tmp_path / "table"), "parquet", "year")
    versions.archive_upload(rows, str(tmp_path), "2026", "rows")
    for _ in range(50):  # files are removed in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(FREED, None) is None and kept.count() == 700


def test_rows_dealt_before_are_written_as_they_come(spark, tmp_path):
    rows = spark.range(0, 900, 1, 3).selectExpr("id % 2 + 2019 AS year", "CAST(id AS STRING) AS id")
    files, figures = {}, {}
    for dealt in ((), ("participation",)):
        tables = versions.VersionedTables(spark, str(tmp_path / str(len(dealt))))
        tables.publish_all({"participation": rows}, dealt=dealt)
        files[dealt] = len(tables.read("participation").inputFiles())
        figures[dealt] = {p: x.figures for p, x in tables.parts("participation").items()}
    assert files == {(): 2, ("participation",): 6} and len(set(map(str, figures.values()))) == 1
    assert spark.conf.get(OPEN_FILES[0]) == "0"
