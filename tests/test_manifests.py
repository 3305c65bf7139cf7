"""Versions as manifests of parts: what is written, referred to, pruned and logged."""

import pytest

from turnout.functions.fingerprint import Figures, fingerprint_text, part_figures
from turnout.sinks import versions
from turnout.sinks.versions import _part_of

YEARS = "id string, year string"


def files(root, run):
    return sorted(str(p.parent.name) for p in (root / "studio" / f"version={run}").rglob("*.parquet"))


def test_only_changed_years_are_written(spark, table, rows, tmp_path):
    target = versions.VersionedTables(spark, str(tmp_path))
    one = [("1", "2019"), ("2", "2020"), ("3", "2021"), ("4", None), ("5", "")]
    first = target.write_if_changed(table(YEARS, *one), "studio")
    assert files(tmp_path, first.version) == ["year=2019", "year=2020", "year=2021", f"year={versions.NO_VALUE}"]
    again = target.write_if_changed(table(YEARS, *one[::-1]), "studio")
    assert not again.changed and len(list((tmp_path / "studio").iterdir())) == 1
    two = [("1", "2019"), ("2b", "2020"), ("4", None), ("5", None)]  # a year changes, one goes
    second = target.write_if_changed(table(YEARS, *two), "studio")
    assert second.changed and files(tmp_path, second.version) == ["year=2020"]
    assert rows(target.read("studio")) == sorted(two, key=repr)
    assert rows(target.read("studio", first.version)) == sorted([*one[:4], ("5", None)], key=repr)
    back = target.write_if_changed(table(YEARS, *one), "studio")
    assert back.changed and not back.stored and back.version == first.version
    third = target.write_if_changed(table(YEARS, *one[:2], ("2b", "2021")), "studio")
    assert third.stored and files(tmp_path, third.version) == ["year=2021"]
    plan = target.read("studio").filter("year = '2020'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert fingerprint_text(target.read("studio")) == target.versions("studio").filter(
        f"version = '{third.version}'").first()["fingerprint"]


def test_parts_by_themselves(spark, table, rows, tmp_path):
    target = versions.VersionedTables(spark, str(tmp_path))
    target.write_if_changed(table(YEARS, ("1", "2019"), ("2", "2020"), ("3", "2021")), "studio")
    run = target.publish_all({"studio": table(YEARS, ("2b", "2020"))}, {"studio": ["2020", "2021"]})["studio"]
    assert rows(target.read("studio")) == [("1", "2019"), ("2b", "2020")]
    assert files(tmp_path, run.version) == ["year=2020"]
    with pytest.raises(ValueError, match="same columns"):
        target.publish_all({"studio": table("id int, year string", (2, "2020"))}, {"studio": ["2020"]})
    other = target.write_if_changed(table("id int, year string", (2, "2020")), "studio")
    assert other.stored and dict(target.read("studio").dtypes)["id"] in ("int", "string")


def test_pruning_spares_what_is_referred_to(spark, table, rows, tmp_path):
    target = versions.VersionedTables(spark, str(tmp_path), keep=2)
    made = [target.write_if_changed(table(YEARS, ("1", "2019"), *[(str(i), "2020") for i in range(n)]), "studio")
            for n in range(1, 6)]
    assert [m.pruned for m in made] == [[], [], *[[m.version] for m in made[:3]]]
    kept = {str(p.relative_to(tmp_path / "studio")) for p in (tmp_path / "studio").glob("version=*/year=*")}
    assert kept == {f"version={made[0].version}/year=2019", f"version={made[3].version}/year=2020",
                    f"version={made[4].version}/year=2020"}
    assert target.read("studio").count() == 6 and target.read("studio", made[3].version).count() == 5
    for n in range(2):  # the last that refers to the first run goes, and so does its folder
        target.write_if_changed(table(YEARS, (f"x{n}", "2019")), "studio")
    target.write_if_changed(table(YEARS, ("y", "2019")), "studio")
    assert not (tmp_path / "studio" / f"version={made[0].version}").exists()
    assert rows(target.read("studio")) == [("y", "2019")]


def test_empty_tables(spark, table, tmp_path):
    target = versions.VersionedTables(spark, str(tmp_path))
    for name in ("studio", "other"):
        target.write_if_changed(table(YEARS), name)
        assert target.read(name).count() == 0 and target.read(name).columns == ["id", "year"]
        assert not target.write_if_changed(table(YEARS), name).changed
        target.write_if_changed(table(YEARS, ("1", "2019")), name)
        assert target.read(name).count() == 1
        assert target.write_if_changed(table(YEARS), name).changed and target.read(name).count() == 0


def test_the_log_stays_small(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "COMPACT_FROM", 4)
    target = versions.VersionedTables(spark, str(tmp_path), keep=2)
    sizes = []
    for n in range(14):
        target.write_if_changed(table(YEARS, (str(n), "2019")), "studio")
        sizes.append(target.log().count())
    assert max(sizes) <= 16 and target.versions("studio").count() == 2
    assert target.mirror_version("studio") is not None and target.read("studio").first()["id"] == "13"


def test_figures_of_parts_add_up(spark, table):
    df = table(YEARS, ("1", "2019"), ("2", "2020"), ("2", "2020"), (None, None))
    parts = part_figures(df, _part_of("year"))
    assert set(parts) == {"2019", "2020", versions.NO_VALUE}
    assert sum(parts.values(), Figures()).text(df.schema) == fingerprint_text(df)
