"""One test per rule on nulls, text NA, rounding, splitting and row order."""

from pyspark.sql import functions as F

from turnout.functions import cleaning
from turnout.functions.nulls import is_known, not_containing, not_in, not_matching, paste
from turnout.operators import counts, filters, joins
from turnout.plans import etl
from turnout.sources.tables import read_csv


def test_not_in_keeps_nulls(table, rows):
    df = table("x string", ("a",), ("b",), (None,))
    assert rows(df.filter(not_in("x", ["a"]))) == [("b",), (None,)]
    assert rows(filters.exclude_values(df, "x", ["a"])) == [("b",), (None,)]


def test_pattern_negations_keep_nulls(table, rows):
    df = table("x string", ("2019 a",), ("b",), (None,))
    assert rows(df.filter(not_matching("x", r"^\d{4}"))) == [("b",), (None,)]
    assert rows(df.filter(not_containing("x", "b"))) == [("2019 a",), (None,)]


def test_known_drops_null_and_text_na(table, rows):
    df = table("x string", ("a",), ("NA",), (None,))
    assert rows(df.filter(is_known("x"))) == [("a",)]


def test_null_in_group_drops_the_group(table, rows):
    df = table("updated string, id string, admit_term string",
               ("2019", "1", "1190"), ("2019", "1", "1193"), ("2019", "1", "1193"),
               ("2019", "2", "NA"), ("2019", "2", "1193"), ("2018", "2", "1180"),
               ("2019", None, "1"), ("2019", None, "2"))
    assert rows(etl.latest_admit_term(df)) == [
        ("2018", "2", "1180"), ("2019", "1", "1193"), ("2019", None, "2")]


def test_null_ids_match_each_other(table, rows):
    pairs = table("id string, year int, programme string", (None, 2019, "p"), ("1", 2019, "p"))
    facts = table("updated string, id string, sex string", ("2019", None, "F"))
    assert rows(joins.attach_people(pairs, facts)) == [
        ("1", 2019, "p", None, None), (None, 2019, "p", "2019", "F")]


def test_csv_empty_and_na_are_null(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('x,y\n"",1\nNA,2\nz,\n')
    assert rows(read_csv(spark, str(tmp_path / "a.csv"))) == [
        ("z", None), (None, "1"), (None, "2")]


def test_paste_writes_na(table, rows):
    df = table("a string, b int", ("x", 1), (None, 2), ("y", None))
    assert rows(df.select(paste("a", "b"))) == [("NA 2",), ("x 1",), ("y NA",)]


def test_rounding_half_up_or_half_even(table):
    df = table("part long, whole long", (9, 400))
    r = df.select(cleaning.share_percent("part", "whole").alias("up"),
                  cleaning.share_percent("part", "whole", half_even=True).alias("even")).first()
    assert (r["up"], r["even"]) == (2.3, 2.2)


def test_explode_tags_and_year_prefix(table, rows):
    df = table("id string, tags string", ("1", "2019 A,2020 B,Newsletter,"), ("2", None))
    tagged = cleaning.explode_tags(df)
    kept = filters.keep_year_labelled(tagged, "programme")
    assert rows(kept) == [("1", "2019 A"), ("1", "2020 B")]
    split = cleaning.split_year_prefix(kept)
    assert rows(split, "year", "programme") == [(2019, "A"), (2020, "B")]


def test_multi_answers_keep_missing_ones(table, rows):
    df = table("id string, purpose string, equipment string",
               ("1", "a, b", "x, y"), ("2", None, "z"))
    split = cleaning.split_multi_answer(df, "purpose", "equipment")
    assert rows(split, "id", "purpose", "equipment") == [
        ("1", "a", "x"), ("1", "a", "y"), ("1", "b", "x"), ("1", "b", "y"), ("2", None, "z")]


def test_first_row_by_keys(table, rows):
    df = table("updated string, id string, birthdate string, sex string",
               ("2019", "1", "b", "F"), ("2019", "1", "a", "F"), ("2019", "1", "c", "M"))
    first = etl.first_by_keys(df, ignored="birthdate", order=["updated"])
    assert rows(first, "id", "birthdate", "sex") == [("1", "a", "F"), ("1", "c", "M")]


def test_serial_dates(table):
    df = table("x string", ("41000",), ("text",), ("NaN",), ("99999999999999",), (None,))
    tag = [r[0] for r in df.select(cleaning.tag_serial_date("x")).collect()]
    trained = [r[0] for r in df.select(cleaning.training_serial_date("x")).collect()]
    assert [str(d) for d in tag] == ["2016-04-07", "None", "None", "None", "None"]
    assert [str(d) for d in trained] == ["2012-04-01", "None", "None", "None", "None"]


def test_default_date(table):
    df = table("date date, year int", (None, 2019))
    assert str(cleaning.default_date(df).first()["date"]) == "2019-01-01"


def test_residency_rules(table, rows):
    known = table("residency string", ("NZ Permanent Resident",), ("Other",), (None,))
    assert rows(cleaning.normalise_residency(known)) == [
        ("International",), ("International",), ("NZ Permanent Resident",)]
    passport = table("residency string", ("NZL",), ("AUS",), (None,))
    assert rows(cleaning.residency_from_citizenship(passport)) == [
        ("International",), ("NZL",), (None,)]


def test_faculty_names(table, rows):
    df = table("faculty string, year int", ("Faculty of Arts", 2024), ("Arts", 2025),
               ("Science", 2025), ("Unlisted", 2025), (None, 2025))
    renamed = cleaning.rename_faculty(df)
    assert rows(renamed, "faculty") == [("Arts",), ("Arts",), ("Science",), (None,), (None,)]
    assert rows(cleaning.merge_faculties(renamed), "faculty") == [
        ("Arts and Education",), ("Arts",), ("Science",), (None,), (None,)]
    other = table("year int", (2025,))
    assert cleaning.merge_faculties(other) is other


def test_external_rows_are_filled(table, rows):
    df = table("id string, updated string, year int, programme string, sex string",
               ("EXTERNAL", None, 2019, "p", None), ("1", None, 2019, "p", None))
    assert rows(cleaning.fill_external(df)) == [
        ("1", None, 2019, "p", None), ("EXTERNAL", None, 2019, "p", "EXTERNAL")]


def test_alumni_and_missing_columns(table, rows):
    df = table("status string, level string, degree string, faculty string",
               ("Completed Programme", "a", "b", "c"), (None, "a", "b", "c"))
    assert rows(cleaning.mark_alumni(df), "level", "degree", "faculty") == [
        ("ALUMNI", "ALUMNI", "ALUMNI"), ("a", "b", "c")]
    short = df.select("status")
    assert cleaning.mark_alumni(short) is short
    filled = cleaning.fill_missing_columns(short, ["status", "level"], "STAFF")
    assert filled.columns == ["status", "level"]


def test_unknown_values_leave_before_the_share(table, rows):
    df = table("id string, year int, programme string, iwi string",
               ("1", 2019, "p", "a"), ("2", 2019, "p", "NA"), ("3", 2019, "p", None),
               ("4", 2019, "p", "b"))
    split = counts.split_by_attribute(df, "iwi", share=True, known_only=True)
    assert rows(split, "iwi", "count", "pct") == [("a", 1, 50.0), ("b", 1, 50.0)]


def test_percent_text_drops_trailing_zero(table):
    df = table("part long, whole long", (1, 4), (1, 3))
    assert [r[0] for r in df.select(cleaning.percent_label("part", "whole")).collect()] == [
        "1 (25%)", "1 (33.3%)"]


def test_lookup_takes_first_match(table, rows):
    df = table("k string", ("a",), ("b",), (None,))
    lookup = table("old string, new string", ("a", "z"), ("a", "y"))
    assert rows(joins.lookup_first_match(df, "k", lookup, "old", "new", "n"), "k", "n") == [
        ("a", "y"), ("b", None), (None, None)]


def test_external_rows_stay_repeated(table, rows):
    df = table("programme string, id string", ("p", "EXTERNAL"), ("p", "EXTERNAL"), ("p", "1"),
               ("p", "1"), ("p", None), ("p", None))
    assert rows(filters.split_external(df), "id") == [
        ("1",), ("EXTERNAL",), ("EXTERNAL",), (None,)]


def test_replace_tags_needs_a_dashboard_tag(table, rows):
    selection = table("tags string, final_tags string, dashboards string",
                      ("2019 A", "2019 A", "Y"), ("2019 B", "2019 A", "Y"),
                      ("2019 C", None, "Y"), ("2019 D", "2019 A", "N"))
    df = table("programme string, id string", ("2019 A", "1"), ("2019 B", "2"), ("2019 C", "3"),
               ("2019 D", "4"), (None, "5"))
    assert rows(joins.replace_tags(df, selection)) == [
        ("2019 A", "1"), ("2019 A", "2"), ("2019 C", "3")]


def test_hash_and_salt_follow_the_id(table):
    df = table("id string", ("a",), ("a",), ("b",))
    r = df.select(cleaning.hash_id("id").alias("h"), cleaning.salt_per_id("id", "s").alias("s"),
                  cleaning.salt_per_id("id", "t").alias("t")).collect()
    assert r[0] == r[1] and r[0]["h"] != r[2]["h"] and r[0]["s"] != r[2]["s"]
    assert len(r[0]["s"]) == 20 and r[0]["s"] != r[0]["t"]


def test_columns_with_dots_are_renamed(table):
    df = table("`Owner.of.Major.Spec.Module` string, ID string, Other string", ("a", "1", "x"))
    from turnout.schemas import PEOPLE_COLUMNS

    renamed = filters.renamed(df, PEOPLE_COLUMNS)
    assert sorted(renamed.columns) == ["faculty", "id"]
    assert renamed.select(F.col("faculty")).first()[0] == "a"
