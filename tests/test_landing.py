"""From uploads with their own headers to published tables, end to end."""

import datetime as dt
import threading

import pytest

from turnout.plans import etl, landing
from turnout.sinks.versions import VersionedTables, together
from turnout.sources.conformance import ColumnMismatch

STUDENT = ["ID", "Admit.Term", "Birthdate", "Sex", "Age", "Ethnic.Group", "Ethnicity", "Iwi",
           "Descr", "NSN", "Residency.Status", "Status", "Acad.Prog", "Programme.Level",
           "Descriptio", "Plan.Description", "Owner.of.Major/Spec/Module"]
TAGS = ["Tag from list", "Final tag", "Dashboards Y / N", "Overview", "Programme", "Velocity",
        "Unleash", "CreateMaker", "Curricula", "Co-Curricular", "Journey", "Date", "Comment"]


def student(i, term, sex="F", faculty="Faculty of Science", status="Active", born="1"):
    return (i, term, born, sex, "20", "Asian", "Chinese", "N", "NA", "n" + i, "Study Permit",
            status, "AC", "UG", "BSc", "Physics", faculty)


def frame(spark, columns, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"`{c}` string" for c in columns))


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))

    def upload(kind, sheet, year, columns, *rows):
        landing.accept_upload(frame(spark, columns, *rows), root, kind, sheet, year)

    upload("people", "Student", "2019", STUDENT, student("1", "1193"), student("1", "1190"),
           student("1", "1193", born="2"), student("2", "NA"), student("2", "1193"))
    upload("people", "Student", "2020", STUDENT, student("3", "1203", "M", "Unlisted"),
           student("4", "1203", "D", status="Completed Programme"))
    upload("people", "Applicant", "2019",
           ["ID", "Sex", "Age", "Residency.Status", "Ethnic.Group", "Ethnicity", "Iwi", "Descr",
            "NSN", "Descr.1"], ("5", "F", "30", "Other", "e", "f", "Y", "Some iwi", "n", "BA"))
    upload("people", "No Affil", "2020",
           ["ID", "Sex", "NSN", "Ethnic.grp.description", "Citizenship.Passport", "Descr"],
           ("6", "M", "n", "g", "AUS", "h"))
    upload("contacts", "contacts", "2019", ["ID", "UoA ID", "Tags", "Phone"],
           ("a", "1", "2019 Course,Newsletter,2019 Old", "x"), ("b", "1", "2019 Course", "x"),
           ("c", "EXTERNAL", "2019 Course", "x"), ("d", "EXTERNAL", "2019 Course", "x"),
           ("e", "3", "2020 Course,2020 Unlisted", "x"), (None, "4", "2019 Course", "x"),
           ("g", "5", "2019 Course", "x"), ("h", "6", "2019 Course", "x"),
           ("i", "4", "2020 Course", "x"), ("j", "9", "2020 Course", "x"))
    upload("tags", "Tags", "2020", TAGS,
           ("2019 Course", "2019 Course", "Y", *"YYYYYYYY", "42000", None),
           ("2019 Old", "2019 Course", "Y", *"YYYYYYYY", "Overarching", None),
           ("2020 Course", "2020 Course", "Y", *"YYYYYYYY", "42366", None),
           ("2020 Unlisted", "2020 Unlisted", "N", *"YYYYYYYY", None, None),
           ("2019 Create and Maker Space Studio Participant",) * 2
           + ("Y", *"YYYYYYYY", None, None),
           ("No year", "No year", "Y", *"YYYYYYYY", None, None))
    upload("maker_sign_ins", "Form Responses 1", "2019",
           ["Timestamp", "Student ID", "What are you using the space for today?",
            "What equipment are you planning on using?", "Any comments, queries or improvements?"],
           ("2019-05-01 10:00:00", "1", "Work, Study", "Saw, Drill", None),
           ("2019-05-01 10:00:00", "1", "Work, Study", "Saw, Drill", None))
    upload("hub_sign_ins", "Form Responses 1", "2019",
           ["Timestamp", "What is your ID number (i.e. the 7-9 digit number)",
            "What are you here for today:"], ("2019-05-02 09:00:00", "7", "Meet, talk"))
    upload("training", "3D Printer", "2019",
           ["Date.Stamp...do.not.copy.into.here", "ID", "Tag", "Tag.1", "Tag.2"],
           ("43587", "1", "2019 x", "3D Printer", None), ("43587", "1", "2019 x", "3D Printer",
                                                          "other"),
           ("NA", "1", "2019 x", "3D Printer", None), ("43588", None, "2019 x", "y", None))
    target = VersionedTables(spark, root + "/tables")
    landed = landing.load_landed(spark, root)
    changed, results = etl.publish(landed, target)
    return root, target, landed, changed, results


def test_everything_is_new_then_nothing_is(published):
    _, target, landed, changed, results = published
    assert changed and all(r.stored for r in results.values())
    again, _ = etl.publish(landed, target)
    assert not again


def test_participation(published, rows):
    target = published[1]
    # ids in text order: 1, 3, 4, 5, 6, 7, 9, EXTERNAL
    assert rows(target.read("participation"), "id", "year", "programme", "sex", "faculty",
                "residency", "level") == [
        ("1", 2019, "Course", "Female", "Science", "International", "UG"),
        ("1", 2019, "Create and Maker Space Studio Participant", "Female", "Science",
         "International", "UG"),
        ("2", 2020, "Course", "Male", None, "International", "UG"),
        ("3", 2020, "Course", "Diverse", "ALUMNI", "International", "ALUMNI"),
        ("4", 2019, "Course", "F", "EXTERNAL", "Other", "EXTERNAL"),
        ("5", 2019, "Course", "Male", "STAFF", "International", "STAFF"),
        ("7", 2020, "Course", None, None, None, None),
        ("8", 2019, "Course", "EXTERNAL", "EXTERNAL", "EXTERNAL", "EXTERNAL"),
    ]


def test_sign_ins_and_training(published, rows):
    target = published[1]
    assert rows(target.read("studio"), "id", "purpose", "equipment", "programme", "month") == [
        ("1", p, e, "2019 Create and Maker Space Studio Participant", "05/2019")
        for p in ("Study", "Work") for e in ("Drill", "Saw")
    ] + [("6", "Meet, talk", None, "2019 Innovation Hub Studio Participant", "05/2019")]
    assert rows(target.read("training"), "id", "date", "training") == [
        ("1", dt.date(2019, 5, 2), "2019 3D Printer")]


def test_tag_selection(published, rows):
    read = published[1].read("tag_selection")
    assert rows(read, "tags", "year", "tag_programme", "date")[0] == (
        "2019 Course", 2019, "Course", dt.date(1904, 1, 1) + dt.timedelta(42005))
    assert read.count() == 4 and read.filter("date IS NULL").count() == 2


def test_absent_sheets_are_empty(published):
    assert published[2].no_citizenship.isEmpty()


def test_uploads_are_checked(spark, tmp_path):
    df = frame(spark, ["ID", "Tags"], ("1", "x"))
    with pytest.raises(ColumnMismatch, match="UoA ID"):
        landing.accept_upload(df, str(tmp_path), "contacts", "contacts", "2019",
                              ["ID", "UoA ID", "Tags"])
    with pytest.raises(ColumnMismatch, match="no sheet"):
        landing.accept_upload(df, str(tmp_path), "people", "Notes", "2019")
    with pytest.raises(ColumnMismatch, match="needs a sheet named 'Tags'"):
        landing.accept_workbook({}, str(tmp_path), "tags", "2019")
    with pytest.raises(ColumnMismatch, match="2 questions with 'ID'"):
        landing.accept_upload(frame(spark, ["Timestamp", "ID", "Your ID", "What for today"], *[("1",) * 4]),
                              str(tmp_path), "hub_sign_ins", "Form Responses 1", "2019")
    covid = ["Timestamp", "Had COVID?", "Student ID", "What are you here for today:"]
    assert landing.question_names(covid, landing.HUB_FORM)["Student ID"] == "id"
    with pytest.raises(ColumnMismatch, match="for today"):
        landing.accept_upload(frame(spark, ["Timestamp", "Student ID"], ("1", "2")),
                              str(tmp_path), "hub_sign_ins", "Form Responses 1", "2019")
    assert not list((tmp_path).glob("landed/*"))


def test_a_workbook_replaces_the_earlier_one_whole(spark, tmp_path, rows):
    root = str(tmp_path)
    no_affil = ["ID", "Sex", "NSN", "Ethnic.grp.description", "Citizenship.Passport", "Descr"]
    people = {"Student": frame(spark, STUDENT, student("1", "1193")),
              "No Affil": frame(spark, no_affil, ("6", "M", "n", "g", "AUS", "h"))}
    landing.accept_workbook(people, root, "people", "2019")
    landing.accept_workbook({"Student": people["Student"]}, root, "people", "2020")
    assert rows(landing.read_landed(spark, root, "people", "Student"), "updated") == [("2019",), ("2020",)]
    landing.accept_workbook({"Student": frame(spark, STUDENT, student("2", "1193"))}, root, "people", "2019")
    assert rows(landing.read_landed(spark, root, "people", "Student"), "updated", "id") == [
        ("2019", "2"), ("2020", "1")]
    assert landing.read_landed(spark, root, "people", "No Affil").isEmpty()
    landing.accept_upload(frame(spark, TAGS[:9] + TAGS[10:], *[("2019 A",) * 12]), root, "tags", "Tags", "2019")
    landing.accept_upload(frame(spark, TAGS, *[("2019 B",) * 13]), root, "tags", "Tags", "2018")
    assert rows(landing.read_landed(spark, root, "tags", "Tags"), "tags") == [("2019 B",)]


def test_sheets_are_written_side_by_side(spark, tmp_path, rows, monkeypatch):
    """They used to be written one after the other."""
    met, archive = threading.Barrier(2, timeout=60), landing.archive_upload

    def waiting(*args):
        met.wait()
        return archive(*args)

    monkeypatch.setattr(landing, "archive_upload", waiting)
    sheet = ["Date.Stamp...do.not.copy.into.here", "ID", "Tag", "Tag.1", "Tag.2"]
    first, second = landing.EQUIPMENT_SHEETS[:2]
    landing.accept_workbook({first: frame(spark, sheet, ("1", "a", "2019 x", "t", None)),
                             second: frame(spark, sheet, ("1", "b", "2019 x", "t", None))},
                            str(tmp_path), "training", "2019")
    for name, i in ((first, "a"), (second, "b")):
        assert rows(landing.read_landed(spark, str(tmp_path), "training", name), "id") == [(i,)]
    assert len(list(tmp_path.glob("uploads/2019/training-*/*/_SUCCESS"))) == 2


def test_workbooks_of_several_years_land_side_by_side(spark, tmp_path, rows):
    root, years = str(tmp_path), [str(y) for y in range(2010, 2018)]
    together(*[lambda y=y: landing.accept_workbook(
        {"Student": frame(spark, STUDENT, student(y, "1193"))}, root, "people", y) for y in years])
    assert rows(landing.read_landed(spark, root, "people", "Student"), "updated", "id") == [(y, y) for y in years]
