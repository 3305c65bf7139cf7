"""Publishing after single uploads equals the full build, from the changed sheets alone."""

import shutil

import pytest
from test_landing import STUDENT, TAGS, frame, student

from turnout.plans import etl, incremental, landing
from turnout.plans.incremental import IncrementalBuild
from turnout.sinks.versions import VersionedTables

CONTACTS = ["ID", "UoA ID", "Tags"]
MAKER = ["Timestamp", "Student ID", "What are you using the space for today?",
         "What equipment are you planning on using?", "Any comments, queries or improvements?"]
HUB = ["Timestamp", "What is your ID number (i.e. the 7-9 digit number)", "What are you here for today:"]
TRAINING = ["Date.Stamp...do.not.copy.into.here", "ID", "Tag", "Tag.1", "Tag.2"]
APPLICANT = ["ID", "Sex", "Age", "Residency.Status", "Ethnic.Group", "Ethnicity", "Iwi", "Descr", "NSN", "Descr.1"]
SPACE = "Create and Maker Space Studio Participant"


def tags(*names):
    return [(n, n if n != "2019 Old" else "2019 Course", "Y", *"YYYYYYYY", None, None) for n in names]


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))

    def upload(kind, sheet, year, columns, *rows):
        return landing.accept_upload(frame(spark, columns, *rows), root, kind, sheet, year)

    upload("people", "Student", "2019", STUDENT, student("10", "1193"), student("20", "1193", "M"), student("30", "1193"))
    upload("people", "Student", "2020", STUDENT, student("20", "1203", "M"), student("40", "1203"))
    upload("contacts", "contacts", "2019", CONTACTS, ("a", "10", "2019 Course,2019 Old"), ("b", "20", "2019 Course"),
           ("c", "EXTERNAL", "2019 Course"), ("d", "30", "2019 Other"))
    upload("contacts", "contacts", "2020", CONTACTS, ("a", "20", "2020 Course"), ("b", "40", "2020 Course"),
           ("c", "10", "2021 Course"), ("d", "50", "2020 Course,2019 Course"))
    upload("tags", "Tags", "2020", TAGS, *tags("2019 Course", "2019 Old", "2019 Other", "2020 Course", "2021 Course",
                                               f"2019 {SPACE}", f"2020 {SPACE}"))
    upload("maker_sign_ins", "Form Responses 1", "2019", MAKER, ("2019-05-01 10:00:00", "10", "Work, Study", "Saw, Drill", None),
           ("2020-05-01 10:00:00", "60", "Work", "Saw", None), ("no time", "70", "Work", "Saw", None), ("2019-06-01 08:00:00", None, "x", "y", None))
    upload("hub_sign_ins", "Form Responses 1", "2019", HUB, ("2019-05-02 09:00:00", "10", "Meet, talk"))
    upload("training", "3D Printer", "2019", TRAINING, ("43587", "10", "2019 x", "3D Printer", None),
           ("oops", "80", "2019 x", "Laser", None))
    return root, upload


def contents(tables, names=("participation", "studio", "training", "tag_selection")):
    return {n: sorted((tuple(r[c] for c in sorted(r.asDict())) for r in tables.read(n).collect()), key=repr) for n in names}


def full(spark, root, tmp_path_factory):
    target = VersionedTables(spark, str(tmp_path_factory.mktemp("full")))
    etl.publish(landing.load_landed(spark, root), target)
    return contents(target)


def hidden(root, kept):
    """Landed sheets that no changed unit needs are moved out of reach for a while."""
    import pathlib

    moved = []
    for path in pathlib.Path(root, "landed").glob("*/*/*"):
        if path.is_dir() and path.parent.parent.name != "_log" and str(path) != kept:
            moved.append((path, path.with_name("hidden " + path.name)))
            shutil.move(*moved[-1])
    return moved


def test_uploads_one_by_one(spark, lake, tmp_path_factory):
    root, upload = lake
    target = VersionedTables(spark, str(tmp_path_factory.mktemp("tables")), keep=0)
    build = IncrementalBuild(spark, root, target, str(tmp_path_factory.mktemp("state")), range_ids=4)
    first = build.publish()
    assert first.changed and len(first.units) == 8 and contents(target) == full(spark, root, tmp_path_factory)
    before = target.parts("participation")
    assert set(before) == {"2019", "2020", "2021", "__HIVE_DEFAULT_PARTITION__"}
    assert build.publish() == type(first)(False, {}, [], [])

    steps = [
        # a new year of people: ids 40 and 50 have pairs in 2019 and 2020, 90 in none
        (("people", "Student", "2021", STUDENT, student("40", "1213"), student("50", "1213"), student("90", "1213")), ["2019", "2020"]),
        # a year of people anew, with other people in it; 30 has none now
        (("people", "Student", "2019", STUDENT, student("10", "1193", "D"), student("20", "1193", "M")), ["2019", "2020", "2021"]),
        (("people", "Applicant", "2022", APPLICANT, ("50", "F", "30", "Other", "e", "f", "Y", "Some iwi", "n", "BA")), ["2019", "2020"]),
        # contacts of known ids: no number shifts
        (("contacts", "contacts", "2021", CONTACTS, ("x", "40", "2021 Course"), ("y", "40", "2020 Course")), ["2020", "2021"]),
        # an id that sorts among the others, and one that goes
        (("contacts", "contacts", "2021", CONTACTS, ("x", "35", "2021 Course")), None),
        (("hub_sign_ins", "Form Responses 1", "2020", HUB, ("2020-02-02 09:00:00", "10", "Meet"), ("2021-02-02 09:00:00", "20", "Meet")), ["2019", "2020", "2021"]),
        (("training", "3D Printer", "2020", TRAINING, ("43588", "10", "2020 x", "Laser", None), ("none", "80", "2019 x", "Laser", None)), ["2019", "2021", "__HIVE_DEFAULT_PARTITION__"]),
    ]
    for arguments, years in steps:
        path = upload(*arguments)
        expected = full(spark, root, tmp_path_factory)
        before = {n: target.parts(n) for n in ("participation", "studio")}
        moved = hidden(root, path) if arguments[0] != "training" else []
        try:
            outcome = build.publish()
        finally:
            for old, new in moved:
                shutil.move(new, old)
        assert outcome.units == [(arguments[0], "" if arguments[0] == "training" else arguments[2])]
        assert (outcome.years is None) == (years is None), arguments
        if years is not None:
            assert set(outcome.years) == set(years), arguments
        assert contents(target) == expected, arguments
        for name, parts in before.items():
            now = target.parts(name)
            for part, p in parts.items():
                if part in now and now[part].figures == p.figures:
                    assert now[part].folder == p.folder


def test_a_tag_list_makes_all_anew(spark, lake, tmp_path_factory):
    root, upload = lake
    target = VersionedTables(spark, str(tmp_path_factory.mktemp("tables")))
    build = IncrementalBuild(spark, root, target, str(tmp_path_factory.mktemp("state")))
    build.publish()
    upload("tags", "Tags", "2021", TAGS, *tags("2019 Course", "2020 Course"))
    outcome = build.publish()
    assert outcome.units == [("tags", "")] and outcome.years is None
    assert contents(target) == full(spark, root, tmp_path_factory)
    # someone else published meanwhile: the state belongs to another version
    target.write_if_changed(target.read("training").limit(0), "training")
    assert build.publish().units == [] and contents(target) == full(spark, root, tmp_path_factory)


def test_a_workbook_of_people_makes_its_own_rows_anew(spark, tmp_path, tmp_path_factory, monkeypatch):
    root = str(tmp_path)

    def upload(kind, sheet, year, columns, *rows):
        landing.accept_upload(frame(spark, columns, *rows), root, kind, sheet, year)

    def people(year, *rows):
        upload("people", "Student", year, STUDENT, *rows)

    def nobody(term):
        return (None, *student("0", term)[1:])

    people("2019", student("10", "1193"), student("20", "1193"), student("EXTERNAL", "1193"), student("NA", "1193"),
           nobody("1193"))
    people("2020", student("10", "1203"), student("20", "1203"), student("30", "1203"), student("EXTERNAL", "1203", "M"),
           nobody("1203"))
    upload("contacts", "contacts", "2019", CONTACTS, *[(f"r{i}", n, "2019 Course,2020 Course") for i, n in enumerate(
        ("10", "20", "30", "40", "EXTERNAL", "NA"))])
    upload("tags", "Tags", "2020", TAGS, *tags("2019 Course", "2020 Course", f"2019 {SPACE}"))
    upload("maker_sign_ins", "Form Responses 1", "2019", MAKER, ("2019-06-01 08:00:00", None, "x", "y", None))
    upload("training", "3D Printer", "2019", TRAINING, ("oops", "30", "2019 x", "Laser", None))
    target = VersionedTables(spark, str(tmp_path / "tables"))
    build = IncrementalBuild(spark, root, target, str(tmp_path / "state"))
    build.publish()
    made, write = [], incremental.written

    def watched(df, name):
        table = write(df, name)
        if name.endswith("/participation"):
            made.append({r["updated"] for r in table.select("updated").distinct().collect()})
        return table

    monkeypatch.setattr(incremental, "written", watched)
    # other people: 10 is only in the other workbook now, 30 in none, 40 and NA are here for the first time
    people("2020", student("20", "1203", "M"), student("40", "1203"), student("EXTERNAL", "1203"), student("NA", "1203"))
    outcome = build.publish()
    assert outcome.units == [("people", "2020")] and outcome.years is not None and made == [{"2020", None}]
    other = VersionedTables(spark, str(tmp_path_factory.mktemp("full")))
    etl.publish(landing.load_landed(spark, root), other)
    assert contents(target, ["participation"]) == contents(other, ["participation"])
    assert {p: x.figures for p, x in target.parts("participation").items()} == {
        p: x.figures for p, x in other.parts("participation").items()}
