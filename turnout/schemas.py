"""Schemas of the published tables and the names their columns get at ingest."""

from pyspark.sql import types as T


def _schema(**columns):
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _I, _D, _TS = T.StringType(), T.IntegerType(), T.DateType(), T.TimestampNTZType()

PARTICIPATION = _schema(
    id=_S, programme=_S, year=_I, updated=_S, sex=_S, age=_S, ethnic_group=_S, ethnicity=_S,
    iwi_flag=_S, iwi=_S, residency=_S, level=_S, degree=_S, faculty=_S, department=_S,
    status=_S, admit_term=_S, acad_prog=_S, month=_S,
)
STUDIO = _schema(
    id=_S, date=_D, purpose=_S, equipment=_S, comment=_S, programme=_S, timestamp=_TS,
    month=_S, year=_S,
)
TRAINING = _schema(id=_S, date=_D, training=_S)
TAG_SELECTION = _schema(
    tags=_S, final_tags=_S, dashboards=_S, overview=_S, programme=_S, velocity=_S, unleash=_S,
    createmaker=_S, curricula=_S, co_curricula=_S, journey=_S, date=_D, comment=_S, year=_I,
    tag_programme=_S,
)
PUBLISHED = {
    "participation": PARTICIPATION,
    "studio": STUDIO,
    "training": TRAINING,
    "tag_selection": TAG_SELECTION,
}

# Column names of the extracts -> names used here.
PEOPLE_COLUMNS = {
    "ID": "id",
    "Admit.Term": "admit_term",
    "Birthdate": "birthdate",
    "Sex": "sex",
    "Age": "age",
    "Ethnic.Group": "ethnic_group",
    "Ethnicity": "ethnicity",
    "Iwi": "iwi_flag",
    "Descr": "iwi",
    "NSN": "nsn",
    "Residency.Status": "residency",
    "Status": "status",
    "Acad.Prog": "acad_prog",
    "Programme.Level": "level",
    "Descriptio": "degree",
    "Plan.Description": "department",
    "Owner.of.Major.Spec.Module": "faculty",
    "Owner.of.Major/Spec/Module": "faculty",
    "Display.Name": "display_name",
}
APPLICANT_COLUMNS = {**PEOPLE_COLUMNS, "Descr.1": "degree"}
NO_AFFILIATION_COLUMNS = {
    "ID": "id",
    "Sex": "sex",
    "NSN": "nsn",
    "Ethnic.grp.description": "ethnicity",
    "Citizenship.Passport": "residency",
    "Descr": "ethnic_group",
}
CONTACT_COLUMNS = {"ID": "row_id", "UoA ID": "id", "Tags": "tags"}
TRAINING_COLUMNS = {
    "Date.Stamp...do.not.copy.into.here": "date",
    "ID": "id",
    "Tag": "tag",
    "Tag.1": "tag_1",
    "Tag.2": "tag_2",
}

STUDENT_SHEET = [
    "id", "admit_term", "birthdate", "sex", "age", "ethnic_group", "ethnicity", "iwi_flag",
    "iwi", "nsn", "residency", "status", "acad_prog", "level", "degree", "department", "faculty",
]
APPLICANT_SHEET = [
    "id", "sex", "age", "residency", "ethnic_group", "ethnicity", "iwi_flag", "iwi", "nsn",
    "degree",
]
NO_AFFILIATION_SHEET = ["id", "sex", "nsn", "ethnicity", "residency", "ethnic_group"]

# Filter labels, in the order the filters are tried, and their columns.
FILTER_COLUMNS = {
    "Gender": "sex",
    "Ethnic Group": "ethnic_group",
    "Ethnicity": "ethnicity",
    "Iwi": "iwi",
    "Faculty": "faculty",
    "Department": "department",
    "Affiliation": "level",
    "Residency": "residency",
    "Year": "year",
}
