"""Names and codes that the source extracts use and results must carry."""

# Faculty names as extracted -> faculty names as published.
FACULTY_NAMES = {
    "Faculty of Business & Economic": "Business & Economics",
    "Faculty of Science": "Science",
    "Faculty of Arts": "Arts",
    "Faculty of Law": "Law",
    "Faculty of Education": "Education & Social Work",
    "Faculty of Engineering": "Engineering",
    "Faculty Creative Arts & Indust": "Creative Arts & Industries",
    "Faculty of Medical & Hlth Sci": "Medical & Health Sciences",
    "Medical & Health Sciences": "Medical & Health Sciences",
    "Science": "Science",
    "Business & Economics": "Business & Economics",
    "Engineering": "Engineering",
    "Creative Arts & Industries": "Creative Arts & Industries",
    "Arts": "Arts",
    "Law": "Law",
    "The University of Auckland": "The University of Auckland",
    "Education & Social Work": "Education & Social Work",
    "Auck Bioengineering Institute": "Auck Bioengineering Institute",
    "Bioengineering Institute": "Bioengineering Institute",
    "New Start": "New Start",
    "Centre for Cont Education": "Centre for Cont Education",
    "Theology": "Theology",
}

# Faculties merged from a given year on.
MERGED_FACULTIES_FROM = 2025
MERGED_FACULTIES = {
    "Arts": "Arts and Education",
    "Education & Social Work": "Arts and Education",
    "Engineering": "Engineering and Design",
    "Creative Arts & Industries": "Engineering and Design",
}

# Codes in the people extracts.
SEX_NAMES = {"F": "Female", "M": "Male", "D": "Diverse"}
KNOWN_RESIDENCIES = ["International", "New Zealand Citizen", "NZ Permanent Resident"]
OTHER_RESIDENCY = "International"
LOCAL_CITIZENSHIP = "NZL"
FINISHED_STATUS = "Completed Programme"
ALUMNI = "ALUMNI"
EXTERNAL = "EXTERNAL"
STAFF = "STAFF"
NOT_STUDENT_FACULTIES = [ALUMNI, STAFF, EXTERNAL]

# Sheets an upload may pick from, for the kinds that hold several sheets.
PICKABLE_SHEETS = [
    "3D Printer",
    "Laser Cutter",
    "3D Scanner",
    "Vinyl Cutter",
    "CNC Router",
    "Sewing Machine",
    "Soldering and Desoldering Stati",
    "Hand and Power Tools",
    "Student",
    "Applicant",
    "No Affil",
    "No citizenship",
]
NO_SHEET = "None"
# The sheet each kind of workbook must hold.
REQUIRED_SHEETS = {"tags": "Tags", "contacts": "contacts", "sign_in": "Form Responses 1"}

# Programme texts given to sign-ins of the two spaces.
MAKER_SPACE_PROGRAMME = "Create and Maker Space Studio Participant"
HUB_PROGRAMME = "Innovation Hub Studio Participant"
HUB_WORD = "Innovation"

# Origins and offsets of the two date serials.
TAG_SERIAL_ORIGIN, TAG_SERIAL_SHIFT = "1904-01-01", 5
TRAINING_SERIAL_ORIGIN, TRAINING_SERIAL_SHIFT = "1900-01-01", -2

EDGE_LIMIT = 100
PREVIEW_ROWS = 100
VERSIONS_KEPT = 5
