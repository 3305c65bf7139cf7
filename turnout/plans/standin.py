"""Stand-in tables: published tables and landed extracts, derived from the provided tables.

The texts run in Spark SQL and, with plain table names, in the engine that checks results.
Few functions differ in name; those are the entries of ``DIALECTS``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout import schemas
from turnout.plans import etl, landing
from turnout.plans.dashboards import Dashboards, published
from turnout.session import own_path
from turnout.sinks.versions import VersionedTables, together, write_table
from turnout.sources.tables import scan_published, workbooks_with_sheet

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents")
DIALECTS = {
    "spark": {
        "days": "datediff({0}, DATE '{1}')",
        "texts": "array_join(array_sort(collect_set({0})), ',')",
    },
    "duckdb": {
        "days": "date_diff('day', DATE '{1}', {0})",
        "texts": "string_agg(DISTINCT {0}, ',' ORDER BY {0})",
    },
}

PARTICIPATION = """
SELECT CAST(o.o_custkey AS STRING) AS id, CAST(year(o.o_orderdate) AS INT) AS year,
       p.p_type AS programme, c.c_mktsegment AS faculty, n.n_name AS department,
       n.n_name AS ethnic_group, r.r_name AS ethnicity, l.l_returnflag AS residency,
       o.o_orderpriority AS level, p.p_brand AS degree, nullif(o.o_orderstatus,'P') AS sex,
       CASE WHEN p.p_size % 3 = 0 THEN 'NA'
            ELSE concat('G', CAST(p.p_size % 5 AS STRING)) END AS iwi
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey=o.o_orderkey
JOIN {customer} c ON o.o_custkey=c.c_custkey JOIN {nation} n ON c.c_nationkey=n.n_nationkey
JOIN {region} r ON n.n_regionkey=r.r_regionkey JOIN {part} p ON l.l_partkey=p.p_partkey
"""

YEAR_PROGRAMMES = """
SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y, p_type AS prog
FROM {orders} JOIN {lineitem} ON l_orderkey=o_orderkey JOIN {part} ON l_partkey=p_partkey
"""

TAG_SELECTION = """
SELECT concat(CAST(y AS STRING),' ',prog) AS tags,
       concat(CAST(y AS STRING),' ',CASE WHEN prog='PROMO' THEN 'STANDARD' ELSE prog END)
         AS final_tags,
       'Y' AS dashboards, CASE WHEN prog<>'PROMO' THEN 'Y' END AS overview,
       CASE WHEN prog IN ('ECONOMY','LARGE','MEDIUM') THEN 'Y' END AS programme,
       CASE WHEN prog IN ('SMALL','STANDARD') THEN 'Y' END AS velocity,
       CASE WHEN prog IN ('LARGE','SMALL','ECONOMY') THEN 'Y' END AS unleash,
       CASE WHEN prog IN ('MEDIUM','STANDARD') THEN 'Y' END AS createmaker,
       CASE WHEN prog IN ('ECONOMY','LARGE') THEN 'Y' END AS curricula,
       CASE WHEN prog IN ('LARGE','MEDIUM','SMALL','STANDARD') THEN 'Y' END AS co_curricula,
       'Y' AS journey, make_date(y, k, 1) AS date, y AS year, prog AS tag_programme
FROM (SELECT y, prog, CAST(2*dense_rank() OVER (PARTITION BY y ORDER BY prog)-1 AS INT) AS k
      FROM ({year_programmes}) a) b
"""

STUDIO = """
SELECT CAST(user_id AS STRING) AS id, CAST(ts AS DATE) AS date, event_type AS purpose,
       props AS equipment, ts AS timestamp,
       CASE WHEN user_id % 2 = 0 THEN '2024 Innovation Hub Studio Participant'
            ELSE '2024 Create and Maker Space Studio Participant' END AS programme,
       CAST(year(ts) AS STRING) AS year,
       concat(lpad(CAST(month(ts) AS STRING),2,'0'),'/',CAST(year(ts) AS STRING)) AS month
FROM {events}
"""

TRAINING = """
SELECT DISTINCT CAST(o_custkey AS STRING) AS id, CAST(l_shipdate AS DATE) AS date,
       concat(CAST(year(l_shipdate) AS STRING),' ',p_brand) AS training
FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey JOIN {part} ON l_partkey=p_partkey
WHERE l_returnflag='R'
"""

# One row per order; the priority says which sheet the person is on.
PEOPLE_SHEETS = """
SELECT 'people' AS kind, CAST(year(o_orderdate) AS STRING) AS updated,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Applicant' WHEN '2-HIGH' THEN 'No Affil'
            WHEN '3-MEDIUM' THEN 'No citizenship' ELSE 'Student' END AS sheet,
       CAST(c_custkey AS STRING) AS id,
       CASE WHEN o_orderkey % 61 = 0 THEN 'NA'
            ELSE concat(CAST(year(o_orderdate) AS STRING),
                        lpad(CAST(month(o_orderdate) AS STRING),2,'0')) END AS admit_term,
       CAST(10000 + o_orderkey % 20000 AS STRING) AS birthdate,
       CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' ELSE 'D' END AS sex,
       CAST(18 + c_custkey % 40 AS STRING) AS age, r_name AS ethnic_group, n_name AS ethnicity,
       CASE WHEN c_nationkey % 2 = 0 THEN 'Y' ELSE 'N' END AS iwi_flag,
       concat('G', CAST(c_nationkey % 5 AS STRING)) AS iwi,
       CAST(900000 + c_custkey AS STRING) AS nsn,
       CASE c_nationkey % 4 WHEN 0 THEN 'New Zealand Citizen' WHEN 1 THEN 'NZ Permanent Resident'
            WHEN 2 THEN 'Study Permit' END AS residency,
       CASE c_nationkey % 3 WHEN 0 THEN 'NZL' WHEN 1 THEN 'AUS' END AS citizenship,
       CASE o_orderstatus WHEN 'F' THEN 'Completed Programme' ELSE 'Active in Programme' END
         AS status,
       CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS acad_prog,
       o_orderpriority AS level, concat('Degree ', CAST(c_nationkey % 6 AS STRING)) AS degree,
       n_name AS department,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Faculty of Engineering'
            WHEN 'BUILDING' THEN 'Engineering' WHEN 'FURNITURE' THEN 'Faculty Creative Arts & Indust'
            WHEN 'HOUSEHOLD' THEN 'Faculty of Education' ELSE 'Unlisted Faculty' END AS faculty
FROM {orders} JOIN {customer} ON o_custkey=c_custkey JOIN {nation} ON c_nationkey=n_nationkey
JOIN {region} ON n_regionkey=r_regionkey
"""

# One contact per customer and order status; lines numbered 1 carry a tag without a year.
CONTACTS = """
SELECT o_orderstatus AS export,
       CASE WHEN o_custkey % 23 <> 0 THEN concat(CAST(o_custkey AS STRING),'-',o_orderstatus) END
         AS row_id,
       CASE WHEN o_custkey % 20 = 0 THEN 'EXTERNAL' ELSE CAST(o_custkey AS STRING) END AS id,
       {texts} AS tags
FROM (SELECT o_custkey, o_orderstatus,
             CASE WHEN l_linenumber = 1 THEN p_brand
                  ELSE concat(CAST(year(o_orderdate) AS STRING),' ',p_type) END AS tag
      FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey JOIN {part} ON l_partkey=p_partkey) t
GROUP BY o_custkey, o_orderstatus
"""

MAKER_SIGN_INS = """
SELECT ts AS timestamp, CAST(user_id AS STRING) AS id,
       concat(event_type, CASE WHEN value > 10 THEN ', meeting' ELSE ', study' END) AS purpose,
       CASE WHEN value <= 40 THEN concat('tool ', CAST(user_id % 3 AS STRING), ', tool ',
                                         CAST(3 + user_id % 4 AS STRING)) END AS equipment,
       CASE WHEN value > 50 THEN props END AS comment
FROM {events} WHERE event_type NOT IN ('click','view')
"""

HUB_SIGN_INS = """
SELECT ts AS timestamp,
       CASE WHEN user_id % 10 = 0 THEN 'EXTERNAL' ELSE CAST(user_id AS STRING) END AS id,
       concat(event_type, ', alone') AS purpose
FROM {events} WHERE event_type IN ('click','view')
"""

TAG_LIST = """
SELECT tags, final_tags, CASE WHEN tag_programme = 'SMALL' THEN 'N' ELSE 'Y' END AS dashboards,
       overview, programme, velocity, unleash, createmaker, curricula, co_curricula, journey,
       CASE WHEN tag_programme = 'MEDIUM' THEN 'Overarching Tag'
            ELSE CAST({tag_days} - 5 AS STRING) END AS date,
       CAST(NULL AS STRING) AS comment
FROM ({tag_selection}) s
UNION ALL
SELECT DISTINCT p_type, p_type, 'Y', 'Y', 'Y', 'Y', 'Y', 'Y', 'Y', 'Y', 'Y', '1', 'no year'
FROM {part}
UNION ALL
SELECT DISTINCT concat(CAST(year(ts) AS STRING), ' Innovation Hub Studio Participant'),
       concat(CAST(year(ts) AS STRING), ' Innovation Hub Studio Participant'),
       'Y', 'Y', 'Y', 'Y', 'Y', 'Y', 'Y', 'Y', 'Y', CAST({space_days} AS STRING), 'space'
FROM {events}
UNION ALL
SELECT DISTINCT concat(CAST(year(ts) AS STRING), ' Create and Maker Space Studio Participant'),
       concat(CAST(year(ts) AS STRING), ' Create and Maker Space Studio Participant'),
       'Y', 'Y', 'Y', 'Y', 'Y', 'Y', 'Y', 'Y', 'Y', CAST({space_days} AS STRING), 'space'
FROM {events}
"""

TRAINING_SHEETS = """
SELECT l_returnflag AS sheet,
       CASE WHEN l_linenumber = 7 THEN 'NA' ELSE CAST({ship_days} + 2 AS STRING) END AS date,
       CASE WHEN o_custkey % 29 <> 0 THEN CAST(o_custkey AS STRING) END AS id,
       CASE WHEN p_size = 50 THEN NULL WHEN p_size = 49 THEN ''
            ELSE concat(CAST(year(l_shipdate) AS STRING), ' ', p_type) END AS tag,
       CASE WHEN p_size = 48 THEN 'NA' ELSE p_brand END AS tag_1, l_linestatus AS tag_2
FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey JOIN {part} ON l_partkey=p_partkey
"""


class Texts:
    """The stand-in texts in one dialect, with ``{table}`` marks left in them."""

    def __init__(self, dialect: str):
        self._words = DIALECTS[dialect]

    def _days(self, date: str, origin: str) -> str:
        return self._words["days"].format(date, origin)

    def all(self) -> dict[str, str]:
        selection = TAG_SELECTION.replace("{year_programmes}", YEAR_PROGRAMMES)
        tag_list = (
            TAG_LIST.replace("{tag_selection}", selection)
            .replace("{tag_days}", self._days("date", "1904-01-01"))
            .replace("{space_days}", self._days("make_date(CAST(year(ts) AS INT), 1, 1)",
                                                "1904-01-01"))
        )
        ship = self._days("CAST(l_shipdate AS DATE)", "1900-01-01")
        return {
            "participation": PARTICIPATION,
            "tag_selection": selection,
            "studio": STUDIO,
            "training": TRAINING,
            "people_sheets": PEOPLE_SHEETS,
            "contacts": CONTACTS.replace("{texts}", self._words["texts"].format("tag")),
            "maker_sign_ins": MAKER_SIGN_INS,
            "hub_sign_ins": HUB_SIGN_INS,
            "tag_list": tag_list,
            "training_sheets": TRAINING_SHEETS.replace("{ship_days}", ship),
        }


def check_ctes() -> dict[str, str]:
    """The stand-ins as texts over the plain table names, for the checking engine."""
    plain = {name: name for name in SOURCES}
    return {name: text.format(**plain) for name, text in Texts("duckdb").all().items()}


# what this process already wrote and read, by application, folder and table
_frames: dict[tuple[str, str, str], DataFrame] = {}


class StandIn:
    """Tables of one data folder.

    Published tables and landed extracts are written once per application, in the shared
    folder, and read from there: dashboards read what the upload side published, and the
    upload side reads extracts that have landed as files.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        digest = hashlib.sha256(self.folder.encode()).hexdigest()[:12]
        self._root = own_path(spark, f"tables-{digest}")

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _frames:
            _frames[key] = make()
        return _frames[key]

    def source(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        return self._once(f"source {name}", lambda: self.spark.read.parquet(path))

    def _sql(self, text: str, **more: DataFrame) -> DataFrame:
        named = {n: self.source(n) for n in SOURCES if "{" + n + "}" in text}
        return self.spark.sql(text, **named, **more)

    def derived(self, name: str) -> DataFrame:
        """A stand-in straight from the provided tables."""
        return self._sql(Texts("spark").all()[name])

    def _write_landed(self, name: str) -> DataFrame:
        path = f"{self._root}/landed/{name}"
        rows = self.derived(name)
        keys = [c for c in ("updated", "sheet") if c in rows.columns]
        if keys:
            # a task sorts what it writes by sheet, so it gets a share that Spark bounds; workbooks of a
            # year have folders of their own, as an upload or a load of one reads no other
            write_table(rows.hint("rebalance", *keys), path, "parquet", *keys)
        else:
            write_table(rows, path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def extract(self, name: str) -> DataFrame:
        """A landed extract; those with several sheets keep each in a folder of its own."""
        return self._once(f"landed {name}", lambda: self._write_landed(name))

    def _write_published(self, name: str) -> DataFrame:
        path = f"{self._root}/{name}"
        if name == "participation":
            # sized by Spark per year: large years are split over files, small ones merged
            write_table(self.derived(name).hint("rebalance", "year"), path, "parquet", "year")
        elif name == "tag_selection":
            programmes = self.participation.select(
                F.col("year").alias("y"), F.col("programme").alias("prog")
            ).distinct()
            selection = self._sql(TAG_SELECTION, year_programmes=programmes)
            write_table(selection.coalesce(1), path)
        else:
            write_table(self.derived(name).distinct(), path)
        return scan_published(self.spark, name, path, columns=COLUMNS[name], distinct=True)

    def _table(self, name: str) -> DataFrame:
        return self._once(f"published {name}", lambda: self._write_published(name))

    def publish(self) -> None:
        """Write all published tables, unless this application already did."""
        for name in COLUMNS:
            self._table(name)

    def built(self, name: str) -> DataFrame:
        """A table of the whole build from the landed extracts, as its current version."""
        def build() -> DataFrame:
            target = VersionedTables(self.spark, f"{self._root}/built")
            etl.publish(self.landed(), target)
            for table in ("participation", "studio", "training", "tag_selection"):
                self._once(f"built {table}", lambda: target.read(table))
            return target.log()

        self._once("build", build)
        return self._once(f"built {name}", lambda: None)

    def upload_all(self) -> str:
        """Land everything the way uploads come, and return the folder.

        A workbook of people for each year, contacts, both forms, then a tag list and a training
        workbook, each followed by a replacement under another year.
        """
        self.land()
        root = f"{self._root}/uploads-{uuid.uuid4().hex}"
        people = self.people_sheets.withColumn(
            "residency", F.when(F.col("sheet") == "No Affil", F.col("citizenship")).otherwise(F.col("residency")))
        years = [r["updated"] for r in people.select("updated").distinct().orderBy("updated").collect()]

        def upload_people(year: str) -> None:
            own = people.filter(F.col("updated") == year)
            landing.accept_workbook(
                {sheet: own.filter(F.col("sheet") == sheet).select(
                    *[F.col(c).alias(h) for h, c in headers.items()])
                 for sheet, headers in UPLOAD_HEADERS.items()}, root, "people", year)

        def upload(df: DataFrame, kind: str, year: str, sheet: str, names: dict[str, str]) -> None:
            landing.accept_upload(df.select(*[F.col(c).alias(h) for h, c in names.items()]),
                                  root, kind, sheet, year)

        def upload_tags() -> None:
            tags = self.extract("tag_list")
            for year, rows in (("1994", tags), ("1995", tags.filter(~F.col("tags").endswith(" ECONOMY")))):
                upload(rows, "tags", year, "Tags", {f"Column {n}": c for n, c in enumerate(etl.TAG_SHEET)})

        def upload_training() -> None:
            training = self.extract("training_sheets")
            headers = {"Date.Stamp...do.not.copy.into.here": "date", "ID": "id", "Tag": "tag",
                       "Tag.1": "tag_1", "Tag.2": "tag_2"}
            sheets = {flag: training.filter(F.col("sheet") == flag).select(
                *[F.col(c).alias(h) for h, c in headers.items()]) for flag in ("A", "N", "R")}
            first, second = landing.EQUIPMENT_SHEETS[:2]
            landing.accept_workbook({first: sheets["A"], second: sheets["N"]}, root, "training", "1994")
            landing.accept_workbook({first: sheets["R"]}, root, "training", "1995")

        questions = {"Timestamp": "timestamp", "Student ID": "id", "What are you here for today:": "purpose"}
        # workbooks that replace each other come in their order, all others side by side
        together(
            upload_training,
            upload_tags,
            lambda: upload(self.extract("contacts"), "contacts", "1998", "contacts",
                           {"ID": "row_id", "UoA ID": "id", "Tags": "tags"}),
            lambda: upload(self.extract("hub_sign_ins"), "hub_sign_ins", "2024", "Form Responses 1", questions),
            lambda: upload(self.extract("maker_sign_ins"), "maker_sign_ins", "2024", "Form Responses 1", {
                **questions, "Which equipment will you use?": "equipment", "Any comments?": "comment"}),
            *[lambda y=year: upload_people(y) for year in years])
        return root

    def _publish_uploads(self, root: str) -> Dashboards:
        target = VersionedTables(self.spark, f"{root}/published")
        etl.publish(landing.load_landed(self.spark, root), target)
        return published(target)

    def _uploaded(self) -> tuple[str, Dashboards]:
        return self._once("uploads", lambda: (lambda root: (root, self._publish_uploads(root)))(
            self.upload_all()))

    @property
    def uploaded(self) -> Dashboards:
        """Dashboards over what the uploads were published as."""
        return self._uploaded()[1]

    @property
    def uploaded_without_flag(self) -> Dashboards:
        """The same after one more upload: the whole tag list without the co-curricula column."""
        def again() -> Dashboards:
            root, _ = self._uploaded()
            tags = self.extract("tag_list").select(*[c for c in etl.TAG_SHEET if c != "co_curricula"])
            landing.accept_upload(tags, root, "tags", "Tags", "1996")
            return self._publish_uploads(root)

        return self._once("uploads without flag", again)

    def land(self) -> None:
        """Write all landed extracts side by side, unless this application already did."""
        together(*[lambda n=name: self.extract(n) for name in EXTRACTS])

    @property
    def participation(self) -> DataFrame:
        return self._table("participation")

    @property
    def selection(self) -> DataFrame:
        return self._table("tag_selection")

    @property
    def studio(self) -> DataFrame:
        return self._table("studio")

    @property
    def training(self) -> DataFrame:
        """Training with its published column name."""
        return self._table("training").withColumnRenamed("programme", "training")

    @property
    def dashboards(self) -> Dashboards:
        return Dashboards(self.participation, self.selection, self.studio, self.training)

    @property
    def participation_tabs(self) -> Dashboards:
        """Dashboards for outputs that look at neither sign-ins nor training, which then need not
        be published first."""
        return Dashboards(self.participation, self.selection, None, None)

    def slice(self, tab: str) -> DataFrame:
        """Participation rows of one dashboard, with merged faculty names."""
        return self.participation_tabs.slice(tab)

    @property
    def people_sheets(self) -> DataFrame:
        return self.extract("people_sheets")

    def landed_people(self) -> dict[str, DataFrame]:
        """The four kinds of people sheets, by their name in ``Landed``."""
        people = self.people_sheets

        def sheet(name: str, columns) -> DataFrame:
            return workbooks_with_sheet(people, name).select("updated", *columns)

        no_affiliation = workbooks_with_sheet(people, "No Affil").withColumn(
            "residency", F.col("citizenship")
        )
        citizen = ["display_name" if c == "birthdate" else c for c in CITIZEN_SHEET]
        return {
            "students": sheet("Student", schemas.STUDENT_SHEET),
            "applicants": sheet("Applicant", schemas.APPLICANT_SHEET),
            "no_affiliation": no_affiliation.select("updated", *schemas.NO_AFFILIATION_SHEET),
            "no_citizenship": workbooks_with_sheet(people, "No citizenship")
            .withColumn("display_name", F.col("birthdate"))
            .select("updated", *citizen),
        }

    def landed(self) -> etl.Landed:
        self.land()
        return etl.Landed(
            **self.landed_people(),
            contacts=[self.extract("contacts")],
            maker_sign_ins=self.extract("maker_sign_ins"),
            hub_sign_ins=self.extract("hub_sign_ins"),
            tag_list=self.extract("tag_list"),
            training=[self.extract("training_sheets")],
        )


def _headers(names: dict[str, str], columns) -> dict[str, str]:
    """Upload header -> column, the last header of each column."""
    found = {new: old for old, new in names.items() if new in columns}
    return {old: new for new, old in found.items()}


UPLOAD_HEADERS = {
    "Student": _headers(schemas.PEOPLE_COLUMNS, schemas.STUDENT_SHEET),
    "Applicant": _headers(schemas.APPLICANT_COLUMNS, schemas.APPLICANT_SHEET),
    "No Affil": _headers(schemas.NO_AFFILIATION_COLUMNS, schemas.NO_AFFILIATION_SHEET),
    "No citizenship": _headers(schemas.PEOPLE_COLUMNS, ["id", "sex", "age", "ethnicity", "residency", "degree"]),
}
EXTRACTS = ("people_sheets", "contacts", "maker_sign_ins", "hub_sign_ins", "tag_list",
            "training_sheets")
CITIZEN_SHEET = ["id", "birthdate", "sex", "age", "ethnicity", "residency", "degree"]
COLUMNS = {
    "participation": [
        "id", "year", "programme", "faculty", "department", "ethnic_group", "ethnicity",
        "residency", "level", "degree", "sex", "iwi",
    ],
    "tag_selection": [
        "tags", "final_tags", "dashboards", "overview", "programme", "velocity", "unleash",
        "createmaker", "curricula", "co_curricula", "journey", "date", "year", "tag_programme",
    ],
    "studio": ["id", "date", "purpose", "equipment", "timestamp", "programme", "year", "month"],
    "training": ["id", "date", "training"],
}
