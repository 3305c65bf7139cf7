"""Readers and writers, on tables written for the query into the shared folder."""

import uuid

from pyspark.sql import functions as F

from turnout.functions.fingerprint import FINGERPRINT, content_fingerprint
from turnout.plans import landing
from turnout.plans.registry import query
from turnout.plans.standin import COLUMNS
from turnout.session import own_path
from turnout.sinks import duplicates, versions
from turnout.sources import conformance, tables


def new_folder(t, name: str) -> str:
    return own_path(t.spark, f"{name}-{uuid.uuid4().hex}")


def landed_sheets(t) -> str:
    """People sheets as they land: one folder per kind, sheet and year."""
    root = new_folder(t, "landed")
    versions.write_table(t.people_sheets, root, "parquet", "kind", "sheet", "updated")
    return root


def reordered_by(rows, c: str):
    """The same rows, dealt by a column to partitions whose size Spark bounds: however few values
    the column has, a partition that grows large is read by several tasks."""
    return rows.hint("rebalance", c)


@query("scan_published", """
SELECT id, year, programme, faculty, department, ethnic_group, ethnicity, residency, level,
       degree, sex, nullif(iwi, 'NA') AS iwi FROM participation""")
def _(t):
    path = new_folder(t, "csv")
    versions.write_table(t.participation.select(*COLUMNS["participation"]), path, "csv")
    return tables.scan_published(
        t.spark, "participation", path, "csv", COLUMNS["participation"]
    )


@query("scan_published_studio", "SELECT DISTINCT * FROM studio")
def _(t):
    path = new_folder(t, "csv")
    versions.write_table(t.derived("studio").select(*COLUMNS["studio"]), path, "csv")
    return tables.scan_published(t.spark, "studio", path, "csv", COLUMNS["studio"])


@query("scan_published_training", "SELECT id, date, training AS programme FROM training")
def _(t):
    path = new_folder(t, "parquet")
    versions.write_table(t.derived("training").select(*COLUMNS["training"]), path)
    return tables.scan_published(t.spark, "training", path)


@query("scan_year_folders", """
SELECT updated, id, sheet, admit_term, residency FROM
(SELECT updated, id, sheet, nullif(admit_term, 'NA') AS admit_term, residency
 FROM people_sheets) x""")
def _(t):
    root = new_folder(t, "years")
    columns = ["id", "sheet", "admit_term", "residency"]
    versions.write_table(t.people_sheets.select("updated", *columns), root, "csv", "updated")
    return tables.scan_year_folders(t.spark, root, "part-*.csv")


@query("union_files_by_name", "SELECT id, tags FROM contacts")
def _(t):
    root = new_folder(t, "contacts")
    versions.write_table(t.extract("contacts"), root, "parquet", "export")
    files = [t.spark.read.parquet(f"{root}/export={x}") for x in ("F", "O", "P")]
    return tables.union_files_by_name(*files, columns=["id", "tags"])


@query("union_sheets_as_text", """
SELECT DISTINCT date, id, CASE WHEN sheet <> 'N' THEN tag END AS tag, tag_1 FROM training_sheets""")
def _(t):
    root = new_folder(t, "training")
    columns = ["sheet", "date", "id", "tag", "tag_1"]
    versions.write_table(t.extract("training_sheets").select(*columns), root, "parquet", "sheet")
    sheets = {x: t.spark.read.parquet(f"{root}/sheet={x}") for x in ("A", "N", "R")}
    # ids of one sheet come as numbers, another sheet lacks a column
    numbers = sheets["A"].withColumn("id", F.col("id").cast("long"))
    return tables.union_sheets_as_text(numbers, sheets["N"].drop("tag"), sheets["R"])


@query("sheets_present", "SELECT DISTINCT kind, updated, sheet FROM people_sheets")
def _(t):
    landed = t.spark.read.parquet(landed_sheets(t))
    return tables.sheet_catalog(landed.withColumn("updated", F.col("updated").cast("string")))


@query("workbooks_with_sheet", """
SELECT updated, id, sex FROM people_sheets WHERE sheet = 'No Affil'""")
def _(t):
    landed = t.spark.read.parquet(landed_sheets(t))
    rows = tables.workbooks_with_sheet(landed, "No Affil")
    return rows.select(F.col("updated").cast("string").alias("updated"), "id", "sex")


@query("scan_tag_list", """
SELECT tags, final_tags, dashboards, curricula, date, comment FROM tag_list""")
def _(t):
    path = new_folder(t, "tag-list") + ".csv"
    columns = ["tags", "final_tags", "dashboards", "curricula", "date", "comment"]
    versions.write_table(t.extract("tag_list").select(*columns), path, "csv")
    return tables.scan_tag_list(t.spark, path)


@query("schema_conformance", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders")
def _(t):
    template = ["o_custkey", "o_orderkey", "o_orderdate"]
    return conformance.conform(t.source("orders"), template, allow_extra=True)


@query("schema_conformance_exact", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    other = ["n_nationkey", "n_name"]
    return conformance.conform(
        t.source("nation"), other, ["n_regionkey", "n_name", "n_nationkey"]
    )


@query("required_sheets", """
SELECT DISTINCT sheet FROM people_sheets
WHERE sheet IN ('Student','Applicant','No Affil','No citizenship')""")
def _(t):
    return tables.sheet_choices(tables.sheet_catalog(t.people_sheets))


@query("required_sheets_of_uploads", """
SELECT export AS kind, bool_or(tags IS NOT NULL) AS has_sheet FROM contacts WHERE export = 'F' GROUP BY export
UNION ALL SELECT 'tags', FALSE""")
def _(t):
    root = new_folder(t, "uploads")
    contacts = t.extract("contacts").select(
        F.col("row_id").alias("ID"), F.col("id").alias("UoA ID"), F.col("tags").alias("Tags"))
    landing.accept_upload(contacts, root, "contacts", "contacts", "2026")
    catalog = landing.landed_sheets(t.spark, root)
    return t.spark.createDataFrame(
        [("F", tables.has_required_sheet(catalog, "contacts")),
         ("tags", tables.has_required_sheet(catalog, "tags"))], "kind string, has_sheet boolean")


@query("required_sheets_none", "SELECT 'None' AS sheet FROM training_sheets LIMIT 1")
def _(t):
    return tables.sheet_choices(t.extract("training_sheets"))


@query("preview", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def _(t):
    orders = t.source("orders").select("o_orderkey", "o_totalprice")
    return tables.preview(orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey"))


@query("write_csv_table", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders""")
def _(t):
    path = new_folder(t, "csv")
    orders = t.source("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    versions.write_table(orders, path, "csv")
    return tables.read_csv(t.spark, path, orders.schema)


@query("write_if_changed", """
WITH s AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM studio) x),
h AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM studio) x WHERE programme LIKE '%Hub%')
SELECT 1 AS step, TRUE AS changed, TRUE AS stored, n AS n_rows FROM s
UNION ALL SELECT 2, FALSE, FALSE, n FROM s
UNION ALL SELECT 3, TRUE, TRUE, n FROM h
UNION ALL SELECT 4, TRUE, FALSE, n FROM s""")
def _(t):
    target = versions.VersionedTables(t.spark, new_folder(t, "versions"))
    hub = t.studio.filter(F.col("programme").contains("Hub"))
    steps = []
    for step, df in enumerate([t.studio, t.studio.orderBy("id"), hub, t.studio], start=1):
        result = target.write_if_changed(df, "studio")
        rows = target.read("studio", result.version).count()
        steps.append((step, result.changed, result.stored, rows))
    return t.spark.createDataFrame(
        steps, "step int, changed boolean, stored boolean, n_rows long"
    )


@query("content_fingerprint", """
SELECT count(*) AS n_rows, TRUE AS same_when_reordered, TRUE AS differs_when_edited
FROM participation""")
def _(t):
    rows = t.participation
    edited = rows.withColumn("level", F.concat("level", F.lit("!")))
    prints = [
        content_fingerprint(x).select("n_rows", F.concat_ws("|", *FINGERPRINT).alias("text"))
        for x in (rows, reordered_by(rows, "degree"), edited)
    ]
    reordered, changed = [p.select("text").scalar() for p in prints[1:]]
    return prints[0].select(
        "n_rows",
        (F.col("text") == reordered).alias("same_when_reordered"),
        (F.col("text") != changed).alias("differs_when_edited"),
    )


@query("store_version_if_unique", """
WITH d AS (SELECT source AS name, text, CAST(doc_id AS STRING) AS version, lang FROM documents)
SELECT name, min(version) AS version FROM d a
WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM d b WHERE b.lang = 'en' AND b.name = a.name
                                   AND b.text = a.text)
GROUP BY name, text""")
def _(t):
    stored = t.source("documents").select(
        F.col("source").alias("name"), F.sha2("text", 256).alias("fingerprint"),
        F.col("doc_id").cast("string").alias("version"), "lang",
    )
    new = versions.unseen_versions(stored.filter("lang <> 'en'"), stored.filter("lang = 'en'"))
    return new.select("name", "version")


@query("prune_versions", """
SELECT name, version, stored_at FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY stored_at DESC, version DESC) AS n
  FROM (SELECT CAST(o_custkey AS STRING) AS name, CAST(o_orderkey AS STRING) AS version,
               o_orderdate AS stored_at FROM orders) o) x WHERE n > 5""")
def _(t):
    catalog = t.source("orders").select(
        F.col("o_custkey").cast("string").alias("name"),
        F.col("o_orderkey").cast("string").alias("version"),
        F.col("o_orderdate").alias("stored_at"),
    )
    return versions.stale_versions(catalog, keep=5)


@query("exact_duplicates", """
SELECT folder, name, modified FROM (
  SELECT lang AS folder, CAST(doc_id AS STRING) AS name, doc_id AS modified,
         row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS n FROM documents) x
WHERE n > 1""")
def _(t):
    files = t.source("documents").select(
        F.col("lang").alias("folder"), F.col("doc_id").cast("string").alias("name"),
        F.col("doc_id").alias("modified"), F.col("text").alias("content"),
    )
    return versions.exact_duplicates(files)


@query("duplicate_files", """
SELECT c_nationkey AS nation, count(*) - count(DISTINCT n) AS n_removed FROM (
  SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) x GROUP BY c_nationkey""")
def _(t):
    root = new_folder(t, "files")
    figures = t.source("customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.count("*").cast("string").alias("n"))
    # a file for each row
    figures.select(F.col("c_nationkey").alias("nation"), "n").write.option(
        "maxRecordsPerFile", 1).partitionBy("nation").text(root)
    removed = duplicates.duplicate_files(t.spark, root).groupBy("folder").agg(F.count("*").alias("n"))
    folders = duplicates.listed_files(t.spark, root).select("folder").distinct()
    return folders.join(removed, "folder", "left").select(
        F.regexp_extract("folder", "nation=(.*)$", 1).cast("int").alias("nation"),
        F.coalesce("n", F.lit(0)).alias("n_removed"))


@query("changed_any", """
SELECT TRUE AS first_run, FALSE AS second_run, count(*) AS n_rows FROM training""")
def _(t):
    target = versions.VersionedTables(t.spark, new_folder(t, "versions"))
    runs = {"training": t.training, "tag_selection": t.selection}
    first = versions.changed_any(target.publish_all(runs).values())
    second = versions.changed_any(target.publish_all(runs).values())
    return target.read("training").agg(F.count("*").alias("n_rows")).select(
        F.lit(first).alias("first_run"), F.lit(second).alias("second_run"), "n_rows"
    )


@query("archive_upload", """
SELECT id, tags, row_id FROM contacts""")
def _(t):
    root = new_folder(t, "data")
    upload = t.extract("contacts").select("id", "tags", "row_id")
    return t.spark.read.parquet(versions.archive_upload(upload, root, "2026", "contacts"))


@query("half_a_run", """
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM training) x) AS n_training
FROM (SELECT DISTINCT * FROM studio) y""")
def _(t):
    target = versions.VersionedTables(t.spark, new_folder(t, "versions"))
    target.publish_all({"studio": t.studio, "training": t.training})
    lost = t.training.select("id", "date", F.raise_error(F.lit("lost")).cast("string").alias("training"))
    try:
        target.publish_all({"studio": t.studio.limit(1), "training": lost})
    except Exception as e:  # noqa: BLE001  the loss is the point
        if "lost" not in str(e):
            raise
    # a run that is lost after its first table leaves both tables of the run before
    n = target.read("training").count()
    return target.read("studio").agg(F.count("*").alias("n_rows")).withColumn(
        "n_training", F.lit(n).cast("long"))
