"""Snapshot documents, the address report and fuzzy street names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal import schemas
from kvartal.catalog import views as v
from kvartal.catalog.registry import query
from kvartal.catalog.strings import search_key_sql
from kvartal.operators import contract, fuzzy, merge, numbering, standardise
from kvartal.plans import ingest
from kvartal.session import materialise, shared_dir
from kvartal.sources import register, snapshot, split_json

DOC = "CAST(o_orderkey AS STRING)"
CUSTOMER = "CAST(o_custkey AS STRING)"
_VERSIONED = "NOT (o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O')"


@query(
    f"SELECT {DOC} AS doc, '1' AS schema_version FROM orders WHERE o_orderpriority = '5-LOW'",
    docs=v.DOCUMENTS,
)
def unsupported_versions(docs: DataFrame) -> DataFrame:
    return contract.unsupported_versions(docs)


def _between(low: int, high: int) -> str:
    # Prices of a band, in which one fault is put into the document.
    return f"o_totalprice BETWEEN {low} AND {high}"


KIND = f"CASE WHEN {_between(200000, 210000)} THEN 'school' WHEN o_orderstatus = 'O' THEN 'nursery' ELSE 'kindergarten' END"
_FAULTS = {
    ("schema_version", "required"): f"NOT ({_VERSIONED})",
    ("scraped_at", "zoned_timestamp"): "o_orderstatus = 'F' AND o_totalprice > 300000",
    ("city", "empty"): "o_totalprice < 5000",
    ("page", "unknown_key"): "o_orderpriority = '1-URGENT' AND o_totalprice > 400000",
    ("institutions[0].name", "empty"): "o_totalprice > 480000",
    ("institutions[0].kind", "enum"): _between(200000, 210000),
    ("institutions[0].source_url", "https_url"):
        "o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'",
    ("institutions[0].address", "empty"): _between(100000, 110000),
    ("institutions[0].district_code", "nursery_needs_district"):
        f"{_between(150000, 160000)} AND o_orderstatus = 'O'",
    ("institutions[0].district_code", "enum"): _between(160001, 170000),
    ("institutions[0].has_infant_group", "type"): _between(250000, 260000),
    ("institutions[0].address_entries[0].number", "empty"): _between(300000, 310000),
    ("institutions[1].kind", "required"): _between(350000, 360000),
    ("institutions[1].phone", "unknown_key"): _between(360001, 370000),
}


@query(
    " UNION ALL ".join(
        f"SELECT {DOC} AS doc, '{path}' AS path, '{rule}' AS rule FROM orders WHERE {when}"
        for (path, rule), when in _FAULTS.items()
    ),
    docs=v.DOCUMENTS,
)
def contract_violations(docs: DataFrame) -> DataFrame:
    return contract.contract_violations(docs)


REFUSED = " OR ".join(["o_orderpriority = '5-LOW'", *(f"({when})" for when in _FAULTS.values())])


@query(
    f"SELECT {DOC} AS doc FROM orders WHERE {REFUSED}",
    docs=v.DOCUMENTS,
)
def refused_documents(docs: DataFrame) -> DataFrame:
    return contract.refused_documents(docs)


@query(
    f"""SELECT {DOC} AS doc, CASE WHEN o_orderpriority = '5-LOW' THEN 1
            WHEN {_VERSIONED} THEN 2 END AS schema_version,
       CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN NULL
            ELSE CAST(EPOCH(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) + 3600 END AS scraped_at,
       CASE WHEN o_totalprice < 5000 THEN '' ELSE 'varna' END AS city
FROM orders""",
    docs=v.DOCUMENTS,
)
def snapshot_envelopes(docs: DataFrame) -> DataFrame:
    return snapshot.envelopes(docs).withColumn("scraped_at", F.unix_timestamp("scraped_at"))


@query(
    f"""SELECT {DOC} AS doc, 0 AS inst_pos, {CUSTOMER} AS external_id, {KIND} AS kind,
       CASE WHEN {_between(100000, 110000)} THEN '' WHEN o_orderstatus = 'P' THEN NULL
            ELSE 'street 1' END AS address,
       CASE WHEN {_between(150000, 160000)} THEN NULL WHEN {_between(160001, 170000)} THEN '06'
            ELSE '01' END AS district_code
FROM orders
UNION ALL
SELECT {DOC}, 1, {CUSTOMER}, CASE WHEN {_between(350000, 360000)} THEN NULL ELSE 'preschool' END,
       NULL, NULL FROM orders""",
    docs=v.DOCUMENTS,
)
def snapshot_institutions(docs: DataFrame) -> DataFrame:
    return snapshot.institutions(snapshot.raw_institutions(docs)).select(
        "doc", "inst_pos", "external_id", "kind", "address", "district_code"
    )


@query(
    f"""SELECT {DOC} AS doc, 0 AS inst_pos, 0 AS entry_pos, {CUSTOMER} AS external_id, {KIND} AS kind,
       'ГР.ВАРНА УЛ.' || {CUSTOMER} AS street,
       CASE WHEN {_between(300000, 310000)} THEN ''
            ELSE '0' || CAST(DAY(o_orderdate) AS STRING) END AS number
FROM orders
UNION ALL
SELECT {DOC}, 0, 1, {CUSTOMER}, {KIND},
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'ГР.СОФИЯ УЛ.А' ELSE 'С.ТОПОЛИ УЛ.А' END, '1А вх.2'
FROM orders""",
    docs=v.DOCUMENTS,
)
def explode_entries(docs: DataFrame) -> DataFrame:
    return snapshot.explode_entries(snapshot.institutions(snapshot.raw_institutions(docs)))


@query("SELECT raw FROM (" + v.DOCUMENTS + ") AS d", docs=v.DOCUMENTS)
def read_snapshot_lines(docs: DataFrame) -> DataFrame:
    """The same documents, written as text files of one document a line and read back."""
    path = f"{shared_dir(docs.sparkSession)}/snapshot-{uuid.uuid4().hex}"
    docs.select("raw").write.text(path)
    return snapshot.read_snapshot_lines(docs.sparkSession, path).select("raw")


# One document per group of customers, an institution per order, with all that JSON puts between quotes.
_NAME = """'no, {' || o_orderpriority || '}],[ ' || CAST(o_orderkey % 7 AS STRING)"""
_LARGE = f"""
SELECT o_custkey % 16 AS part, o_orderkey AS seq,
       '{{"external_id":"' || CAST(o_orderkey AS STRING) || '","name":"' || {_NAME} || ' \\\\\\\\ \\\\"","kind":"'
         || o_orderstatus || '","address_entries":[{{"street":"a","number":"' || CAST(o_orderkey AS STRING) || '"}}]}},' AS value
FROM orders"""
SPLIT_BYTES = "16384"


@query(f"""
SELECT part, ROW_NUMBER() OVER (PARTITION BY part ORDER BY seq) AS place, external_id, name, kind FROM (
  SELECT o_custkey % 16 AS part, o_orderkey AS seq, CAST(o_orderkey AS STRING) AS external_id,
         {_NAME} || ' \\ "' AS name, o_orderstatus AS kind FROM orders
  UNION ALL SELECT DISTINCT o_custkey % 16, 9000000000000000000, 'end', 'Last', NULL FROM orders) AS i""", rows=_LARGE)
def read_snapshot_split(rows: DataFrame) -> DataFrame:
    """A few large documents, each in one file, read in splits much smaller than the files."""
    spark = rows.sparkSession
    parts = rows.select("part").distinct()
    head = '{"schema_version": 2, "scraped_at": "2026-05-04T01:00:00Z", "city": "a, [b", "institutions": ['
    lines = (
        rows.unionByName(parts.select("part", F.lit(-1).cast("long").alias("seq"), F.lit(head).alias("value")))
        .unionByName(parts.select("part", F.lit(2**63 - 1).alias("seq"), F.lit('{"external_id":"end","name":"Last"}]}').alias("value")))
    )
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    placed = lines.repartition("part").sortWithinPartitions("part", "seq").select("part", "value")
    placed.write.partitionBy("part").text(path)
    # A task reads many of the small splits: their number grows with the files, that of tasks does not.
    tasks = str(4 * spark.sparkContext.defaultParallelism)
    settings = {
        "spark.sql.files.maxPartitionBytes": SPLIT_BYTES, "spark.sql.files.openCostInBytes": "0",
        "spark.sql.files.maxPartitionNum": tasks,
    }
    held = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        docs = split_json.read_snapshot_splits(spark, path)
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    found = snapshot.institutions(snapshot.raw_institutions(docs))
    return found.select(
        F.regexp_extract("doc", "part=([0-9]+)", 1).cast("long").alias("part"),
        F.regexp_extract("doc", "-([0-9]{19})$", 1).cast("long").alias("place"), "external_id", "name", "kind",
    )


# --- the report ---------------------------------------------------------------------------------

_LINE_ORDER = "l_partkey, l_quantity, l_extendedprice, l_orderkey, l_linenumber"
_CARRIED = f"""
SELECT *, LAST_VALUE(CASE WHEN class = 'street' THEN l_partkey END IGNORE NULLS) OVER w AS street_key,
       LAST_VALUE(CASE WHEN class = 'street' THEN name END IGNORE NULLS) OVER w AS street_raw
FROM ({v.LINE_SOURCES}) AS t
WINDOW w AS (PARTITION BY l_suppkey ORDER BY {_LINE_ORDER}
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_CELL_COLUMNS = """LPAD(CAST(street_key AS STRING), 5, '0') AS street_code, street_raw,
       CAST(l_quantity AS SMALLINT) AS number_int, {0} AS number_suffix, {1} AS entrance,
       '0' || CAST(1 + s_nationkey % 5 AS STRING) AS district_code,
       'РАЙОН ' || CAST(s_nationkey AS STRING) AS district_name, '10135' AS settlement_code,
       CAST(s_nationkey AS SMALLINT) AS section_no"""
_CELL_SOURCES = f"""
FROM ({_CARRIED}) AS c WHERE class IN ('street', 'more') AND street_key IS NOT NULL"""
REGISTER_ROWS = f"""
SELECT *, {search_key_sql("'ГР.ВАРНА ' || street_raw")} AS search_norm FROM (
  SELECT {_CELL_COLUMNS.format("CASE WHEN l_returnflag = 'A' THEN 'А' ELSE '' END", "''")} {_CELL_SOURCES}
  UNION ALL
  SELECT {_CELL_COLUMNS.format("''", "CASE WHEN l_linestatus = 'O' THEN '12' ELSE 'Б' END")} {_CELL_SOURCES}
) AS u"""


def _report(lines: DataFrame) -> DataFrame:
    placed = numbering.with_position(lines, v.REPORT_ORDER)
    return register.parse_report(
        placed.select(F.lit("report").alias("file"), "position", "line"), place=("position",)
    )


_REGISTER_COLUMNS = [field.name for field in schemas.REGISTER]


@query(REGISTER_ROWS, lines=v.REPORT_LINES)
def parse_report(lines: DataFrame) -> DataFrame:
    return _report(lines).select(*_REGISTER_COLUMNS)


def write_report_files(lines: DataFrame) -> str:
    """Windows-1251 files; range partitions keep a section's lines together and in order."""
    path = f"{shared_dir(lines.sparkSession)}/report-{uuid.uuid4().hex}"
    spread = lines.repartitionByRange("section").sortWithinPartitions(*v.REPORT_ORDER)
    register.write_report(spread, path)
    return path


@query(REGISTER_ROWS, lines=v.REPORT_LINES)
def read_register_files(lines: DataFrame) -> DataFrame:
    """The same lines, written as files and read back by the register source."""
    rows = register.read_register(lines.sparkSession, write_report_files(lines))
    return standardise.accepted(rows).select(*_REGISTER_COLUMNS)


@query(
    f"""SELECT COUNT(*) AS rows_loaded, COUNT(DISTINCT street_code) AS streets_parsed
FROM ({REGISTER_ROWS}) AS r""",
    lines=v.REPORT_LINES,
)
def register_load_summary(lines: DataFrame) -> DataFrame:
    return register.load_summary(_report(lines))


# --- the batch over all documents ------------------------------------------------------------------

# Entries of the documents that are not refused, if they pass both rules.
VALID = f"(SELECT * FROM orders WHERE NOT ({REFUSED})) AS valid"
BATCH_ENTRIES = f"""
SELECT 'ГР.ВАРНА УЛ.' || {CUSTOMER} AS raw_name, CAST(DAY(o_orderdate) AS SMALLINT) AS number_int,
       NULL AS number_suffix, NULL AS entrance, {CUSTOMER} AS external_id, {KIND} AS kind
FROM {VALID}
UNION ALL
SELECT 'С.ТОПОЛИ УЛ.А', 1, 'А', '2', {CUSTOMER}, {KIND} FROM {VALID}
WHERE o_orderpriority <> '3-MEDIUM'"""
_BATCH_SIZES = {
    "institutions": f"""SELECT {CUSTOMER} AS external_id, {KIND} AS kind FROM {VALID} UNION
SELECT {CUSTOMER}, 'preschool' FROM {VALID}""",
    "streets": f"SELECT DISTINCT raw_name FROM ({BATCH_ENTRIES}) AS e",
    "addresses": f"""SELECT DISTINCT raw_name, number_int, number_suffix, entrance
FROM ({BATCH_ENTRIES}) AS e""",
    "address_institutions": f"SELECT DISTINCT * FROM ({BATCH_ENTRIES}) AS e",
}


def batch_sql(again: bool) -> str:
    sizes = {t: f"(SELECT COUNT(*) FROM ({sql}) AS t)" for t, sql in _BATCH_SIZES.items()}
    return " UNION ALL ".join(
        f"SELECT '{t}' AS section, '{c}' AS metric, "
        f"{size if c == ('unchanged' if again else 'inserted') else '0'} AS value"
        for t, size in sizes.items() for c in merge.CHANGES
    )


def valid_documents(docs: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    refused = contract.refused_documents(docs) if refused is None else refused
    return docs.join(refused, "doc", "left_anti")


_REFUSED_COUNT = f" UNION ALL SELECT 'documents', 'refused', COUNT(*) FROM orders WHERE {REFUSED}"


def _batch_runs(docs: DataFrame, runs: int) -> DataFrame:
    """Change counts of the last of several runs over the same documents, and those refused."""
    refused = materialise(contract.refused_documents(docs), "refused-documents")  # read twice
    batch = ingest.plan_batch(valid_documents(docs, refused))
    spark = docs.sparkSession
    tables = {name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}
    for _ in range(runs):
        merged = ingest.upsert(tables, batch)
        tables = {name: df.drop(merge.CHANGE) for name, df in merged.items()}
    return merge.run_summary({
        **{name: merge.change_counts(df) for name, df in merged.items()},
        "documents": refused.agg(F.count("*").alias("refused")),
    })


@query(batch_sql(again=False) + _REFUSED_COUNT, docs=v.DOCUMENTS)
def ingest_first_run(docs: DataFrame) -> DataFrame:
    return _batch_runs(docs, 1)


@query(batch_sql(again=True) + _REFUSED_COUNT, docs=v.DOCUMENTS)
def ingest_rerun(docs: DataFrame) -> DataFrame:
    return _batch_runs(docs, 2)


# --- fuzzy names ---------------------------------------------------------------------------------

_NAMES = "SELECT p_name || ' ' || p_brand AS search_norm FROM part"
_TYPED = "SELECT REPLACE(p_name, 'i', 'y') || ' ' || p_brand AS search_norm FROM part"


def _grams_sql(names: str) -> str:
    return f"""
SELECT key, gram, COUNT(*) OVER (PARTITION BY key) AS size FROM (
  SELECT DISTINCT key, SUBSTR('  ' || word || ' ', CAST(i AS BIGINT), 3) AS gram FROM (
    SELECT key, word, UNNEST(RANGE(1, LENGTH(word) + 2)) AS i FROM (
      SELECT search_norm AS key,
             UNNEST(REGEXP_SPLIT_TO_ARRAY(LOWER(search_norm), '[^a-z0-9]+')) AS word
      FROM (SELECT DISTINCT search_norm FROM ({names}) AS n) AS d) AS w
    WHERE word <> '') AS g) AS x"""


@query(
    f"""SELECT left_key, right_key, shared, size_a + size_b - shared AS total FROM (
  SELECT a.key AS left_key, b.key AS right_key, COUNT(*) AS shared, MIN(a.size) AS size_a,
         MIN(b.size) AS size_b
  FROM ({_grams_sql(_NAMES)}) AS a JOIN ({_grams_sql(_TYPED)}) AS b ON a.gram = b.gram
  GROUP BY a.key, b.key) AS p
WHERE shared * 10 >= 7 * (size_a + size_b - shared)""",
    left=_NAMES, right=_TYPED,
)
def fuzzy_street_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return fuzzy.fuzzy_street_join(left, right, 0.7)


_CITY_NAMES, _CITY_TYPED = (names.replace("SELECT ", "SELECT p_type AS city, ", 1) for names in (_NAMES, _TYPED))


def _city_grams_sql(names: str) -> str:
    return f"""
SELECT city, key, gram, COUNT(*) OVER (PARTITION BY city, key) AS size FROM (
  SELECT DISTINCT city, key, SUBSTR('  ' || word || ' ', CAST(i AS BIGINT), 3) AS gram FROM (
    SELECT city, key, word, UNNEST(RANGE(1, LENGTH(word) + 2)) AS i FROM (
      SELECT city, search_norm AS key,
             UNNEST(REGEXP_SPLIT_TO_ARRAY(LOWER(search_norm), '[^a-z0-9]+')) AS word
      FROM (SELECT DISTINCT city, search_norm FROM ({names}) AS n) AS d) AS w
    WHERE word <> '') AS g) AS x"""


@query(
    f"""SELECT city, left_key, right_key, shared, size_a + size_b - shared AS total FROM (
  SELECT a.city, a.key AS left_key, b.key AS right_key, COUNT(*) AS shared,
         MIN(a.size) AS size_a, MIN(b.size) AS size_b
  FROM ({_city_grams_sql(_CITY_NAMES)}) AS a
  JOIN ({_city_grams_sql(_CITY_TYPED)}) AS b ON a.gram = b.gram AND a.city = b.city
  GROUP BY a.city, a.key, b.key) AS p
WHERE shared * 10 >= 6 * (size_a + size_b - shared)""",
    left=_CITY_NAMES, right=_CITY_TYPED,
)
def fuzzy_street_join_within_city(left: DataFrame, right: DataFrame) -> DataFrame:
    return fuzzy.fuzzy_street_join(left, right, within=["city"])
