"""Domain views of the test tables, as SQL text that reads the same in Spark and DuckDB.

Every view covers the whole of its tables. Faults, gaps and changes are values derived from
the rows' own columns, never rows left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run view text over the parquet tables it names."""
    for name in TABLES:
        if re.search(rf"\b(?:FROM|JOIN) {name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def cyrillic(text: str) -> str:
    """SQL that spells Latin text with Cyrillic letters, digraph letters included."""
    latin, letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБЦДЕФГХИЙКЛМНОПЯРСТУВШЖЪЗ"
    return f"TRANSLATE({text}, '{latin}{latin.lower()}', '{letters}{letters}')"


def text_of(number: str) -> str:
    return f"CAST({number} AS STRING)"


SUFFIX = "CASE WHEN l_linenumber <= 2 THEN 'А' WHEN l_linenumber = 3 THEN 'Б' ELSE '' END"

# --- look-up: register rows and addresses -------------------------------------------------

# Streets of three part types lie in one district; the others split by number, suffix or entrance.
REGISTER = f"""
SELECT 'st-' || CAST(l_partkey AS STRING) AS search_norm,
       CAST(l_quantity AS SMALLINT) AS number_int,
       {SUFFIX} AS number_suffix,
       CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS entrance,
       LPAD(CAST(1 + (l_partkey + CASE p_type
              WHEN 'PROMO' THEN CAST(l_quantity AS INT)
              WHEN 'ECONOMY' THEN CAST(l_quantity AS INT) + l_linenumber
              WHEN 'SMALL' THEN CAST(l_quantity AS INT) + ASCII(l_returnflag)
              ELSE 0 END) % 5 AS STRING), 2, '0') AS district_code
FROM lineitem JOIN part ON p_partkey = l_partkey"""

TARGETS = f"""
SELECT search_norm, number_int, number_suffix, entrance, MIN(old_code) AS district_code
FROM (SELECT CASE WHEN l_linenumber = 6 AND l_linestatus = 'O' THEN 'nw-' ELSE 'st-' END
               || CAST(l_partkey AS STRING) AS search_norm,
             CAST(l_quantity + CASE WHEN l_linenumber = 7 THEN 60 ELSE 0 END AS SMALLINT)
               AS number_int,
             NULLIF({SUFFIX}, '') AS number_suffix,
             CASE WHEN l_linestatus = 'O' THEN 'В' WHEN l_returnflag <> 'N' THEN l_returnflag END
               AS entrance,
             CASE WHEN l_discount > 0.095 THEN '09' END AS old_code
      FROM lineitem) AS t
GROUP BY search_norm, number_int, number_suffix, entrance"""

# --- raw strings ----------------------------------------------------------------------------

# The localities of the municipality, each in both spellings; one per band of part
# sizes. The last two are none of them, though the first of these starts like one.
LOCALITY = """CASE WHEN p_size <= 20 THEN 'ГР.ВАРНА' WHEN p_size <= 24 THEN 'ГР. ВАРНА'
       WHEN p_size <= 27 THEN 'С.КАМЕНАР' WHEN p_size <= 30 THEN 'С. КАМЕНАР'
       WHEN p_size <= 32 THEN 'С.ТОПОЛИ' WHEN p_size <= 34 THEN 'С. ТОПОЛИ'
       WHEN p_size <= 36 THEN 'С.ЗВЕЗДИЦА' WHEN p_size <= 37 THEN 'С. ЗВЕЗДИЦА'
       WHEN p_size <= 39 THEN 'С.КОНСТАНТИНОВО' WHEN p_size <= 40 THEN 'С. КОНСТАНТИНОВО'
       WHEN p_size <= 42 THEN 'С.КАЗАШКО' WHEN p_size <= 44 THEN 'С. КАЗАШКО'
       WHEN p_size <= 47 THEN 'С.КАМЕНАРИ' ELSE 'ГР.СОФИЯ' END"""
MARKER = """CASE p_type WHEN 'STANDARD' THEN 'УЛ.' WHEN 'LARGE' THEN 'БУЛ.' WHEN 'MEDIUM' THEN 'ПЛ.'
       WHEN 'SMALL' THEN 'Ж.К.' WHEN 'PROMO' THEN 'КВ.' ELSE '' END"""
STREET_PART = f"{cyrillic('p_name')} || ' ' || CAST(p_partkey AS STRING)"

STREET_SOURCES = f"""
SELECT p_partkey, {LOCALITY} AS locality, {MARKER} AS marker, {STREET_PART} AS part,
       {LOCALITY} || ' ' || {MARKER} || {STREET_PART} AS raw
FROM part"""

DIGITS = "LPAD(CAST(CAST(l_quantity AS INT) AS STRING), 3, '0')"
CENTS = "CAST(ROUND(l_discount * 100) AS INT)"
TAX_CENTS = "CAST(ROUND(l_tax * 100) AS INT)"
NUMBER_SUFFIX = "CASE WHEN l_linenumber = 1 THEN 'А' WHEN l_linenumber = 2 THEN 'Я' ELSE '' END"
ENTRANCE = """CASE WHEN l_returnflag = 'A' THEN 'Б'
       WHEN l_returnflag = 'R' THEN CAST(l_linenumber * 111 AS STRING) ELSE '' END"""

# The fault, if any, that a line's house number carries.
NUMBER_FAULT = f"""CASE WHEN {CENTS} = 0 THEN 'latin' WHEN {CENTS} = 10 THEN 'overflow'
       WHEN {TAX_CENTS} = 8 THEN 'no_space' WHEN {TAX_CENTS} = 0 THEN 'padded' ELSE 'none' END"""

NUMBER_SOURCES = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, digits, suffix, entrance, fault,
       CASE fault WHEN 'latin' THEN digits || 'B'
                  WHEN 'overflow' THEN '99999' || digits || suffix
                  WHEN 'no_space' THEN digits || suffix || 'вх.А'
                  WHEN 'padded' THEN '  ' || digits || suffix
                  ELSE digits || suffix || CASE WHEN entrance = '' THEN '' ELSE ' вх.' || entrance END
       END AS raw
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {DIGITS} AS digits,
             {NUMBER_SUFFIX} AS suffix, {ENTRANCE} AS entrance, {NUMBER_FAULT} AS fault
      FROM lineitem) AS t"""

ENTRY_SOURCES = f"""
SELECT n.l_orderkey, n.l_linenumber, n.l_suppkey, n.l_partkey, s.locality, n.fault, n.digits,
       n.suffix, n.entrance, s.raw AS street, n.raw AS number
FROM ({NUMBER_SOURCES}) AS n JOIN ({STREET_SOURCES}) AS s ON s.p_partkey = n.l_partkey"""

# One-line addresses: some missing, some empty, some without a space.
ONE_LINE_SOURCES = f"""
SELECT l_orderkey, locality, fault, digits, suffix, entrance, street,
       CASE WHEN l_linenumber = 7 AND entrance = '' THEN NULL
            WHEN l_linenumber = 6 AND entrance = '' THEN ''
            WHEN l_linenumber = 5 AND entrance = '' THEN REPLACE(street || number, ' ', '')
            ELSE street || ' ' || number END AS address,
       CASE WHEN entrance = '' THEN l_linenumber ELSE 0 END AS shape
FROM ({ENTRY_SOURCES}) AS e"""

# --- streets and their addresses ------------------------------------------------------------

STREETS = f"""
SELECT p_partkey + 1 AS id,
       CASE WHEN marker = '' THEN raw ELSE locality END AS city, raw AS raw_name,
       CASE WHEN marker = '' THEN '' ELSE part END AS street_part,
       NULLIF(marker, '') AS type_marker
FROM ({STREET_SOURCES}) AS s"""

STREET_ADDRESSES = """
SELECT MIN(l_orderkey * 8 + l_linenumber) AS id, l_partkey + 1 AS street_id,
       CAST(l_quantity AS SMALLINT) AS number_int,
       CASE WHEN l_linenumber <= 3 THEN 'А' END AS number_suffix,
       CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS entrance,
       MIN(CASE WHEN l_discount > 0.075 THEN '03' END) AS district_code,
       MIN(CASE WHEN l_tax > 0.065 THEN '99999' END) AS settlement_code
FROM lineitem
GROUP BY l_partkey, l_quantity, CASE WHEN l_linenumber <= 3 THEN 'А' END,
         CASE WHEN l_returnflag <> 'N' THEN l_returnflag END"""

# --- routing ----------------------------------------------------------------------------------


def _institutions(offset: int, kind: str) -> str:
    district = "LPAD(CAST(1 + n_regionkey AS STRING), 2, '0')"
    if kind == "preschool":
        district = f"CASE WHEN n_name = 'NATION_7' THEN NULL ELSE {district} END"
    return f"""
SELECT CAST(n_nationkey * 3 + {offset} AS BIGINT) AS id,
       '{kind[0].upper()}' || CAST(n_nationkey AS STRING) AS external_id,
       'Group ' || CAST(n_regionkey AS STRING) AS name, '{kind}' AS kind,
       'https://example.org/' || n_name AS source_url,
       CASE WHEN n_regionkey = 2 THEN NULL ELSE 'st-' || CAST(n_nationkey AS STRING) END AS address,
       {district} AS district_code,
       n_regionkey IN (0, 2, 4) AS has_infant_group,
       TIMESTAMP '2026-05-04 01:00:00' AS last_seen_at
FROM nation"""


INSTITUTIONS = " UNION ALL ".join(
    _institutions(n, kind) for n, kind in enumerate(("nursery", "kindergarten", "preschool"), 1)
)

# Institutions that grow with the scale factor, and their edges.
SUPPLIER_INSTITUTIONS = """
SELECT s_suppkey + 1 AS id, 'S' || CAST(s_suppkey AS STRING) AS external_id,
       'Group ' || CAST(s_suppkey % 4 AS STRING) AS name,
       CASE s_suppkey % 3 WHEN 0 THEN 'nursery' WHEN 1 THEN 'kindergarten' ELSE 'preschool' END AS kind,
       'https://example.org/' || s_name AS source_url,
       'st-' || CAST(s_nationkey AS STRING) AS address,
       CASE WHEN s_suppkey % 11 <> 0
            THEN LPAD(CAST(1 + s_nationkey % 5 AS STRING), 2, '0') END AS district_code,
       s_suppkey % 2 = 0 AS has_infant_group,
       TIMESTAMP '2026-05-04 01:00:00' AS last_seen_at
FROM supplier"""

SUPPLIER_EDGES = """
SELECT DISTINCT o_custkey + 1 AS address_id, l_suppkey + 1 AS institution_id
FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""

NATION_STREETS = """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, 'City ' || CAST(n_regionkey AS STRING) AS city,
       n_name AS raw_name, LOWER(n_name) AS street_part,
       CASE WHEN n_regionkey = 0 THEN NULL ELSE 'УЛ.' END AS type_marker,
       LOWER(n_name) AS search_norm
FROM nation"""

ADDRESSES = """
SELECT c_custkey + 1 AS id, CAST(c_nationkey + 1 AS BIGINT) AS street_id,
       CAST(FLOOR(ABS(c_acctbal)) AS SMALLINT) AS number_int,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'А' WHEN 'HOUSEHOLD' THEN 'Б' END AS number_suffix,
       CASE WHEN c_acctbal < 3000 THEN '1' END AS entrance,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL
            ELSE LPAD(CAST(1 + n_regionkey AS STRING), 2, '0') END AS district_code,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL
            WHEN n_regionkey = 0 THEN '10135' WHEN n_regionkey = 1 THEN '35701'
            WHEN n_regionkey = 2 THEN '72709' WHEN n_regionkey = 3 THEN '30497'
            ELSE '99999' END AS settlement_code
FROM customer JOIN nation ON n_nationkey = c_nationkey"""



def _edges(kindergarten: str) -> str:
    return f"""
SELECT DISTINCT o_custkey + 1 AS address_id,
       CAST(s_nationkey * 3 + CASE WHEN o_orderpriority IN ({kindergarten}) THEN 2
            WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' AND l_linenumber = 1 THEN 3
            ELSE 1 END AS BIGINT) AS institution_id
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey"""


EDGES = _edges("'1-URGENT', '2-HIGH'")
NEWER_EDGES = _edges("'1-URGENT', '4-NOT SPECIFIED'")

# --- quality: the same tables with faults ------------------------------------------------------

FAULTY_INSTITUTIONS = f"""
SELECT id, CASE WHEN name = 'Group 1' THEN 'same' ELSE external_id END AS external_id, name,
       CASE WHEN external_id = 'N3' THEN 'infant' WHEN external_id = 'K4' THEN NULL ELSE kind END
         AS kind,
       source_url, address,
       CASE WHEN name = 'Group 2' THEN NULL WHEN name = 'Group 4' THEN '99' ELSE district_code END
         AS district_code,
       has_infant_group, last_seen_at
FROM ({INSTITUTIONS}) AS i"""

FAULTY_ADDRESSES = f"""
SELECT id, CASE WHEN number_int < 200 THEN 0 ELSE street_id END AS street_id,
       CASE WHEN number_int > 9000 THEN NULL ELSE number_int END AS number_int,
       CASE WHEN number_int > 8500 THEN 'АБВ' ELSE number_suffix END AS number_suffix,
       CASE WHEN number_int > 8000 THEN NULL ELSE entrance END AS entrance,
       CASE WHEN entrance = '1' AND number_suffix = 'А' THEN '99'
            WHEN number_int > 7000 THEN NULL ELSE district_code END AS district_code,
       settlement_code
FROM ({ADDRESSES}) AS a"""

FAULTY_EDGES = f"""
SELECT CASE WHEN address_id <= 5 THEN -address_id ELSE address_id END AS address_id,
       CASE WHEN institution_id = 9 THEN 900 WHEN institution_id = 12 THEN 15
            ELSE institution_id END AS institution_id
FROM ({EDGES}) AS e"""

FAULTY_REGISTER = f"""
SELECT CASE WHEN {CENTS} = 1 THEN NULL ELSE CAST(l_partkey AS STRING) END AS street_code,
       'УЛ.' || CAST(l_partkey AS STRING) AS street_raw, 'ul.' || CAST(l_partkey AS STRING) AS search_norm,
       CASE WHEN {CENTS} = 2 THEN NULL ELSE CAST(l_quantity AS SMALLINT) END AS number_int,
       CASE WHEN {CENTS} = 3 THEN 'АБВ' ELSE '' END AS number_suffix,
       CASE WHEN {CENTS} = 4 THEN NULL ELSE l_returnflag END AS entrance,
       LPAD(CAST(1 + l_suppkey % 6 AS STRING), 2, '0') AS district_code,
       REPEAT('Р', CAST(20 + l_quantity AS INT)) AS district_name, '10135' AS settlement_code,
       CASE WHEN {CENTS} = 5 THEN NULL ELSE CAST(l_linenumber AS SMALLINT) END AS section_no
FROM lineitem"""

FAULTY_SETTLEMENTS = """
SELECT CASE WHEN s_suppkey % 7 = 0 THEN '10135' ELSE CAST(s_suppkey AS STRING) END AS code,
       CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END AS name,
       CASE s_nationkey % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'village' ELSE 'hamlet' END AS locality_type,
       CASE WHEN s_nationkey = 4 THEN '006' ELSE '06' END AS municipality_code,
       'ВАРНА' AS municipality_name, 'list' AS source
FROM supplier"""

# --- change merge --------------------------------------------------------------------------------

KIND_BY_STATUS = """CASE o_orderstatus WHEN 'O' THEN 'nursery' WHEN 'P' THEN 'kindergarten'
       ELSE 'preschool' END"""
CUSTOMER_CODE = "LPAD(CAST(1 + o_custkey % 5 AS STRING), 2, '0')"

STORED = f"""
SELECT o_orderkey + 1 AS id, CAST(o_orderkey AS STRING) AS external_id,
       'Name ' || CAST(o_custkey AS STRING) AS name, {KIND_BY_STATUS} AS kind,
       'https://example.org/' || CAST(o_custkey AS STRING) AS source_url,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
            ELSE 'Address ' || CAST(o_custkey AS STRING) END AS address,
       CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE {CUSTOMER_CODE} END AS district_code,
       o_orderstatus = 'P' AS has_infant_group,
       TIMESTAMP '2026-05-04 01:00:00' AS last_seen_at
FROM orders"""

INCOMING = f"""
SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'new-' ELSE '' END
         || CAST(o_orderkey AS STRING) AS external_id,
       CASE WHEN o_totalprice > 450000 THEN 'Renamed ' ELSE 'Name ' END
         || CAST(o_custkey AS STRING) AS name, {KIND_BY_STATUS} AS kind,
       'https://example.org/' || CAST(o_custkey AS STRING) AS source_url,
       CASE WHEN o_orderpriority = '1-URGENT' OR o_totalprice < 50000 THEN NULL
            ELSE 'Address ' || CAST(o_custkey AS STRING) END AS address,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
            WHEN o_totalprice BETWEEN 100000 AND 120000 THEN '05'
            ELSE {CUSTOMER_CODE} END AS district_code,
       o_orderstatus = 'P' AND o_totalprice < 490000 AS has_infant_group,
       TIMESTAMP '2026-05-11 01:00:00' AS last_seen_at
FROM orders"""


def _order_addresses(shift: str) -> str:
    number = f"CAST(DAY(o_orderdate) + {shift} AS SMALLINT)"
    suffix = "CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'А' END"
    entrance = "CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END"
    return f"""
SELECT MIN(o_orderkey) + 1 AS id, o_custkey + 1 AS street_id, {number} AS number_int,
       {suffix} AS number_suffix, {entrance} AS entrance
FROM orders
GROUP BY o_custkey, {number}, {suffix}, {entrance}"""


STORED_ADDRESSES = _order_addresses("0")
INCOMING_ADDRESSES = _order_addresses("CASE WHEN o_orderpriority = '3-MEDIUM' THEN 31 ELSE 0 END")

STORED_STREETS = f"""
SELECT id, city, raw_name, street_part, type_marker,
       CASE WHEN type_marker = 'УЛ.' THEN 'old key' ELSE raw_name END AS search_norm
FROM ({STREETS}) AS s"""
INCOMING_STREETS = f"""
SELECT 'new city' AS city,
       CASE WHEN type_marker = 'ПЛ.' THEN raw_name || ' 2' ELSE raw_name END AS raw_name,
       'new part' AS street_part, type_marker, raw_name AS search_norm
FROM ({STREETS}) AS s"""

NATURAL_EDGES = f"""
SELECT DISTINCT s.raw_name || CASE WHEN i.name = 'Group 3' THEN '?' ELSE '' END AS raw_name,
       a.number_int, a.number_suffix, a.entrance, i.external_id, i.kind
FROM ({EDGES}) AS e JOIN ({ADDRESSES}) AS a ON a.id = e.address_id
JOIN ({NATION_STREETS}) AS s ON s.id = a.street_id
JOIN ({INSTITUTIONS}) AS i ON i.id = e.institution_id"""

# --- snapshot documents: one per order ------------------------------------------------------------

ORDER_DATE = "CAST(CAST(o_orderdate AS DATE) AS STRING)"


def _entry(street: str, number: str) -> str:
    return f"""'{{"street":"' || {street} || '","number":"' || {number} || '"}}'"""


DOCUMENTS = f"""
SELECT CAST(o_orderkey AS STRING) AS doc,
       '{{' || CASE WHEN o_orderpriority = '5-LOW' THEN '"schema_version":1,'
                   WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN ''
                   ELSE '"schema_version":2,' END
           || '"scraped_at":"' || {ORDER_DATE} || 'T01:00:00'
           || CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN '' ELSE 'Z' END || '",'
           || '"city":"' || CASE WHEN o_totalprice < 5000 THEN '' ELSE 'varna' END || '",'
           || CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000
                   THEN '"page":1,' ELSE '' END
           || '"institutions":['
           || '{{"external_id":"' || CAST(o_custkey AS STRING) || '","name":"'
           || CASE WHEN o_totalprice > 480000 THEN '' ELSE 'Name' END || '","kind":"'
           || CASE WHEN o_totalprice BETWEEN 200000 AND 210000 THEN 'school'
                   WHEN o_orderstatus = 'O' THEN 'nursery' ELSE 'kindergarten' END
           || '","source_url":"' || CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'
                   THEN 'http' ELSE 'https' END || '://example.org/' || CAST(o_orderkey AS STRING)
           || '","address":' || CASE WHEN o_totalprice BETWEEN 100000 AND 110000 THEN '""'
                   WHEN o_orderstatus = 'P' THEN 'null' ELSE '"street 1"' END
           || ',"district_code":' || CASE WHEN o_totalprice BETWEEN 150000 AND 160000 THEN 'null'
                   WHEN o_totalprice BETWEEN 160001 AND 170000 THEN '"06"' ELSE '"01"' END
           || ',"has_infant_group":' || CASE WHEN o_totalprice BETWEEN 250000 AND 260000
                   THEN '"yes"' WHEN o_orderstatus = 'P' THEN 'true' ELSE 'false' END
           || ',"address_entries":['
           || {_entry("'ГР.ВАРНА УЛ.' || CAST(o_custkey AS STRING)",
                      "CASE WHEN o_totalprice BETWEEN 300000 AND 310000 THEN '' ELSE '0' || CAST(DAY(o_orderdate) AS STRING) END")}
           || ',' || {_entry("CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'ГР.СОФИЯ' ELSE 'С.ТОПОЛИ' END || ' УЛ.А'", "'1А вх.2'")}
           || ']}},'
           || '{{"external_id":"' || CAST(o_custkey AS STRING) || '","name":"Second",'
           || CASE WHEN o_totalprice BETWEEN 350000 AND 360000 THEN '' ELSE '"kind":"preschool",' END
           || '"source_url":"https://example.org/2","has_infant_group":false,"address_entries":[]'
           || CASE WHEN o_totalprice BETWEEN 360001 AND 370000 THEN ',"phone":"1"' ELSE '' END
           || '}}]}}' AS raw
FROM orders"""

# --- report lines: one section per supplier, one line per lineitem ------------------------------

# A line starts a street or goes on with the last one; some are malformed.
LINE_CLASS = """CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN 'broken'
       WHEN l_linenumber <= 3 THEN 'street' WHEN l_linenumber = 4 THEN 'noise' ELSE 'more' END"""
LINE_CELLS = f"""{DIGITS} || CASE WHEN l_returnflag = 'A' THEN 'А' ELSE '' END || ','
       || {DIGITS} || CASE WHEN l_linestatus = 'O' THEN ' 12' ELSE ' Б' END
       || CASE WHEN l_tax > 0.045 THEN ',' ELSE '' END"""
LINE_NAME = f"'УЛ.' || {cyrillic('p_name')}"

LINE_SOURCES = f"""
SELECT l_suppkey, l_partkey, l_quantity, l_extendedprice, l_orderkey, l_linenumber,
       l_returnflag, l_linestatus, {LINE_CLASS} AS class, {LINE_CELLS} AS cells,
       {LINE_NAME} AS name, s_nationkey
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey"""

REPORT_LINES = f"""
SELECT s_suppkey AS section, 0 AS step, CAST(0 AS BIGINT) AS l_partkey, CAST(0 AS DOUBLE) AS l_quantity,
       CAST(0 AS DOUBLE) AS l_extendedprice, CAST(0 AS BIGINT) AS l_orderkey, 0 AS l_linenumber,
       'област 03 ВАРНА   община 06 ВАРНА   район 0' || CAST(1 + s_nationkey % 5 AS STRING)
         || '_РАЙОН ' || CAST(s_nationkey AS STRING) || '   10135 ГР.ВАРНА   секция '
         || CAST(s_nationkey AS STRING) AS line
FROM supplier
UNION ALL
SELECT s_suppkey, 1, 0, 0, 0, 0, 0, '   код   име на пътна артерия' FROM supplier
UNION ALL
SELECT l_suppkey, 2, l_partkey, l_quantity, l_extendedprice, l_orderkey, l_linenumber,
       CASE class WHEN 'street' THEN
              RPAD(' ' || LPAD(CAST(l_partkey AS STRING), 5, '0') || ' ' || name, 38, ' ') || cells
            WHEN 'more' THEN RPAD('', 38, ' ') || cells
            WHEN 'broken' THEN RPAD(' 00001 ' || name, 38, ' ') || 'abc,' || cells
            ELSE '   - страница - ' END
FROM ({LINE_SOURCES}) AS t"""
REPORT_ORDER = (
    "section", "step", "l_partkey", "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber",
)
