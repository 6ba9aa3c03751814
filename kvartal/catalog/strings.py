"""Standardisation of streets, house numbers and one-line addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kvartal.catalog import views as v
from kvartal.catalog.registry import query
from kvartal.functions.text import LATIN
from kvartal.operators import dedupe, standardise


def search_key_sql(text: str) -> str:
    """Transliteration as nested replacements."""
    out = f"LOWER({text})"
    for letter, latin in LATIN.items():
        out = f"REPLACE({out}, '{letter}', '{latin}')"
    return out


KNOWN = "locality NOT IN ('С.КАМЕНАРИ', 'ГР.СОФИЯ')"
STREETS_ORACLE = f"""
SELECT p_partkey, raw, CASE WHEN NOT {KNOWN} THEN NULL WHEN marker = '' THEN raw ELSE locality END AS city,
       CASE WHEN {KNOWN} THEN NULLIF(marker, '') END AS type_marker,
       CASE WHEN NOT {KNOWN} THEN NULL WHEN marker = '' THEN '' ELSE part END AS street_part,
       CASE WHEN {KNOWN} THEN {search_key_sql('raw')} END AS search_norm,
       CASE WHEN {KNOWN} THEN raw END AS raw_name,
       CASE WHEN NOT {KNOWN} THEN 'unknown_locality' END AS reject_reason
FROM ({v.STREET_SOURCES}) AS s"""


@query(STREETS_ORACLE, streets=v.STREET_SOURCES)
def standardise_streets(streets: DataFrame) -> DataFrame:
    return standardise.standardise_streets(streets.select("p_partkey", "raw"), "raw")


_GOOD = "fault = 'none'"
NUMBER_REASON = "CASE fault WHEN 'overflow' THEN 'out_of_range' WHEN 'none' THEN NULL ELSE 'unparseable' END"
PARSED_NUMBER = f"""CASE WHEN {_GOOD} THEN CAST(digits AS SMALLINT) END AS number_int,
       CASE WHEN {_GOOD} THEN NULLIF(suffix, '') END AS number_suffix,
       CASE WHEN {_GOOD} THEN NULLIF(entrance, '') END AS entrance"""


@query(
    f"SELECT l_orderkey, l_linenumber, raw, {PARSED_NUMBER}, {NUMBER_REASON} AS reject_reason "
    f"FROM ({v.NUMBER_SOURCES}) AS n",
    numbers=v.NUMBER_SOURCES,
)
def standardise_numbers(numbers: DataFrame) -> DataFrame:
    return standardise.standardise_numbers(
        numbers.select("l_orderkey", "l_linenumber", "raw"), "raw"
    )


ENTRY_REASON = f"CASE WHEN NOT {KNOWN} THEN 'unknown_locality' ELSE {NUMBER_REASON} END"


@query(
    f"""SELECT {ENTRY_REASON} AS reject_reason, COUNT(*) AS skipped_rows
FROM ({v.ENTRY_SOURCES}) AS e WHERE {ENTRY_REASON} IS NOT NULL GROUP BY 1""",
    entries=v.ENTRY_SOURCES,
)
def quarantine_counts(entries: DataFrame) -> DataFrame:
    rows = entries.select("street", "number")
    return standardise.quarantine_counts(standardise.standardise_entries(rows))


@query(
    f"""SELECT l_suppkey, street AS raw_name, {search_key_sql('street')} AS search_norm,
       CAST(digits AS SMALLINT) AS number_int, NULLIF(suffix, '') AS number_suffix,
       NULLIF(entrance, '') AS entrance
FROM ({v.ENTRY_SOURCES}) AS e WHERE {KNOWN} AND {_GOOD}""",
    entries=v.ENTRY_SOURCES,
)
def accepted_entries(entries: DataFrame) -> DataFrame:
    rows = entries.select("l_suppkey", "street", "number")
    return standardise.accepted(standardise.standardise_entries(rows)).select(
        "l_suppkey", "raw_name", "search_norm", "number_int", "number_suffix", "entrance"
    )


@query(
    f"""SELECT l_suppkey, street, number, {ENTRY_REASON} AS reject_reason
FROM ({v.ENTRY_SOURCES}) AS e WHERE {ENTRY_REASON} IS NOT NULL""",
    entries=v.ENTRY_SOURCES,
)
def quarantined_entries(entries: DataFrame) -> DataFrame:
    rows = entries.select("l_suppkey", "street", "number")
    return standardise.quarantined(standardise.standardise_entries(rows)).select(
        "l_suppkey", "street", "number", "reject_reason"
    )


# A leading blank stays with the street, where it does no harm; an entrance takes the tail.
_TAIL_OK = "(fault = 'none' AND entrance = '' OR fault = 'padded')"
_SPLITS = f"shape NOT IN (5, 6, 7) AND {KNOWN} AND {_TAIL_OK}"


@query(
    f"""SELECT l_orderkey, address,
       CASE WHEN {_SPLITS} THEN {search_key_sql('street')} || CASE WHEN fault = 'padded' THEN '  ' ELSE '' END
       END AS search_norm,
       CASE WHEN {_SPLITS} THEN CAST(digits AS SMALLINT) END AS number_int,
       CASE WHEN {_SPLITS} THEN NULLIF(suffix, '') END AS number_suffix,
       CAST(NULL AS STRING) AS entrance,
       CASE WHEN shape IN (6, 7) THEN 'no_address' WHEN {_SPLITS} THEN NULL
            ELSE 'parse_failed' END AS parse_reason
FROM ({v.ONE_LINE_SOURCES}) AS o""",
    rows=v.ONE_LINE_SOURCES,
)
def parse_one_line_addresses(rows: DataFrame) -> DataFrame:
    return standardise.parse_one_line_addresses(rows.select("l_orderkey", "address"))


_DOC_TEXT = f"SELECT doc_id, {v.cyrillic('text')} AS text FROM documents"


@query(
    f"SELECT doc_id, {search_key_sql('text')} AS search_norm FROM ({_DOC_TEXT}) AS d",
    docs=_DOC_TEXT,
)
def search_key_documents(docs: DataFrame) -> DataFrame:
    return standardise.add_search_key(docs, "text").select("doc_id", "search_norm")


_OCCURRENCES = f"""
SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey,
       'Name ' || CAST(o_orderkey AS STRING) AS name, {v.KIND_BY_STATUS} AS kind,
       CASE WHEN o_totalprice < 100000 THEN NULL ELSE 'street' END AS address
FROM orders"""


def _one(direction: str) -> str:
    return f"""
SELECT o_custkey, kind, o_orderkey, name, address FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey, kind
                               ORDER BY o_orderdate {direction}, o_orderkey {direction}) AS rn
  FROM ({_OCCURRENCES}) AS o) AS r WHERE rn = 1"""


def _deduped(rows: DataFrame, pick) -> DataFrame:
    return pick(rows, ("o_custkey", "kind"), ("o_orderdate", "o_orderkey")).select(
        "o_custkey", "kind", "o_orderkey", "name", "address"
    )


@query(_one("DESC"), rows=_OCCURRENCES)
def dedupe_last_wins(rows: DataFrame) -> DataFrame:
    return _deduped(rows, dedupe.dedupe_last_wins)


@query(_one("ASC"), rows=_OCCURRENCES)
def dedupe_first_wins(rows: DataFrame) -> DataFrame:
    return _deduped(rows, dedupe.dedupe_first_wins)


_ADDRESS_ROWS = f"""
SELECT l_orderkey, l_partkey, l_quantity, NULLIF({v.SUFFIX}, '') AS number_suffix,
       CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS entrance, l_extendedprice, l_suppkey
FROM lineitem"""


@query(
    f"""SELECT l_partkey, l_quantity, number_suffix, entrance, l_orderkey FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_partkey, l_quantity, number_suffix, entrance
                               ORDER BY l_orderkey, l_extendedprice) AS rn
  FROM ({_ADDRESS_ROWS}) AS a) AS r WHERE rn = 1""",
    rows=_ADDRESS_ROWS,
)
def dedupe_null_equal_keys(rows: DataFrame) -> DataFrame:
    key = ("l_partkey", "l_quantity", "number_suffix", "entrance")
    return dedupe.dedupe_first_wins(rows, key, ("l_orderkey", "l_extendedprice")).select(
        *key, "l_orderkey"
    )


@query(
    f"""SELECT l_partkey, l_quantity, number_suffix, entrance, l_suppkey
FROM ({_ADDRESS_ROWS}) AS a GROUP BY ALL""",
    rows=_ADDRESS_ROWS,
)
def distinct_edges(rows: DataFrame) -> DataFrame:
    return dedupe.distinct_edges(
        rows, ("l_partkey", "l_quantity", "number_suffix", "entrance"), ("l_suppkey",)
    )


@query(
    f"SELECT COUNT(*) FILTER (WHERE address IS NULL) AS address_null FROM ({_OCCURRENCES}) AS o",
    rows=_OCCURRENCES,
)
def null_addresses(rows: DataFrame) -> DataFrame:
    return dedupe.null_count(rows, "address", "address_null")
