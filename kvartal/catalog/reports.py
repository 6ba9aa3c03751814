"""Listings, dumps, content tags, substring search and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.catalog import views as v
from kvartal.catalog.registry import query
from kvartal.catalog.routes import SETTLEMENT_SQL
from kvartal.catalog.strings import search_key_sql
from kvartal.operators import browse, numbering, quality, standardise, substrings
from kvartal.schemas import (
    CITY_CODE, DISTRICT_CODES, KINDS, REGISTER, SETTLEMENT_DIM, settlements_dim,
)
from kvartal.sources import dump, merkle

_DISTRICTS = ", ".join(f"'{c}'" for c in DISTRICT_CODES)
_KINDS = ", ".join(f"'{k}'" for k in KINDS)
_STREET_COLUMNS = ", ".join(browse.STREET_COLUMNS)


# A listing is compared with its places, since the comparison itself ignores row order.
@query(
    f"""SELECT {_STREET_COLUMNS}, ROW_NUMBER() OVER (ORDER BY city, raw_name, id) AS position
FROM ({v.STREETS}) AS s""",
    streets=v.STREETS,
)
def list_streets(streets: DataFrame) -> DataFrame:
    return numbering.with_position(browse.list_streets(streets), browse.street_order())


@query(
    f"""SELECT id, street_id, number_int, number_suffix, entrance,
       ROW_NUMBER() OVER (ORDER BY street_id, number_int, number_suffix NULLS LAST,
                          entrance NULLS LAST, id) AS position
FROM ({v.STREET_ADDRESSES}) AS a""",
    addresses=v.STREET_ADDRESSES,
)
def list_addresses(addresses: DataFrame) -> DataFrame:
    return numbering.with_position(browse.list_addresses(addresses), browse.address_order())


@query(
    f"""SELECT id, external_id, name, kind, source_url, CAST(last_seen_at AS STRING) AS last_seen_at,
       ROW_NUMBER() OVER (ORDER BY CASE kind WHEN 'nursery' THEN 0 WHEN 'kindergarten' THEN 1
         WHEN 'preschool' THEN 2 ELSE 3 END, name, external_id, id) AS position
FROM ({v.STORED}) AS i""",
    institutions=v.STORED,
)
def list_institutions(institutions: DataFrame) -> DataFrame:
    listed = browse.list_institutions(institutions).withColumn(
        "last_seen_at", F.col("last_seen_at").cast("string")
    )
    return numbering.with_position(listed, browse.institution_order())


def _json(numbers: str, texts: str, times: str = "") -> str:
    """SQL that spells a row as the dump does; texts need no escapes here."""
    parts = {c: (f"CAST({c} AS STRING)", "") for c in numbers.split()}
    parts |= {c: (c, '"') for c in texts.split()}
    parts |= {c: (f"STRFTIME({c}, '%Y-%m-%dT%H:%M:%S.000000Z')", '"') for c in times.split()}
    return " || ',' || ".join(
        f"""'"{c}":' || COALESCE('{quote}' || {value} || '{quote}', 'null')"""
        for c, (value, quote) in parts.items()
    )


# Times with a zone, so that the dump's text does not depend on the session's.
_ZONED = v.STORED.replace("01:00:00'", "01:00:00Z'")
_JSON = {
    "streets": _json("id", "city raw_name street_part type_marker"),
    "addresses": _json("id street_id number_int", "number_suffix entrance"),
    "institutions": _json("id", "external_id name kind source_url", "last_seen_at"),
}
_DUMP_VIEWS = {"streets": v.STREETS, "addresses": v.STREET_ADDRESSES, "institutions": _ZONED}
_DUMP_ORDERS = {
    "streets": "city, raw_name, id",
    "addresses": "street_id, number_int, number_suffix NULLS LAST, entrance NULLS LAST, id",
    "institutions": """CASE kind WHEN 'nursery' THEN 0 WHEN 'kindergarten' THEN 1
         WHEN 'preschool' THEN 2 ELSE 3 END, name, external_id, id""",
}


def _dump_sql(table: str) -> str:
    return f"""SELECT ROW_NUMBER() OVER (ORDER BY {_DUMP_ORDERS[table]}) AS position,
       '{{' || {_JSON[table]} || '}}' AS value FROM ({_DUMP_VIEWS[table]}) AS s"""


@query(_dump_sql("streets"), streets=v.STREETS)
def dump_streets(streets: DataFrame) -> DataFrame:
    return dump.numbered_dump(streets, browse.STREET_COLUMNS, browse.street_order())


@query(_dump_sql("addresses"), addresses=v.STREET_ADDRESSES)
def dump_addresses(addresses: DataFrame) -> DataFrame:
    return dump.numbered_dump(addresses, browse.ADDRESS_COLUMNS, browse.address_order())


@query(_dump_sql("institutions"), institutions=_ZONED)
def dump_institutions(institutions: DataFrame) -> DataFrame:
    return dump.numbered_dump(institutions, browse.INSTITUTION_COLUMNS, browse.institution_order())


def _piece(i: int) -> str:
    # 15 hex digits as a number; DuckDB reads a hex literal with its prefix.
    return f"SUM(CAST(CAST('0x' || SUBSTR(d, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT))"


def _tag_sql(table: str) -> str:
    return f"""SELECT rows, 'v1-' || SUBSTR(SHA256('{table}:' || CAST(rows AS STRING) || ':'
       || CAST(p0 AS STRING) || ':' || CAST(p1 AS STRING) || ':' || CAST(p2 AS STRING) || ':'
       || CAST(p3 AS STRING)), 1, 16) AS tag
FROM (SELECT COUNT(*) AS rows, {_piece(0)} AS p0, {_piece(1)} AS p1, {_piece(2)} AS p2,
             {_piece(3)} AS p3
      FROM (SELECT SHA256('{{' || {_JSON[table]} || '}}') AS d
            FROM ({_DUMP_VIEWS[table]}) AS s) AS h) AS t"""


# --- hash trees: rows, then four levels of ranges; those above a single node don't count ----------

_TREE_LEVELS = 4


def _tree_sql(table: str, source: str, key: str) -> str:
    """The CTEs ``l1 .. l4`` of one table's tree."""
    ctes = [f"""r0 AS (
SELECT ROW_NUMBER() OVER (ORDER BY {_DUMP_ORDERS[table]}) AS position, SHA256('{{' || {_JSON[table]} || '}}') AS digest,
       1 AS rows, {key} AS first_key, {key} AS last_key FROM ({source}) AS s)"""]
    for n in range(1, _TREE_LEVELS + 1):
        ctes.append(f"""n{n} AS (SELECT *, SUM(CASE WHEN digest LIKE '00%' OR position = 1 THEN 1 ELSE 0 END)
  OVER (ORDER BY position) AS node FROM r{n - 1})""")
        ctes.append(f"""r{n} AS (SELECT CAST(node AS BIGINT) AS position, CAST(SUM(rows) AS BIGINT) AS rows,
  FIRST(first_key ORDER BY position) AS first_key, LAST(last_key ORDER BY position) AS last_key,
  SHA256(STRING_AGG(digest, '' ORDER BY position)) AS digest FROM n{n} GROUP BY node)""")
    return ",\n".join(ctes)


def _nodes_sql(table: str, source: str, key: str) -> str:
    # A level is part of the tree if the one below it has more than one node.
    levels = " UNION ALL ".join(
        f"""SELECT {n} AS level, position AS node, rows, first_key, last_key, digest FROM r{n}
WHERE {'TRUE' if n == 1 else f'(SELECT COUNT(*) FROM r{n - 1}) > 1'}"""
        for n in range(1, _TREE_LEVELS + 1)
    )
    return f"WITH {_tree_sql(table, source, key)} {levels}"


_ID_KEY = """'{"id":' || CAST(id AS STRING) || '}'"""
# Some rows changed, some lost, some new: all among a tenth of the ids.
_CHANGED_ADDRESSES = f"""
SELECT id, street_id, CASE WHEN id % 1000 = 3 THEN CAST(number_int + 1 AS SMALLINT) ELSE number_int END AS number_int,
       number_suffix, entrance, district_code, settlement_code
FROM ({v.STREET_ADDRESSES}) AS a WHERE id % 1000 <> 5"""


@query(_nodes_sql("streets", v.STREETS, _ID_KEY), streets=v.STREETS)
def merkle_streets(streets: DataFrame) -> DataFrame:
    tree = merkle.merkle_tree(streets, browse.STREET_COLUMNS, browse.street_order(), ["id"])
    return tree.drop("parent")


@query(_nodes_sql("addresses", v.STREET_ADDRESSES, _ID_KEY), addresses=v.STREET_ADDRESSES)
def merkle_addresses(addresses: DataFrame) -> DataFrame:
    # Read in another partitioning: the tree is the same.
    spread = addresses.repartition(7, "number_int")
    return merkle.merkle_tree(spread, browse.ADDRESS_COLUMNS, browse.address_order(), ["id"]).drop("parent")


@query(f"""
SELECT rows, 'v1-' || SUBSTR(SHA256('addresses:' || CAST(rows AS STRING) || ':' || digest), 1, 16) AS tag
FROM ({_nodes_sql("addresses", v.STREET_ADDRESSES, _ID_KEY)}) AS t
ORDER BY level DESC LIMIT 1""", addresses=v.STREET_ADDRESSES)
def merkle_tag_addresses(addresses: DataFrame) -> DataFrame:
    tree = merkle.merkle_tree(addresses, browse.ADDRESS_COLUMNS, browse.address_order(), ["id"])
    return merkle.tree_tag(tree, "addresses")


_OLD_LEAVES, _NEW_LEAVES = (
    f"SELECT * FROM ({_nodes_sql('addresses', source, _ID_KEY)}) AS t WHERE level = 1"
    for source in (v.STREET_ADDRESSES, _CHANGED_ADDRESSES)
)


@query(
    " UNION ALL ".join(
        f"SELECT '{side}' AS side, node, rows, first_key, last_key FROM ({own}) AS t WHERE digest NOT IN (SELECT digest FROM ({other}) AS o)"
        for side, own, other in (("old", _OLD_LEAVES, _NEW_LEAVES), ("new", _NEW_LEAVES, _OLD_LEAVES))
    ),
    old=v.STREET_ADDRESSES, new=_CHANGED_ADDRESSES,
)
def merkle_changed_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    trees = (
        merkle.merkle_tree(df, browse.ADDRESS_COLUMNS, browse.address_order(), ["id"]) for df in (old, new)
    )
    return merkle.changed_ranges(*trees)


@query(_tag_sql("streets"), streets=v.STREETS)
def fingerprint_streets(streets: DataFrame) -> DataFrame:
    return dump.content_fingerprint(streets, browse.STREET_COLUMNS, "streets")


@query(_tag_sql("addresses"), addresses=v.STREET_ADDRESSES)
def fingerprint_addresses(addresses: DataFrame) -> DataFrame:
    return dump.content_fingerprint(addresses, browse.ADDRESS_COLUMNS, "addresses")


@query(_tag_sql("institutions"), institutions=_ZONED)
def fingerprint_institutions(institutions: DataFrame) -> DataFrame:
    return dump.content_fingerprint(institutions, browse.INSTITUTION_COLUMNS, "institutions")


@query(
    f"""SELECT a.id, s.raw_name, a.number_int, a.number_suffix, a.entrance, a.district_code
FROM ({v.STREET_ADDRESSES}) AS a JOIN ({v.STREETS}) AS s ON s.id = a.street_id
WHERE {search_key_sql('s.raw_name')} LIKE '%shidget%' AND a.number_int = 7""",
    streets=v.STREETS, addresses=v.STREET_ADDRESSES,
)
def search_streets_substring(streets: DataFrame, addresses: DataFrame) -> DataFrame:
    keyed = standardise.add_search_key(streets, "raw_name")
    return browse.search_streets_substring(keyed, addresses, "shidget", 7)


# Pieces of the streets' own keys: of one to seven characters, at any place; and some that are nowhere.
_PIECES = f"""
SELECT p_partkey AS search_id, CASE WHEN p_partkey % 50 = 7 THEN 'zzq' || CAST(p_partkey AS STRING)
         ELSE SUBSTR(p_name, CAST(1 + p_partkey % 5 AS INT), CAST(1 + p_partkey % 7 AS INT)) || CASE WHEN p_partkey % 3 = 0 THEN ' ' || CAST(p_partkey % 100 AS STRING) ELSE '' END END AS string,
       CAST(NULL AS SMALLINT) AS number
FROM part"""
# The ends of all keys, some with a house number.
_ENDS = """
SELECT p_partkey AS search_id, SUBSTR(p_name || ' ' || CAST(p_partkey AS STRING), 3) AS string,
       CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 50 AS SMALLINT) END AS number
FROM part"""
_NAMED = "SELECT p_partkey + 1 AS id, p_name || ' ' || CAST(p_partkey AS STRING) AS raw_name, p_name || ' ' || CAST(p_partkey AS STRING) AS search_norm FROM part"


@query(
    f"""SELECT DISTINCT string, s.id FROM (SELECT DISTINCT string FROM ({_PIECES}) AS p) AS q
JOIN ({_NAMED}) AS s ON CONTAINS(s.search_norm, string)""",
    streets=_NAMED, strings=_PIECES,
)
def substring_matches(streets: DataFrame, strings: DataFrame) -> DataFrame:
    """Many strings at once, each against every street."""
    return substrings.substring_matches(streets, strings)


@query(
    f"""SELECT search_id, a.id, s.raw_name, a.number_int, a.number_suffix, a.entrance, a.district_code
FROM ({_ENDS}) AS q JOIN ({_NAMED}) AS s ON CONTAINS(s.search_norm, string)
JOIN ({v.STREET_ADDRESSES}) AS a ON a.street_id = s.id
WHERE q.number IS NULL OR q.number = a.number_int""",
    streets=_NAMED, addresses=v.STREET_ADDRESSES, searches=_ENDS,
)
def search_addresses(**frames: DataFrame) -> DataFrame:
    return substrings.search_addresses(**frames)


# --- quality ------------------------------------------------------------------------------------

FAULTY = dict(
    addresses=v.FAULTY_ADDRESSES, institutions=v.FAULTY_INSTITUTIONS, edges=v.FAULTY_EDGES
)


def _long(severity: str, metrics: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{severity}' AS severity, '{m}' AS metric, CAST(({e}) AS BIGINT) AS value FROM {source}"
        for m, e in metrics.items()
    )


def _when(condition: str) -> str:
    return f"COUNT(*) FILTER (WHERE {condition})"


def _report_sql(addresses: str, institutions: str, edges: str) -> str:
    a, i = f"({addresses}) AS a", f"({institutions}) AS i"
    e = f"({edges}) AS e JOIN ({institutions}) AS i ON i.id = e.institution_id"
    unknown = f"""(SELECT DISTINCT settlement_code FROM {a} LEFT JOIN {SETTLEMENT_SQL}
      ON d.code = a.settlement_code WHERE a.settlement_code IS NOT NULL AND d.code IS NULL) AS u"""
    neither = "district_code IS NULL AND settlement_code IS NULL"
    bad_district = f"district_code NOT IN ({_DISTRICTS})"
    bad_kind = f"kind IS NULL OR kind NOT IN ({_KINDS})"
    no_district = "kind = 'nursery' AND district_code IS NULL"
    infants = "kind = 'kindergarten' AND has_infant_group"
    none = "CASE WHEN {0} = 0 THEN 1 ELSE 0 END"
    failures = {
        "no_settlement_no_district_addresses": (_when(neither), a),
        "unknown_settlement_codes": ("COUNT(*)", unknown),
        "nursery_without_district": (_when(no_district), i),
        "nursery_coverage_edges": (_when("kind = 'nursery'"), e),
        "invalid_institution_kinds": (_when(bad_kind), i),
        "invalid_address_district_codes": (_when(bad_district), a),
    }
    failure_rows = " UNION ALL ".join(
        _long("failure", {m: expr}, source) for m, (expr, source) in failures.items()
    )
    parts = [
        _long("info", {
            "addresses_total": "COUNT(*)",
            "addresses_district_known": "COUNT(district_code)",
            "addresses_settlement_known_no_district":
                _when("district_code IS NULL AND settlement_code IS NOT NULL"),
            "addresses_no_settlement_no_district": _when(neither),
            "addresses_invalid_district_codes": _when(bad_district),
        }, a),
        _long("info", {
            f"settlements_{t}": _when(f"locality_type = '{t}'") for t in ("city", "village")
        }, SETTLEMENT_SQL),
        _long("info", {
            **{f"institutions_{k}": _when(f"kind = '{k}'") for k in KINDS},
            "institutions_infant_group_kindergartens": _when(infants),
            "institutions_invalid_kinds": _when(bad_kind),
            "institutions_nursery_without_district": _when(no_district),
        }, i),
        _long("info", {f"edges_{k}": _when(f"kind = '{k}'") for k in KINDS}, e),
        _long("warning", {
            "city_without_district":
                _when(f"district_code IS NULL AND settlement_code = '{CITY_CODE}'"),
        }, a),
        _long("warning", {"zero_infant_group_kindergartens": none.format(_when(infants))}, i),
        _long("warning", {
            f"zero_{k}_edges": none.format(_when(f"kind = '{k}'"))
            for k in ("kindergarten", "preschool")
        }, e),
        failure_rows,
        f"""SELECT 'failure', 'failed', CASE WHEN SUM(value) > 0 THEN 1 ELSE 0 END
FROM ({failure_rows}) AS f""",
    ]
    return " UNION ALL ".join(parts)


def _report(addresses, institutions, edges) -> DataFrame:
    settlements = settlements_dim(addresses.sparkSession)
    return quality.match_data_report(addresses, settlements, institutions, edges)


@query(_report_sql(**FAULTY), **FAULTY)
def match_data_report_faulty(**frames: DataFrame) -> DataFrame:
    return _report(**frames)


_CLEAN = dict(addresses=v.ADDRESSES, institutions=v.INSTITUTIONS, edges=v.EDGES)


@query(_report_sql(**_CLEAN), **_CLEAN)
def match_data_report(**frames: DataFrame) -> DataFrame:
    return _report(**frames)


@query(
    f"""SELECT COUNT(DISTINCT settlement_code) AS unknown_settlement_codes
FROM ({v.STREET_ADDRESSES}) AS a
WHERE settlement_code NOT IN (SELECT code FROM {SETTLEMENT_SQL})""",
    addresses=v.STREET_ADDRESSES,
)
def unknown_settlement_codes(addresses: DataFrame) -> DataFrame:
    return quality.unknown_settlement_codes(addresses, settlements_dim(addresses.sparkSession))


@query(
    f"""SELECT COUNT(*) FILTER (WHERE kind = 'nursery') AS nursery,
       COUNT(*) FILTER (WHERE kind = 'kindergarten') AS kindergarten,
       COUNT(*) FILTER (WHERE kind = 'preschool') AS preschool
FROM ({v.EDGES}) AS e JOIN ({v.INSTITUTIONS}) AS i ON i.id = e.institution_id""",
    edges=v.EDGES, institutions=v.INSTITUTIONS,
)
def coverage_edge_summary(edges: DataFrame, institutions: DataFrame) -> DataFrame:
    return quality.coverage_edge_summary(edges, institutions)


@query(
    f"""SELECT *, city_no_district * 50 > city_total AS stale FROM (
  SELECT {_when('district_code IS NULL')} AS no_district,
         {_when('settlement_code IS NULL')} AS no_settlement, COUNT(*) AS total,
         {_when(f"settlement_code = '{CITY_CODE}'")} AS city_total,
         {_when(f"settlement_code = '{CITY_CODE}' AND district_code IS NULL")} AS city_no_district
  FROM ({v.FAULTY_ADDRESSES}) AS a) AS c""",
    addresses=v.FAULTY_ADDRESSES,
)
def null_rate_report(addresses: DataFrame) -> DataFrame:
    return quality.null_rate_report(addresses)


def _constraints_sql() -> str:
    tables = {
        "institutions": v.FAULTY_INSTITUTIONS, "streets": v.STREETS,
        "addresses": v.FAULTY_ADDRESSES, "address_institutions": v.FAULTY_EDGES,
        "register": v.FAULTY_REGISTER, "settlements": v.FAULTY_SETTLEMENTS,
    }
    required = {
        "institutions":
            "id external_id name kind source_url has_infant_group last_seen_at",
        "streets": "id city raw_name street_part search_norm",
        "addresses": "id street_id number_int",
        "address_institutions": "address_id institution_id",
        "register": " ".join(REGISTER.names), "settlements": " ".join(SETTLEMENT_DIM.names),
    }
    lengths = {
        "institutions": "external_id 16 name 256 kind 16 source_url 512 address 256 district_code 2",
        "streets": "city 64 raw_name 256 street_part 256 type_marker 8 search_norm 256",
        "addresses": "number_suffix 2 entrance 4 district_code 2 settlement_code 5",
        "register": "street_code 5 street_raw 256 search_norm 256 number_suffix 2 entrance 4 "
                    "district_code 2 district_name 64 settlement_code 5",
        "settlements": "code 5 name 64 locality_type 16 municipality_code 2 municipality_name 64 source 32",
    }
    rules = []
    for table, columns in required.items():
        rules += [(table, "not_null", c, f"{c} IS NULL") for c in columns.split()]
    for table, words in lengths.items():
        pairs = words.split()
        rules += [
            (table, "too_long", c, f"LENGTH({c}) > {n}") for c, n in zip(pairs[::2], pairs[1::2])
        ]
    rules += [
        ("institutions", "enum", "kind", f"kind NOT IN ({_KINDS})"),
        ("institutions", "enum", "district_code", f"district_code NOT IN ({_DISTRICTS})"),
        ("addresses", "enum", "district_code", f"district_code NOT IN ({_DISTRICTS})"),
        ("register", "enum", "district_code", f"district_code NOT IN ({_DISTRICTS})"),
        ("settlements", "enum", "locality_type", "locality_type NOT IN ('city', 'village')"),
    ]
    sources = {**tables, "streets": f"SELECT *, raw_name AS search_norm FROM ({v.STREETS}) AS s"}
    rows = [
        f"SELECT '{t}' AS \"table\", '{rule}' AS rule, '{c}' AS columns, {_when(bad)} AS violations "
        f"FROM ({sources[t]}) AS x"
        for t, rule, c, bad in rules
    ]
    keys = (
        ("institutions", "id"), ("institutions", "external_id,kind"), ("streets", "id"),
        ("streets", "raw_name"), ("addresses", "id"),
        ("addresses", "street_id,number_int,number_suffix,entrance"),
        ("address_institutions", "address_id,institution_id"), ("settlements", "code"),
    )
    for table, key in keys:
        optional = table == "addresses" and "," in key
        where = " AND ".join(f"{k} IS NOT NULL" for k in key.split(",")) if optional else "TRUE"
        rows.append(
            f"SELECT '{table}', 'duplicate_key', '{key}', COUNT(*) FROM (SELECT {key} FROM "
            f"({sources[table]}) AS x WHERE {where} GROUP BY {key} HAVING COUNT(*) > 1) AS g"
        )
    references = (
        ("addresses", "street_id", "streets"),
        ("address_institutions", "address_id", "addresses"),
        ("address_institutions", "institution_id", "institutions"),
    )
    for child, c, parent in references:
        rows.append(
            f"SELECT '{child}', 'orphan', '{c}', COUNT(*) FROM ({sources[child]}) AS x "
            f"WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({sources[parent]}) AS y "
            f"WHERE y.id = x.{c})"
        )
    return " UNION ALL ".join(rows)


@query(
    _constraints_sql(), streets=v.STREETS, register=v.FAULTY_REGISTER,
    settlements=v.FAULTY_SETTLEMENTS, **FAULTY,
)
def constraint_report(streets, addresses, institutions, edges, register, settlements) -> DataFrame:
    return quality.constraint_report({
        "institutions": institutions,
        "streets": streets.withColumn("search_norm", F.col("raw_name")),
        "addresses": addresses, "address_institutions": edges, "register": register,
        "settlements": settlements,
    })
