"""Reference look-up, settlement pass and institution pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.catalog import views as v
from kvartal.catalog.registry import query
from kvartal.operators import lookup, prefix_lookup, restamp, standardise
from kvartal.session import materialise


# The oracle keeps a code per tier and picks the first, tier after tier.


def _tier(n: int, keys: str, before: str, register: str, prefix: str) -> str:
    on = {
        1: "g.sn = t.search_norm AND g.n = t.number_int AND g.sfx = COALESCE(t.number_suffix, '')"
           " AND g.ent = COALESCE(t.entrance, '')",
        2: "g.sn = t.search_norm AND g.n = t.number_int AND g.sfx = COALESCE(t.number_suffix, '')",
        3: "g.sn = t.search_norm",
    }[n]
    return f"""
SELECT t.*, g.code AS {prefix}{n} FROM ({before}) AS t LEFT JOIN
  (SELECT {keys}, MIN(district_code) AS code FROM ({register}) AS r
   GROUP BY ALL HAVING COUNT(DISTINCT district_code) = 1) AS g ON {on}"""


_KEYS = (
    "search_norm AS sn, number_int AS n, number_suffix AS sfx, entrance AS ent",
    "search_norm AS sn, number_int AS n, number_suffix AS sfx",
    "search_norm AS sn",
)


def tiers_sql(target: str, register: str = v.REGISTER, prefix: str = "c") -> str:
    """The target with ``c1, c2, c3``: each tier's unanimous code."""
    text = target
    for n, keys in enumerate(_KEYS, 1):
        text = _tier(n, keys, text, register, prefix)
    return text


_FOUND = tiers_sql(v.TARGETS)
GATED = f"""
SELECT search_norm, number_int, number_suffix, entrance,
       CASE WHEN district_code IS NOT NULL THEN district_code WHEN c1 IS NOT NULL THEN c1
            WHEN c2 IS NOT NULL THEN c2 ELSE c3 END AS district_code,
       CASE WHEN district_code IS NOT NULL THEN NULL WHEN c1 IS NOT NULL THEN 1
            WHEN c2 IS NOT NULL THEN 2 WHEN c3 IS NOT NULL THEN 3 END AS tier
FROM ({_FOUND}) AS f"""
RESTAMPED = f"""
SELECT search_norm, number_int, number_suffix, entrance,
       CASE WHEN c1 IS NOT NULL THEN c1 WHEN district_code IS NOT NULL THEN district_code
            WHEN c2 IS NOT NULL THEN c2 ELSE c3 END AS district_code,
       CASE WHEN c1 IS NOT NULL THEN 1 WHEN district_code IS NOT NULL THEN NULL
            WHEN c2 IS NOT NULL THEN 2 WHEN c3 IS NOT NULL THEN 3 END AS tier
FROM ({_FOUND}) AS f"""
_COUNTS = """
SELECT COUNT(*) FILTER (WHERE tier = 1) AS tier1, COUNT(*) FILTER (WHERE tier = 2) AS tier2,
       COUNT(*) FILTER (WHERE tier = 3) AS tier3,
       COUNT(*) FILTER (WHERE district_code IS NULL) AS remaining_null FROM ({0}) AS s"""


@query(GATED, target=v.TARGETS, register=v.REGISTER)
def lookup_gated(target: DataFrame, register: DataFrame) -> DataFrame:
    return lookup.stamp_by_tiers(target, lookup.build_tiers(register))


@query(RESTAMPED, target=v.TARGETS, register=v.REGISTER)
def lookup_restamp(target: DataFrame, register: DataFrame) -> DataFrame:
    return lookup.stamp_by_tiers(target, lookup.build_tiers(register), restamp=True)


@query(GATED, target=v.TARGETS, register=v.REGISTER)
def lookup_gated_one_pass(target: DataFrame, register: DataFrame) -> DataFrame:
    """The same look-up with one exchange of the rows that ask."""
    return lookup.stamp_by_tiers(target, lookup.build_tiers(register), match=prefix_lookup.match_in_one_pass)


@query(RESTAMPED, target=v.TARGETS, register=v.REGISTER)
def lookup_restamp_one_pass(target: DataFrame, register: DataFrame) -> DataFrame:
    return lookup.stamp_by_tiers(
        target, lookup.build_tiers(register), restamp=True, match=prefix_lookup.match_in_one_pass
    )


@query(_COUNTS.format(GATED), target=v.TARGETS, register=v.REGISTER)
def lookup_tier_counts(target: DataFrame, register: DataFrame) -> DataFrame:
    return lookup.tier_counts(lookup.stamp_by_tiers(target, lookup.build_tiers(register)))


# A later register: some codes moved, some rows gone, some new, on one street in seven.
_LATER_REGISTER = f"""
SELECT search_norm, number_int, number_suffix, entrance,
       CASE WHEN LENGTH(search_norm) % 2 = 0 AND number_int % 9 = 1 AND search_norm LIKE '%7' THEN '06' ELSE district_code END
         AS district_code
FROM ({v.REGISTER}) AS r WHERE NOT (search_norm LIKE '%17' AND number_int > 40)
UNION ALL SELECT DISTINCT search_norm, CAST(77 AS SMALLINT), '', '', '02' FROM ({v.REGISTER}) AS r
WHERE search_norm LIKE '%37'"""
# Both versions' codes beside each target that a restamp by the first one has left.
_VERSIONS = tiers_sql(
    tiers_sql(f"SELECT search_norm, number_int, number_suffix, entrance, district_code FROM ({RESTAMPED}) AS b"),
    _LATER_REGISTER, "n",
)


@query(f"""
SELECT search_norm, number_int, number_suffix, entrance, district_code AS before,
       COALESCE(n1, district_code, n2, n3) AS district_code,
       CASE WHEN n1 IS NOT NULL THEN 1 WHEN district_code IS NOT NULL THEN NULL
            WHEN n2 IS NOT NULL THEN 2 WHEN n3 IS NOT NULL THEN 3 END AS tier
FROM ({_VERSIONS}) AS w
WHERE c1 IS DISTINCT FROM n1 OR c2 IS DISTINCT FROM n2 OR c3 IS DISTINCT FROM n3""",
    target=v.TARGETS, register=v.REGISTER, later=_LATER_REGISTER)
def restamp_reached(target: DataFrame, register: DataFrame, later: DataFrame) -> DataFrame:
    """What a change of the register reaches, and no other row."""
    old, new = lookup.build_tiers(register), lookup.build_tiers(later)
    stamped = lookup.stamp_by_tiers(target, old, restamp=True).drop(lookup.TIER)
    return restamp.restamp_reached(stamped, old, new)


_PREFIX_CODE = """CASE WHEN {0} LIKE 'ГР.ВАРНА%' OR {0} LIKE 'ГР. ВАРНА%' THEN '10135'
       WHEN {0} LIKE 'С.КАМЕНАР%' OR {0} LIKE 'С. КАМЕНАР%' THEN '35701'
       WHEN {0} LIKE 'С.ТОПОЛИ%' OR {0} LIKE 'С. ТОПОЛИ%' THEN '72709'
       WHEN {0} LIKE 'С.ЗВЕЗДИЦА%' OR {0} LIKE 'С. ЗВЕЗДИЦА%' THEN '30497'
       WHEN {0} LIKE 'С.КОНСТАНТИНОВО%' OR {0} LIKE 'С. КОНСТАНТИНОВО%' THEN '38354'
       WHEN {0} LIKE 'С.КАЗАШКО%' OR {0} LIKE 'С. КАЗАШКО%' THEN '35211' END"""


@query(
    f"SELECT id, raw_name, {_PREFIX_CODE.format('raw_name')} AS settlement_code FROM ({v.STREETS}) AS s",
    streets=v.STREETS,
)
def classify_streets(streets: DataFrame) -> DataFrame:
    return standardise.classify_by_prefix(streets.select("id", "raw_name"), "raw_name")


def _settled(new_first: bool) -> str:
    code = _PREFIX_CODE.format("s.raw_name")
    order = f"{code}, a.settlement_code" if new_first else f"a.settlement_code, {code}"
    touched = f"({code}) IS NOT NULL" + ("" if new_first else " AND a.settlement_code IS NULL")
    return f"""
SELECT a.id, COALESCE({order}) AS settlement_code, {touched} AS settlement_stamped
FROM ({v.STREET_ADDRESSES}) AS a JOIN ({v.STREETS}) AS s ON s.id = a.street_id"""


@query(_settled(False), addresses=v.STREET_ADDRESSES, streets=v.STREETS)
def settlement_gated(addresses: DataFrame, streets: DataFrame) -> DataFrame:
    return lookup.stamp_settlements(addresses, streets).select(
        "id", "settlement_code", "settlement_stamped"
    )


@query(_settled(True), addresses=v.STREET_ADDRESSES, streets=v.STREETS)
def settlement_restamp(addresses: DataFrame, streets: DataFrame) -> DataFrame:
    return lookup.stamp_settlements(addresses, streets, restamp=True).select(
        "id", "settlement_code", "settlement_stamped"
    )


_VOTES = f"""
SELECT e.institution_id, a.district_code FROM ({v.EDGES}) AS e
JOIN ({v.ADDRESSES}) AS a ON a.id = e.address_id"""
PLURALITY = f"""
SELECT institution_id, district_code FROM (
  SELECT institution_id, district_code,
         ROW_NUMBER() OVER (PARTITION BY institution_id ORDER BY COUNT(*) DESC, district_code) AS rn
  FROM ({_VOTES}) AS v WHERE district_code IS NOT NULL GROUP BY institution_id, district_code
) AS r WHERE rn = 1"""


@query(PLURALITY, edges=v.EDGES, addresses=v.ADDRESSES)
def plurality_district(edges: DataFrame, addresses: DataFrame) -> DataFrame:
    return lookup.plurality_label(
        lookup.catchment_votes(edges, addresses), "institution_id", "district_code"
    )


# Institutions of this pass: one per order, with one-line addresses printed from register keys.
# The catchment is the suppliers of the order; the edges of cheap orders point to no institution.
INST_CANDIDATES = f"""
SELECT o_orderkey AS id, CAST(o_orderkey AS STRING) AS external_id, 'Name' AS name,
       {v.KIND_BY_STATUS} AS kind,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
            WHEN o_orderpriority = '2-HIGH' THEN 'ГР.СОФИЯ УЛ.Х 5'
            ELSE 'ГР.ВАРНА УЛ.' || CAST(o_custkey AS STRING) || ' '
                 || CAST(DAY(o_orderdate) AS STRING) END AS address,
       CASE WHEN o_totalprice > 400000 THEN '05' END AS district_code
FROM orders"""
INST_EDGES = """
SELECT DISTINCT l_suppkey AS address_id,
       CASE WHEN o_totalprice > 250000 THEN l_orderkey ELSE -1 - l_orderkey END AS institution_id
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
INST_ADDRESSES = """
SELECT s_suppkey AS id, CASE WHEN s_acctbal < 5000 THEN NULL
       ELSE LPAD(CAST(1 + s_nationkey % 5 AS STRING), 2, '0') END AS district_code
FROM supplier"""
INST_REGISTER = """
SELECT 'gr.varna ul.' || CAST(o_custkey AS STRING) AS search_norm,
       CAST(DAY(o_orderdate) + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 2 END AS SMALLINT)
         AS number_int, '' AS number_suffix,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'А' ELSE '' END AS entrance,
       LPAD(CAST(1 + (o_custkey + CASE WHEN o_custkey % 3 = 0 THEN DAY(o_orderdate) ELSE 0 END) % 5
            AS STRING), 2, '0') AS district_code
FROM orders"""


def _inst_pass(gated: bool) -> str:
    gate = "kind <> 'nursery'" + (" AND old IS NULL" if gated else "")

    def agreed(*more: str) -> str:
        return f"""(SELECT {', '.join(('search_norm', *more))}, MIN(district_code) AS code
        FROM ({INST_REGISTER}) AS x GROUP BY ALL HAVING COUNT(DISTINCT district_code) = 1)"""

    return f"""
WITH votes AS (
  SELECT e.institution_id, a.district_code AS code, COUNT(*) AS n
  FROM ({INST_EDGES}) AS e JOIN ({INST_ADDRESSES}) AS a ON a.id = e.address_id
  WHERE a.district_code IS NOT NULL GROUP BY ALL
), majority AS (
  SELECT institution_id, code FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY institution_id ORDER BY n DESC, code) AS rn FROM votes) AS r WHERE rn = 1
), degree AS (
  SELECT institution_id, COUNT(*) AS n FROM ({INST_EDGES}) AS e GROUP BY institution_id
), parsed AS (
  SELECT id, external_id, kind, district_code AS old, address,
         CASE WHEN address LIKE 'ГР.ВАРНА%'
              THEN 'gr.varna ul.' || REPLACE(SPLIT_PART(address, ' ', 2), 'УЛ.', '') END AS sn,
         CASE WHEN address LIKE 'ГР.ВАРНА%' THEN CAST(SPLIT_PART(address, ' ', 3) AS SMALLINT) END AS num
  FROM ({INST_CANDIDATES}) AS i
), found AS (
  SELECT p.*, m.code AS majority, COALESCE(d.n, 0) AS edges,
         CASE WHEN t1.code IS NOT NULL THEN t1.code WHEN t2.code IS NOT NULL THEN t2.code
              ELSE t3.code END AS own, {gate} AS todo
  FROM parsed AS p
  LEFT JOIN majority AS m ON m.institution_id = p.id
  LEFT JOIN degree AS d ON d.institution_id = p.id
  LEFT JOIN {agreed('number_int', 'number_suffix', 'entrance')} AS t1
    ON t1.search_norm = sn AND t1.number_int = num AND t1.number_suffix = '' AND t1.entrance = ''
  LEFT JOIN {agreed('number_int', 'number_suffix')} AS t2
    ON t2.search_norm = sn AND t2.number_int = num AND t2.number_suffix = ''
  LEFT JOIN {agreed()} AS t3 ON t3.search_norm = sn
)
SELECT id, kind, CASE WHEN NOT todo THEN old ELSE COALESCE(majority, own, old) END AS district_code,
       CASE WHEN NOT todo THEN NULL WHEN majority IS NOT NULL THEN 'primary'
            WHEN own IS NOT NULL THEN 'fallback' END AS stamp,
       CASE WHEN NOT todo OR majority IS NOT NULL OR own IS NOT NULL THEN NULL
            WHEN address LIKE 'ГР.СОФИЯ%' THEN 'address_parse_failed'
            WHEN edges > 0 THEN 'all_catchment_null'
            WHEN address IS NULL THEN 'no_catchment' ELSE 'grao_lookup_failed' END AS unresolved_reason,
       CASE WHEN todo THEN edges END AS catchment_rows
FROM found"""


_INST_VIEWS = dict(
    institutions=INST_CANDIDATES, edges=INST_EDGES, addresses=INST_ADDRESSES, register=INST_REGISTER
)


def _institution_pass(register: DataFrame, **frames) -> DataFrame:
    return lookup.stamp_institutions(**frames, register=lookup.build_tiers(register))


_INST_COLUMNS = ["id", "kind", "district_code", "stamp", "unresolved_reason", "catchment_rows"]


@query(_inst_pass(True), **_INST_VIEWS)
def institutions_gated(**frames: DataFrame) -> DataFrame:
    return _institution_pass(**frames).select(*_INST_COLUMNS)


@query(_inst_pass(False), **_INST_VIEWS)
def institutions_restamp(**frames: DataFrame) -> DataFrame:
    return _institution_pass(**frames, restamp=True).select(*_INST_COLUMNS)


@query(
    f"""SELECT COUNT(*) FILTER (WHERE stamp = 'primary') AS "primary",
       COUNT(*) FILTER (WHERE stamp = 'fallback') AS fallback,
       COUNT(unresolved_reason) AS remaining_null FROM ({_inst_pass(True)}) AS s""",
    **_INST_VIEWS,
)
def institution_stamp_counts(**frames: DataFrame) -> DataFrame:
    return lookup.stamp_counts(_institution_pass(**frames))


@query(
    f"""SELECT id, external_id, name, address, unresolved_reason, catchment_rows
FROM (SELECT s.*, c.external_id, c.name, c.address FROM ({_inst_pass(True)}) AS s
      JOIN ({INST_CANDIDATES}) AS c USING (id)) AS j
WHERE unresolved_reason IS NOT NULL ORDER BY id LIMIT 5""",
    **_INST_VIEWS,
)
def unresolved_institution_sample(**frames: DataFrame) -> DataFrame:
    return lookup.unresolved_institutions(_institution_pass(**frames))


# A later register of this pass: other districts for one customer in eleven.
_INST_LATER = f"""
SELECT search_norm, number_int, number_suffix, entrance,
       CASE WHEN LENGTH(search_norm) = 14 AND number_int % 2 = 0 AND search_norm LIKE '%3' THEN '05' ELSE district_code END AS district_code
FROM ({INST_REGISTER}) AS r"""
# Of the addresses of the catchments some move, and some that had no district get one.
_INST_MOVES = f"""
SELECT id, '03' AS district_code, district_code AS before, 1 AS tier FROM ({INST_ADDRESSES}) AS a
WHERE id % 16 = 5 AND district_code IS DISTINCT FROM '03'"""
_INST_MOVED = f"""
SELECT id, CASE WHEN id % 16 = 5 THEN '03' ELSE district_code END AS district_code FROM ({INST_ADDRESSES}) AS a"""
_INST_BEFORE, _INST_AFTER = (
    _inst_pass(False),
    _inst_pass(False).replace(INST_ADDRESSES, _INST_MOVED).replace(INST_REGISTER, _INST_LATER),
)


@query(f"""
SELECT b.id, b.kind, b.district_code AS before, COALESCE(CASE WHEN a.stamp IS NOT NULL THEN a.district_code END, b.district_code) AS district_code
FROM ({_INST_BEFORE}) AS b JOIN ({_INST_AFTER}) AS a USING (id)
WHERE COALESCE(CASE WHEN a.stamp IS NOT NULL THEN a.district_code END, b.district_code) IS DISTINCT FROM b.district_code""",
    **_INST_VIEWS, later=_INST_LATER, moves=_INST_MOVES)
def institution_changes(register: DataFrame, later: DataFrame, moves: DataFrame, **frames: DataFrame) -> DataFrame:
    """The institutions that get another district when addresses and register rows move."""
    old, new = lookup.build_tiers(register), lookup.build_tiers(later)
    institutions = frames["institutions"]
    # Written, as a job's tables are: both are read several times.
    frames["edges"] = materialise(frames["edges"], "edges")
    stamped = materialise(
        lookup.stamp_institutions(**frames, register=old, restamp=True).select(*institutions.columns), "stamped-institutions"
    )
    changed = restamp.changed_keys(old, new)
    found = restamp.institution_changes(stamped, frames["edges"], frames["addresses"], moves, new, changed)
    return found.where(~F.col("before").eqNullSafe(F.col("district_code"))).select("id", "kind", "before", "district_code")


@query(
    f"""SELECT a.id, s.raw_name || ' ' || CAST(a.number_int AS STRING)
       || COALESCE(a.number_suffix, '') || COALESCE(' вх.' || a.entrance, '') AS label
FROM ({v.STREET_ADDRESSES}) AS a JOIN ({v.STREETS}) AS s ON s.id = a.street_id
WHERE a.district_code IS NULL ORDER BY a.id LIMIT 5""",
    addresses=v.STREET_ADDRESSES, streets=v.STREETS,
)
def unresolved_address_sample(addresses: DataFrame, streets: DataFrame) -> DataFrame:
    return lookup.unresolved_addresses(addresses, streets)
