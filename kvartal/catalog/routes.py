"""Routing and the institution profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.catalog import views as v
from kvartal.catalog.registry import ORACLES, query
from kvartal.operators import browse, responses, routing
from kvartal.schemas import SETTLEMENTS, settlements_dim

_VIEWS = dict(addresses=v.ADDRESSES, edges=v.EDGES, institutions=v.INSTITUTIONS)

SETTLEMENT_SQL = "(VALUES " + ", ".join(
    f"('{code}', '{name}', '{locality}')" for code, name, locality, _ in SETTLEMENTS
) + ") AS d(code, name, locality_type)"


@query(
    f"""SELECT a.id AS address_id, a.district_code, d.code, d.name, d.locality_type
FROM ({v.ADDRESSES}) AS a LEFT JOIN {SETTLEMENT_SQL} ON d.code = a.settlement_code""",
    addresses=v.ADDRESSES,
)
def address_context(addresses: DataFrame) -> DataFrame:
    context = routing.address_context(addresses, settlements_dim(addresses.sparkSession))
    return context.select("address_id", "district_code", "settlement.*")


_FIELDS = "i.id, i.external_id, i.name, i.kind AS institution_kind, i.source_url"


def _by_edge(*kinds: str) -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"""
SELECT e.address_id, {_FIELDS}, 'address' AS match_basis, i.has_infant_group
FROM ({v.EDGES}) AS e JOIN ({v.INSTITUTIONS}) AS i ON i.id = e.institution_id
WHERE i.kind IN ({listed})"""


def _by_district(kind: str, where: str = "TRUE") -> str:
    return f"""
SELECT a.id AS address_id, {_FIELDS}, 'district' AS match_basis, i.has_infant_group
FROM ({v.ADDRESSES}) AS a JOIN ({v.INSTITUTIONS}) AS i ON i.district_code = a.district_code
WHERE i.kind = '{kind}' AND {where}"""


_NO_PRESCHOOL = f"a.id NOT IN (SELECT address_id FROM ({_by_edge('preschool')}) AS p)"
PRESCHOOL = f"{_by_edge('preschool')} UNION ALL {_by_district('preschool', _NO_PRESCHOOL)}"
ROUTED = f"{_by_edge('kindergarten')} UNION ALL {_by_district('nursery')} UNION ALL {PRESCHOOL}"


@query(_by_edge("kindergarten"), edges=v.EDGES, institutions=v.INSTITUTIONS)
def junction_match(edges: DataFrame, institutions: DataFrame) -> DataFrame:
    return routing.junction_match(edges, institutions, "kindergarten")


@query(_by_district("nursery"), addresses=v.ADDRESSES, institutions=v.INSTITUTIONS)
def district_match(addresses: DataFrame, institutions: DataFrame) -> DataFrame:
    return routing.district_match(addresses, institutions, "nursery")


@query(PRESCHOOL, **_VIEWS)
def prefer_then_fallback(**frames: DataFrame) -> DataFrame:
    return routing.prefer_then_fallback(**frames)


@query(ROUTED, **_VIEWS)
def route_addresses(**frames: DataFrame) -> DataFrame:
    return routing.route_addresses(**frames)


@query(_by_district("nursery"), **_VIEWS)
def route_kind_nursery(**frames: DataFrame) -> DataFrame:
    return routing.route_addresses(**frames, kind="nursery")


def _offered(routed: str) -> str:
    return f"""
SELECT address_id, id, external_id, name, institution_kind, institution_kind AS reception_kind,
       'standard' AS offering, source_url, match_basis, has_infant_group FROM ({routed}) AS r
UNION ALL
SELECT address_id, id, external_id, name, institution_kind, 'nursery', 'infant_group', source_url,
       match_basis, has_infant_group FROM ({routed}) AS r
WHERE institution_kind = 'kindergarten' AND has_infant_group AND match_basis = 'address'"""


_RANK = """CASE {0} WHEN 'nursery' THEN 0 WHEN 'kindergarten' THEN 1 WHEN 'preschool' THEN 2
       ELSE 3 END"""


def _ranked(offered: str) -> str:
    return f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY address_id ORDER BY {_RANK.format('reception_kind')},
       name, institution_kind, offering, id) AS rank FROM ({offered}) AS o"""


RANKED = _ranked(_offered(ROUTED))


@query(_offered(ROUTED), **_VIEWS)
def expand_offerings(**frames: DataFrame) -> DataFrame:
    return routing.expand_offerings(routing.route_addresses(**frames))


@query(RANKED, **_VIEWS)
def rank_offerings(**frames: DataFrame) -> DataFrame:
    expanded = routing.expand_offerings(routing.route_addresses(**frames))
    return routing.rank_offerings(expanded)


@query(_ranked(_offered(_by_edge("kindergarten"))), **_VIEWS)
def rank_offerings_kindergarten(**frames: DataFrame) -> DataFrame:
    routed = routing.route_addresses(**frames, kind="kindergarten")
    return routing.rank_offerings(routing.expand_offerings(routed))


@query(f"""
SELECT district_code, id, external_id, name, kind,
       ROW_NUMBER() OVER (PARTITION BY district_code ORDER BY
         CASE kind WHEN 'nursery' THEN 0 ELSE 1 END, name, id) AS rank
FROM ({v.INSTITUTIONS}) AS i
WHERE kind IN ('nursery', 'preschool') AND district_code IS NOT NULL""", institutions=v.INSTITUTIONS)
def district_roster(institutions: DataFrame) -> DataFrame:
    return routing.district_roster(institutions, "nursery", "preschool").drop("source_url")


def joined(array: str, *fields: str) -> Column:
    """One string per nested list, for comparison."""
    return F.array_join(
        F.transform(array, lambda r: F.concat_ws("/", *(r[f].cast("string") for f in fields))), ";"
    )


def _response_sql(ranked: str) -> str:
    return f"""
SELECT c.address_id, c.district_code, c.code AS settlement, CAST(0 AS BIGINT) AS page_no,
       COALESCE(r.results, '') AS results
FROM (SELECT a.id AS address_id, a.district_code, d.code FROM ({v.ADDRESSES}) AS a
      LEFT JOIN {SETTLEMENT_SQL} ON d.code = a.settlement_code) AS c
LEFT JOIN (SELECT address_id, STRING_AGG(CAST(id AS STRING) || '/' || reception_kind || '/'
             || offering || '/' || match_basis, ';' ORDER BY rank) AS results
           FROM ({ranked}) AS k GROUP BY address_id) AS r ON r.address_id = c.address_id"""


def _response(kind: str | None, addresses, edges, institutions, **paging: int) -> DataFrame:
    settlements = settlements_dim(addresses.sparkSession)
    return responses.routing_response(addresses, edges, institutions, settlements, kind, **paging).select(
        "address_id", "address.district_code", F.col("address.settlement.code").alias("settlement"),
        "page_no",
        joined("results", "id", "reception_kind", "offering", "match_basis").alias("results"),
    )


@query(_response_sql(RANKED), **_VIEWS)
def routing_response(**frames: DataFrame) -> DataFrame:
    return _response(None, **frames)


@query(_response_sql(_ranked(_offered(PRESCHOOL))), **_VIEWS)
def routing_response_preschool(**frames: DataFrame) -> DataFrame:
    return _response("preschool", **frames)


SUPPLIER_VIEWS = dict(addresses=v.ADDRESSES, edges=v.SUPPLIER_EDGES, institutions=v.SUPPLIER_INSTITUTIONS)


def _over_suppliers(sql: str) -> str:
    """The same over institutions that grow with the scale factor."""
    for old, new in ((v.EDGES, v.SUPPLIER_EDGES), (v.INSTITUTIONS, v.SUPPLIER_INSTITUTIONS)):
        sql = sql.replace(f"({old})", f"({new})")
    return sql


@query(_over_suppliers(ORACLES["district_roster"]), institutions=v.SUPPLIER_INSTITUTIONS)
def district_roster_suppliers(institutions: DataFrame) -> DataFrame:
    return routing.district_roster(institutions, "nursery", "preschool").drop("source_url")


RESPONSE_PAGE = 4


def _paged_sql(ranked: str) -> str:
    return f"""
SELECT c.address_id, c.district_code, c.code AS settlement, COALESCE(r.page_no, 0) AS page_no,
       COALESCE(r.results, '') AS results
FROM (SELECT a.id AS address_id, a.district_code, d.code FROM ({v.ADDRESSES}) AS a
      LEFT JOIN {SETTLEMENT_SQL} ON d.code = a.settlement_code) AS c
LEFT JOIN (SELECT address_id, (rank - 1) // {RESPONSE_PAGE} AS page_no,
             STRING_AGG(CAST(id AS STRING) || '/' || reception_kind || '/'
             || offering || '/' || match_basis, ';' ORDER BY rank) AS results
           FROM ({ranked}) AS k GROUP BY ALL) AS r ON r.address_id = c.address_id"""


@query(_over_suppliers(_paged_sql(RANKED)), **SUPPLIER_VIEWS)
def routing_response_pages(**frames: DataFrame) -> DataFrame:
    return _response(None, **frames, page_size=RESPONSE_PAGE)


# Per address what its response depends on: its district, unless nothing of it is listed, and its own institutions.
_CLASSED = f"""
SELECT a.id AS address_id, a.district_code, COALESCE(o.own, '') AS own, COALESCE(o.n, 0) AS n,
       COALESCE(o.preschools, 0) AS preschools
FROM ({v.ADDRESSES}) AS a
LEFT JOIN (SELECT e.address_id, STRING_AGG(CAST(i.id AS STRING), ',' ORDER BY i.id) AS own, COUNT(*) AS n,
                  SUM(CASE WHEN i.kind = 'preschool' THEN 1 ELSE 0 END) AS preschools
           FROM ({v.SUPPLIER_EDGES}) AS e JOIN ({v.SUPPLIER_INSTITUTIONS}) AS i ON i.id = e.institution_id
           WHERE i.kind <> 'nursery' GROUP BY 1) AS o ON o.address_id = a.id"""


@query(f"""
SELECT address_id, MIN(address_id) OVER w AS example, COUNT(*) OVER w AS addresses, n AS own,
       CAST(COALESCE(CASE WHEN preschools > 0 THEN d.nurseries ELSE d.listed END, 0) AS BIGINT) AS listed
FROM ({_CLASSED}) AS c
LEFT JOIN (SELECT district_code AS code, COUNT(*) AS listed,
                  SUM(CASE WHEN kind = 'nursery' THEN 1 ELSE 0 END) AS nurseries
           FROM ({v.SUPPLIER_INSTITUTIONS}) AS i WHERE kind <> 'kindergarten' GROUP BY 1) AS d
  ON d.code = c.district_code
WINDOW w AS (PARTITION BY c.district_code, own)""", **SUPPLIER_VIEWS)
def response_classes(**frames: DataFrame) -> DataFrame:
    """Which addresses share a response, and what it is made of."""
    found = responses.factorise(**frames)
    examples = found.members.groupBy("class_id").agg(F.min("address_id").alias("example"))
    return found.members.join(found.classes, "class_id").join(examples, "class_id").select(
        "address_id", "example", "addresses", "own", "listed"
    )


@query(f"""
WITH classed AS ({_CLASSED}),
examples AS (SELECT district_code, own, MIN(address_id) AS example FROM classed GROUP BY 1, 2)
SELECT r.address_id AS example, r.rank, r.id, r.reception_kind, r.offering
FROM ({_over_suppliers(RANKED)}) AS r JOIN examples ON example = r.address_id
WHERE r.match_basis = 'address'""", **SUPPLIER_VIEWS)
def response_class_offers(**frames: DataFrame) -> DataFrame:
    """The offers that a class has by its own edges, with their ranks in its whole response."""
    found = responses.factorise(**frames)
    return found.offers.select(F.col("example_id").alias("example"), "rank", "id", "reception_kind", "offering")


PROFILE_PAGE = 500
_PLACED = f"""
SELECT e.institution_id AS id, s.id AS street_id, a.id AS address_id,
       ROW_NUMBER() OVER (PARTITION BY e.institution_id ORDER BY s.city, s.raw_name, s.id,
         a.number_int, a.number_suffix NULLS LAST, a.entrance NULLS LAST, a.id) AS place
FROM ({v.EDGES}) AS e JOIN ({v.ADDRESSES}) AS a ON a.id = e.address_id
JOIN ({v.NATION_STREETS}) AS s ON s.id = a.street_id"""
_PROFILE = f"""
WITH groups AS (
  SELECT id, (place - 1) // {PROFILE_PAGE} AS page_no, street_id, MIN(place) AS first,
         STRING_AGG(CAST(address_id AS STRING), ',' ORDER BY place) AS addresses
  FROM ({_PLACED}) AS p GROUP BY ALL
), pages AS (
  SELECT id, page_no, STRING_AGG(CAST(street_id AS STRING) || ':' || addresses, ';' ORDER BY first)
           AS coverage FROM groups GROUP BY ALL
)
SELECT i.id, i.external_id, i.name, i.kind, COALESCE(p.page_no, 0) AS page_no,
       COALESCE(p.coverage, '') AS coverage
FROM ({v.INSTITUTIONS}) AS i LEFT JOIN pages AS p ON p.id = i.id"""


@query(_PROFILE, streets=v.NATION_STREETS, **_VIEWS)
def institution_profile(**frames: DataFrame) -> DataFrame:
    group = F.transform(
        "coverage",
        lambda g: F.concat(
            g["street"]["id"].cast("string"), F.lit(":"),
            F.array_join(F.transform(g["addresses"], lambda a: a["id"].cast("string")), ","),
        ),
    )
    profile = browse.institution_profile(
        frames["institutions"], frames["edges"], frames["addresses"], frames["streets"],
        page_size=PROFILE_PAGE,
    )
    return profile.select(
        "id", "external_id", "name", "kind", "page_no", F.array_join(group, ";").alias("coverage")
    )
