"""Change merge, ids, key resolution and deletion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal import schemas
from kvartal.catalog import views as v
from kvartal.catalog.registry import query
from kvartal.operators import merge, numbering
from kvartal.plans import upsert
from kvartal.session import shared_dir
from kvartal.sources.tables import Tables

_SEEN = "CAST(last_seen_at AS STRING) AS last_seen_at"
_OLD_NEW = f"({v.STORED}) AS o FULL OUTER JOIN ({v.INCOMING}) AS n USING (external_id, kind)"
_CHANGE = """CASE WHEN n.name IS NULL THEN 'retained' WHEN o.name IS NULL THEN 'inserted'
       WHEN n.name = o.name AND n.source_url = o.source_url
            AND n.address IS NOT DISTINCT FROM o.address
            AND COALESCE(n.district_code, o.district_code) IS NOT DISTINCT FROM o.district_code
            AND n.has_infant_group = o.has_infant_group THEN 'unchanged' ELSE 'updated' END"""
MERGED = f"""
SELECT o.id, external_id, kind, COALESCE(n.name, o.name) AS name,
       COALESCE(n.source_url, o.source_url) AS source_url,
       CASE WHEN n.name IS NULL THEN o.address ELSE n.address END AS address,
       COALESCE(n.district_code, o.district_code) AS district_code,
       COALESCE(n.has_infant_group, o.has_infant_group) AS has_infant_group,
       COALESCE(n.last_seen_at, o.last_seen_at) AS last_seen_at, {_CHANGE} AS change
FROM {_OLD_NEW}"""
_MERGE_VIEWS = dict(stored=v.STORED, incoming=v.INCOMING)


def _merged(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge.merge_upsert(stored, incoming, merge.INSTITUTIONS)


@query(f"SELECT * REPLACE (CAST(last_seen_at AS STRING) AS last_seen_at) FROM ({MERGED}) AS m", **_MERGE_VIEWS)
def merge_institutions(**frames: DataFrame) -> DataFrame:
    return _merged(**frames).withColumn("last_seen_at", F.col("last_seen_at").cast("string"))


_COUNTS = """SELECT COUNT(*) FILTER (WHERE change = 'inserted') AS inserted,
       COUNT(*) FILTER (WHERE change = 'updated') AS updated,
       COUNT(*) FILTER (WHERE change = 'unchanged') AS unchanged FROM ({0}) AS c"""


@query(_COUNTS.format(MERGED), **_MERGE_VIEWS)
def merge_change_counts(**frames: DataFrame) -> DataFrame:
    return merge.change_counts(_merged(**frames))


@query(
    f"""SELECT id, external_id, kind, {_SEEN} FROM ({MERGED}) AS m
WHERE last_seen_at < TIMESTAMP '2026-05-11 01:00:00'""",
    **_MERGE_VIEWS,
)
def disappeared_institutions(**frames: DataFrame) -> DataFrame:
    seen = F.lit("2026-05-11 01:00:00").cast("timestamp")
    return merge.disappeared(_merged(**frames), seen).select(
        "id", "external_id", "kind", F.col("last_seen_at").cast("string").alias("last_seen_at")
    )


@query(
    f"""SELECT o.id, raw_name, COALESCE(o.city, n.city) AS city,
       CASE WHEN o.id IS NULL THEN n.street_part ELSE o.street_part END AS street_part,
       CASE WHEN o.id IS NULL THEN n.type_marker ELSE o.type_marker END AS type_marker,
       COALESCE(n.search_norm, o.search_norm) AS search_norm,
       CASE WHEN n.city IS NULL THEN 'retained' WHEN o.id IS NULL THEN 'inserted'
            WHEN n.search_norm = o.search_norm THEN 'unchanged' ELSE 'updated' END AS change
FROM ({v.STORED_STREETS}) AS o FULL OUTER JOIN ({v.INCOMING_STREETS}) AS n USING (raw_name)""",
    stored=v.STORED_STREETS, incoming=v.INCOMING_STREETS,
)
def merge_streets(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge.merge_upsert(stored, incoming, merge.STREETS)


@query(
    f"SELECT id, city, raw_name, street_part, type_marker, raw_name AS search_norm FROM ({v.STREETS}) AS s",
    old=v.STORED_STREETS, streets=v.STREETS,
)
def replace_streets(old: DataFrame, streets: DataFrame) -> DataFrame:
    """Full refresh of a table, read back after the switch."""
    spark = streets.sparkSession
    tables = Tables(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")
    tables.replace("streets", old, schemas.STREETS)
    tables.replace(
        "streets", streets.withColumn("search_norm", F.col("raw_name")), schemas.STREETS
    )
    return tables.read("streets", schemas.STREETS)


_ADDRESS_ON = """o.street_id = n.street_id AND o.number_int = n.number_int
  AND o.number_suffix IS NOT DISTINCT FROM n.number_suffix
  AND o.entrance IS NOT DISTINCT FROM n.entrance"""
_ADDRESS_PAIRS = f"""
SELECT o.id, COALESCE(o.street_id, n.street_id) AS street_id,
       COALESCE(o.number_int, n.number_int) AS number_int,
       COALESCE(o.number_suffix, n.number_suffix) AS number_suffix,
       COALESCE(o.entrance, n.entrance) AS entrance,
       CASE WHEN n.id IS NULL THEN 'retained' WHEN o.id IS NULL THEN 'inserted'
            ELSE 'unchanged' END AS change
FROM ({v.STORED_ADDRESSES}) AS o FULL OUTER JOIN ({v.INCOMING_ADDRESSES}) AS n ON {_ADDRESS_ON}"""
_ADDRESS_VIEWS = dict(stored=v.STORED_ADDRESSES, incoming=v.INCOMING_ADDRESSES)


@query(_ADDRESS_PAIRS, **_ADDRESS_VIEWS)
def merge_addresses(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge.merge_upsert(stored, incoming.drop("id"), merge.ADDRESSES)


# A batch of the first tenth of the streets, merged into a table kept in ranges of streets.
STREET_RANGE = 40
_PART_BATCH = f"""
SELECT * FROM ({v.INCOMING_ADDRESSES}) AS n
WHERE street_id * 10 <= (SELECT MAX(street_id) FROM ({v.INCOMING_ADDRESSES}) AS m)"""
_PART_PAIRS = _ADDRESS_PAIRS.replace(f"({v.INCOMING_ADDRESSES}) AS n", f"({_PART_BATCH}) AS n")
_PART_VIEWS = dict(stored=v.STORED_ADDRESSES, incoming=_PART_BATCH)


def _merged_parts(stored: DataFrame, incoming: DataFrame) -> tuple[Tables, upsert.Merged]:
    spark = stored.sparkSession
    tables = Tables(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")
    # What the stored table holds besides ids and keys is of no account here.
    kept = T.StructType([f for f in schemas.ADDRESSES if f.name in stored.columns])
    part = upsert.key_range("street_id", STREET_RANGE)
    tables.publish({"addresses": tables.stage_parts("addresses", stored, part, kept)})
    merged = upsert.upsert_parts(tables, "addresses", incoming.drop("id"), merge.ADDRESSES, part, kept)
    tables.publish({"addresses": merged.parts})
    return tables, merged


@query(
    f"SELECT id, street_id, number_int, number_suffix, entrance FROM ({_PART_PAIRS}) AS p", **_PART_VIEWS
)
def merge_parts_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The whole table, most of whose parts were not written."""
    tables, _ = _merged_parts(stored, incoming)
    return tables.read("addresses", schemas.ADDRESSES).select("id", "street_id", "number_int", "number_suffix", "entrance")


@query(
    f"""SELECT c.*, (SELECT COUNT(DISTINCT street_id // {STREET_RANGE}) FROM ({_PART_BATCH}) AS b) AS met,
       (SELECT COUNT(DISTINCT street_id // {STREET_RANGE}) FROM ({_PART_PAIRS}) AS p WHERE change = 'inserted') AS written,
       (SELECT COUNT(DISTINCT street_id // {STREET_RANGE}) FROM ({_PART_PAIRS}) AS p) AS total
FROM ({_COUNTS.format(_PART_PAIRS)}) AS c""",
    **_PART_VIEWS,
)
def merge_parts_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    merged = _merged_parts(stored, incoming)[1]
    return merge.change_counts(merged.rows).select(
        "*", *(F.lit(n).cast("long").alias(name) for name, n in (("met", merged.met), ("written", merged.written), ("total", merged.total)))
    )


@query(
    f"""SELECT (SELECT MAX(id) FROM ({v.STORED_ADDRESSES}) AS s) + ROW_NUMBER() OVER (
         ORDER BY street_id, number_int, number_suffix NULLS FIRST, entrance NULLS FIRST) AS id,
       street_id, number_int, number_suffix, entrance
FROM ({_ADDRESS_PAIRS}) AS p WHERE change = 'inserted'""",
    **_ADDRESS_VIEWS,
)
def assign_new_ids(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    key = merge.ADDRESSES.key
    fresh = merge.insert_only(stored, incoming.drop("id"), key)
    return numbering.assign_ids(fresh, stored, [F.col(k).asc_nulls_first() for k in key])


@query(
    f"""SELECT address_id, institution_id,
       CASE WHEN o.seen IS NULL THEN 'inserted' WHEN n.seen IS NULL THEN 'retained'
            ELSE 'unchanged' END AS change
FROM (SELECT *, 1 AS seen FROM ({v.EDGES}) AS e) AS o
FULL OUTER JOIN (SELECT *, 1 AS seen FROM ({v.NEWER_EDGES}) AS e) AS n
USING (address_id, institution_id)""",
    stored=v.EDGES, incoming=v.NEWER_EDGES,
)
def merge_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge.merge_upsert(stored, incoming, merge.EDGES)


@query(
    f"""SELECT a.id AS address_id, i.id AS institution_id
FROM ({v.NATURAL_EDGES}) AS e JOIN ({v.NATION_STREETS}) AS s ON s.raw_name = e.raw_name
JOIN ({v.ADDRESSES}) AS a ON a.street_id = s.id AND a.number_int = e.number_int
  AND a.number_suffix IS NOT DISTINCT FROM e.number_suffix
  AND a.entrance IS NOT DISTINCT FROM e.entrance
JOIN ({v.INSTITUTIONS}) AS i ON i.external_id = e.external_id AND i.kind = e.kind""",
    edges=v.NATURAL_EDGES, streets=v.NATION_STREETS, addresses=v.ADDRESSES,
    institutions=v.INSTITUTIONS,
)
def resolve_edges(**frames: DataFrame) -> DataFrame:
    return merge.resolve_edges(**frames)


_GONE_STREET = "city = 'City 3'"
_GONE_INST = "name = 'Group 2'"


@query(
    f"""SELECT e.address_id, e.institution_id FROM ({v.EDGES}) AS e
WHERE NOT EXISTS (SELECT 1 FROM ({v.ADDRESSES}) AS a JOIN ({v.NATION_STREETS}) AS s
                  ON s.id = a.street_id WHERE a.id = e.address_id AND s.{_GONE_STREET})
  AND NOT EXISTS (SELECT 1 FROM ({v.INSTITUTIONS}) AS i
                  WHERE i.id = e.institution_id AND i.{_GONE_INST})""",
    streets=v.NATION_STREETS, addresses=v.ADDRESSES, institutions=v.INSTITUTIONS, edges=v.EDGES,
)
def cascade_delete_edges(streets, addresses, institutions, edges) -> DataFrame:
    return merge.cascade_delete(
        streets.where(_GONE_STREET), institutions.where(_GONE_INST),
        streets, addresses, institutions, edges,
    )["address_institutions"]


@query(
    f"""SELECT a.id, a.street_id FROM ({v.ADDRESSES}) AS a
JOIN ({v.NATION_STREETS}) AS s ON s.id = a.street_id WHERE NOT s.{_GONE_STREET}""",
    streets=v.NATION_STREETS, addresses=v.ADDRESSES, institutions=v.INSTITUTIONS, edges=v.EDGES,
)
def cascade_delete_addresses(streets, addresses, institutions, edges) -> DataFrame:
    return merge.cascade_delete(
        streets.where(_GONE_STREET), institutions.where(_GONE_INST),
        streets, addresses, institutions, edges,
    )["addresses"].select("id", "street_id")


@query(
    f"""SELECT id, kind, CASE WHEN kind = 'nursery' THEN district_code END AS district_code
FROM ({v.STORED}) AS s""",
    stored=v.STORED,
)
def reset_stamps(stored: DataFrame) -> DataFrame:
    return merge.reset_stamps(stored, ("district_code",), F.col("kind") == "nursery").select(
        "id", "kind", "district_code"
    )


_RUN_PARTS = {
    "institutions": _COUNTS.format(MERGED),
    "addresses": _COUNTS.format(_ADDRESS_PAIRS),
}
_RUN = " UNION ALL ".join(
    f"SELECT '{section}' AS section, '{c}' AS metric, {c} AS value FROM ({sql}) AS x"
    for section, sql in _RUN_PARTS.items() for c in merge.CHANGES
) + f""" UNION ALL SELECT 'run', 'address_null', COUNT(*) FILTER (WHERE address IS NULL)
FROM ({v.INCOMING}) AS i"""


@query(_RUN, **_MERGE_VIEWS, stored_addresses=v.STORED_ADDRESSES, new_addresses=v.INCOMING_ADDRESSES)
def run_summary(stored, incoming, stored_addresses, new_addresses) -> DataFrame:
    return merge.run_summary({
        "institutions": merge.change_counts(_merged(stored, incoming)),
        "addresses": merge.change_counts(
            merge.merge_upsert(stored_addresses, new_addresses.drop("id"), merge.ADDRESSES)
        ),
        "run": incoming.agg(F.count_if(F.col("address").isNull()).alias("address_null")),
    })
