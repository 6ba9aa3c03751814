"""Listings and the institution profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.operators.joins import lookup_join
from kvartal.operators.numbering import with_group_position, with_position
from kvartal.operators.routing import kind_rank
from kvartal.session import materialise

STREET_COLUMNS = ("id", "city", "raw_name", "street_part", "type_marker")
ADDRESS_COLUMNS = ("id", "street_id", "number_int", "number_suffix", "entrance")
INSTITUTION_COLUMNS = ("id", "external_id", "name", "kind", "source_url", "last_seen_at")
COVERAGE_PAGE = 10_000


def street_order() -> list[Column]:
    return [F.col("city"), F.col("raw_name"), F.col("id")]


def address_order() -> list[Column]:
    return [
        F.col("street_id"), F.col("number_int"), F.col("number_suffix").asc_nulls_last(),
        F.col("entrance").asc_nulls_last(), F.col("id"),
    ]


def institution_order() -> list[Column]:
    return [kind_rank(F.col("kind")), F.col("name"), F.col("external_id"), F.col("id")]


def list_streets(streets: DataFrame) -> DataFrame:
    return streets.select(*STREET_COLUMNS).orderBy(*street_order())


def list_addresses(addresses: DataFrame) -> DataFrame:
    return addresses.select(*ADDRESS_COLUMNS).orderBy(*address_order())


def list_institutions(institutions: DataFrame) -> DataFrame:
    return institutions.select(*INSTITUTION_COLUMNS).orderBy(*institution_order())


def institution_profile(
    institutions: DataFrame,
    edges: DataFrame,
    addresses: DataFrame,
    streets: DataFrame,
    page_size: int = COVERAGE_PAGE,
) -> DataFrame:
    """Each institution with its coverage: streets in order, each with its addresses in order.

    An institution may cover any share of all addresses, so the ordered coverage is cut into
    pages of ``page_size`` addresses, one row each (page 0 alone for most). No page is left
    out; an institution that covers no known address has one empty page.

    Streets are put in order once, and an address is sorted by its street's place in it: the
    names are attached to what a page says of a street, not to every address.
    """
    ranked = materialise(
        with_position(streets.select(*STREET_COLUMNS), street_order(), "_street"), "ranked-streets"
    )
    covered = edges.join(
        addresses.select(F.col("id").alias("address_id"), *ADDRESS_COLUMNS[1:]), "address_id"
    ).join(ranked.select(F.col("id").alias("street_id"), "_street"), "street_id").drop("street_id")
    order = [
        F.col("_street"), F.col("number_int"), F.col("number_suffix").asc_nulls_last(),
        F.col("entrance").asc_nulls_last(), F.col("address_id"),
    ]
    numbered = with_group_position(covered, ["institution_id"], order, "_place")
    page = F.floor((F.col("_place") - 1) / page_size).cast("long")
    address = F.struct(
        F.col("address_id").alias("id"), "number_int", "number_suffix", "entrance"
    )
    groups = numbered.groupBy("institution_id", page.alias("page_no"), "_street").agg(
        F.min("_place").alias("_first"),
        F.sort_array(F.collect_list(F.struct("_place", address.alias("address")))).alias("_rows"),
    )
    named = ranked.select("_street", F.struct(*STREET_COLUMNS).alias("street"))
    groups = lookup_join(groups, named, ["_street"], "inner")
    group = F.struct(
        "_first", "street",
        F.transform("_rows", lambda r: r["address"]).alias("addresses"),
    )
    pages = groups.groupBy("institution_id", "page_no").agg(
        F.sort_array(F.collect_list(group)).alias("_groups")
    )
    coverage = F.transform(
        "_groups", lambda g: F.struct(g["street"].alias("street"), g["addresses"].alias("addresses"))
    )
    pages = pages.select(
        F.col("institution_id").alias("id"), "page_no", coverage.alias("coverage")
    )
    insts = institutions.select(*INSTITUTION_COLUMNS)
    # The ids come from the numbered rows, one each: joined as they are, all edges of an institution would meet in a task.
    covering = numbered.select(F.col("institution_id").alias("id")).distinct()
    empty = insts.join(covering, "id", "left_anti").select(
        "*", F.lit(0).cast("long").alias("page_no"),
        F.array().cast(pages.schema["coverage"].dataType).alias("coverage"),
    )
    return insts.join(pages, "id").unionByName(empty)


def search_streets_substring(
    streets: DataFrame, addresses: DataFrame, text: str, number: int | None = None
) -> DataFrame:
    """Addresses whose street key contains ``text``, optionally of one house number."""
    found = streets.where(F.col("search_norm").contains(text)).select(
        F.col("id").alias("street_id"), "raw_name"
    )
    rows = addresses if number is None else addresses.where(F.col("number_int") == number)
    return rows.join(found, "street_id").select(
        "id", "raw_name", "number_int", "number_suffix", "entrance", "district_code"
    )
