"""Route addresses to institutions: by coverage edge, else by district.

Kindergartens come by edge only, nurseries by district only (their edges are ignored), and
preschools by edge, or by district for an address without any preschool edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.operators.numbering import with_group_position
from kvartal.schemas import KINDS

# Order in which receptions are listed.
KIND_ORDER = KINDS

MATCHED = (
    "id", "external_id", "name", "institution_kind", "source_url", "match_basis",
    "has_infant_group",
)
OFFERED = (
    "id", "external_id", "name", "institution_kind", "reception_kind", "offering",
    "source_url", "match_basis", "has_infant_group",
)
# Results in one row of a response, unless the caller asks otherwise.
RESULT_PAGE = 10_000


def kind_rank(kind: Column) -> Column:
    """Place of a kind in the listing; anything else comes last."""
    ranked = F.when(kind == KIND_ORDER[0], 0)
    for place, name in enumerate(KIND_ORDER[1:], 1):
        ranked = ranked.when(kind == name, place)
    return ranked.otherwise(len(KIND_ORDER))


def _matched(institutions: DataFrame, basis: str) -> DataFrame:
    return institutions.select(
        "id", "external_id", "name", F.col("kind").alias("institution_kind"), "source_url",
        F.lit(basis).alias("match_basis"),
        F.coalesce("has_infant_group", F.lit(False)).alias("has_infant_group"),
        "district_code",
    )


def _kinds(kind: str | None, allowed: tuple[str, ...]) -> list[str]:
    return [k for k in allowed if kind is None or k == kind]


def address_context(addresses: DataFrame, settlements: DataFrame) -> DataFrame:
    """``address_id, district_code, settlement``; the struct is NULL without a settlement row."""
    known = settlements.select(
        F.col("code").alias("settlement_code"),
        F.struct("code", "name", "locality_type").alias("settlement"),
    )
    return addresses.select(
        F.col("id").alias("address_id"), "district_code", "settlement_code"
    ).join(known, "settlement_code", "left").select("address_id", "district_code", "settlement")


def junction_match(edges: DataFrame, institutions: DataFrame, *kinds: str) -> DataFrame:
    """Institutions of the given kinds an address has an edge to."""
    insts = _matched(institutions.where(F.col("kind").isin(list(kinds))), "address")
    return (
        edges.withColumnRenamed("institution_id", "id").join(insts, "id")
        .select("address_id", *MATCHED)
    )


def district_match(addresses: DataFrame, institutions: DataFrame, *kinds: str) -> DataFrame:
    """Institutions of the given kinds in the address's district; NULL matches nothing.

    The result is addresses x institutions per district, as the rule demands: ask for the
    addresses wanted, or use ``district_roster``, which has each institution once. Spark chooses
    the join from the sizes it meets; AQE splits a hot district.
    """
    insts = _matched(
        institutions.where(F.col("kind").isin(*kinds) & F.col("district_code").isNotNull()),
        "district",
    )
    located = addresses.where(F.col("district_code").isNotNull()).select(
        F.col("id").alias("address_id"), "district_code"
    )
    return located.join(insts, "district_code").select("address_id", *MATCHED)


def district_roster(institutions: DataFrame, *kinds: str) -> DataFrame:
    """Institutions of the given kinds by district, with their ``rank`` in its listing.

    One row per institution, so it serves any number of addresses of the district.
    """
    listed = institutions.where(F.col("kind").isin(*kinds) & F.col("district_code").isNotNull())
    order = [kind_rank(F.col("kind")), F.col("name"), F.col("id")]
    return with_group_position(
        listed.select("district_code", "id", "external_id", "name", "kind", "source_url"),
        ["district_code"], order, "rank",
    )


def _without_edges(addresses: DataFrame, edges: DataFrame, institutions: DataFrame, kind: str):
    served = edges.join(
        institutions.where(F.col("kind") == kind).select(F.col("id").alias("institution_id")),
        "institution_id", "left_semi",
    ).select(F.col("address_id").alias("id"))
    return addresses.join(served, "id", "left_anti")


def prefer_then_fallback(
    addresses: DataFrame, edges: DataFrame, institutions: DataFrame, kind: str = "preschool"
) -> DataFrame:
    """Edge matches of a kind, and district matches for the addresses that have none."""
    fallback = _without_edges(addresses, edges, institutions, kind)
    by_edge = junction_match(
        edges.join(addresses.select(F.col("id").alias("address_id")), "address_id", "left_semi"),
        institutions, kind,
    )
    return by_edge.unionByName(district_match(fallback, institutions, kind))


def route_addresses(
    addresses: DataFrame, edges: DataFrame, institutions: DataFrame, kind: str | None = None
) -> DataFrame:
    """All matches of the given addresses; ``kind`` filters the institution's kind."""
    known = addresses.select(F.col("id").alias("address_id"))
    parts = []
    if by_edge := _kinds(kind, ("kindergarten", "preschool")):
        own_edges = edges.join(known, "address_id", "left_semi")
        parts.append(junction_match(own_edges, institutions, *by_edge))
    if _kinds(kind, ("nursery",)):
        parts.append(district_match(addresses, institutions, "nursery"))
    if _kinds(kind, ("preschool",)):
        fallback = _without_edges(addresses, edges, institutions, "preschool")
        parts.append(district_match(fallback, institutions, "preschool"))
    routed = parts[0]
    for part in parts[1:]:
        routed = routed.unionByName(part)
    return routed


def _receives_infants() -> Column:
    return (
        (F.col("institution_kind") == "kindergarten")
        & F.col("has_infant_group")
        & (F.col("match_basis") == "address")
    )


def expand_offerings(matches: DataFrame) -> DataFrame:
    """A standard offering per match; an infant group by edge is offered as a nursery too."""
    standard = F.struct(
        F.col("institution_kind").alias("reception_kind"), F.lit("standard").alias("offering")
    )
    infant = F.struct(
        F.lit("nursery").alias("reception_kind"), F.lit("infant_group").alias("offering")
    )
    offers = F.when(_receives_infants(), F.array(standard, infant)).otherwise(F.array(standard))
    return (
        matches.withColumn("_offer", F.explode(offers))
        .select("address_id", *MATCHED, "_offer.*")
        .select("address_id", *OFFERED)
    )


def offering_order() -> list[Column]:
    return [
        kind_rank(F.col("reception_kind")), F.col("name"), F.col("institution_kind"),
        F.col("offering"), F.col("id"),
    ]


def rank_offerings(offerings: DataFrame) -> DataFrame:
    """Add ``rank`` within the address, from a global sort: one address's rows may span many tasks."""
    return with_group_position(offerings, ["address_id"], offering_order(), "rank")
