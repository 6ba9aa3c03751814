"""Fill a derived code from a reference table, and from votes over linked rows.

A code is taken only where all matching reference rows agree. Keys are tried from the
fullest to the coarsest. Every match of one tier is a match of the next, so a disagreement
can never be resolved later, and the tiers reduce to one ``coalesce``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.functions.addresses import address_label
from kvartal.operators.joins import lookup_join
from kvartal.operators.standardise import classify_by_prefix, parse_one_line_addresses
from kvartal.schemas import LOCALITY_PREFIXES, PREFIX_CODES
from kvartal.session import materialise

# The tiers of the address register.
ADDRESS_TIERS = (
    ("search_norm", "number_int", "number_suffix", "entrance"),
    ("search_norm", "number_int", "number_suffix"),
    ("search_norm",),
)
TIER = "tier"


@dataclass(frozen=True)
class Tiers:
    """Per tier one row per key: ``keys, _code`` with NULL where the matches disagree."""

    keys: tuple[tuple[str, ...], ...]
    value: str
    tables: tuple[DataFrame, ...]


def build_tiers(
    reference: DataFrame,
    tiers: Sequence[Sequence[str]] = ADDRESS_TIERS,
    value: str = "district_code",
) -> Tiers:
    """Reduce a reference table to its tiers; worth sharing between look-ups.

    The reference is scanned and shuffled once, for the first tier, which is written; the
    coarser tiers are rolled up from it, not from the reference.
    """
    finest = materialise(
        reference.groupBy(*tiers[0]).agg(F.min(value).alias("_low"), F.max(value).alias("_high")),
        "tier",
    )
    rolled = [finest] + [
        finest.groupBy(*keys).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        for keys in tiers[1:]
    ]
    agreed = F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("_code")
    return Tiers(
        tuple(map(tuple, tiers)), value,
        tuple(table.select(*keys, agreed) for keys, table in zip(tiers, rolled)),
    )


def match_tiers(
    target: DataFrame, tiers: Tiers, empty_if_null: Sequence[str] = (), asked: Column | None = None
) -> DataFrame:
    """Add ``_t1 .. _tn``: the unanimous code of each tier, or NULL.

    ``empty_if_null`` names key columns in which the target holds NULL where the reference
    holds an empty string. Rows that are not ``asked`` have NULL keys and find nothing.
    """
    kinds = dict(tiers.tables[0].dtypes)
    # Worked out in each join: copies of the keys would travel with every row.
    on = {}
    for key in tiers.keys[0]:
        col = F.coalesce(F.col(key), F.lit("")) if key in empty_if_null else F.col(key)
        on[f"_k_{key}"] = (col if asked is None else F.when(asked, col)).cast(kinds[key])
    matched = target
    for n, (keys, table) in enumerate(zip(tiers.keys, tiers.tables), 1):
        names = [f"_k_{k}" for k in keys]
        matched = lookup_join(matched, table.toDF(*names, f"_t{n}"), names, on={k: on[k] for k in names})
    return matched


def stamp_by_tiers(
    target: DataFrame,
    tiers: Tiers,
    empty_if_null: Sequence[str] = ("number_suffix", "entrance"),
    restamp: bool = False,
    match: Callable[..., DataFrame] = match_tiers,
) -> DataFrame:
    """Fill the tiers' value and add ``tier``, the 1-based tier that set it (NULL if none did).

    Gated (default): only rows without a value are looked up; the target is read once, and
    the others pass by with NULL keys, a hot key like any other. Restamp: the first tier
    overwrites wherever it resolves, later tiers only fill NULLs, and a row that resolves
    nowhere keeps what it has. ``match`` finds the codes: a join per tier, or
    ``prefix_lookup.match_in_one_pass``.
    """
    value = tiers.value
    found = [F.col(f"_t{n}") for n in range(1, len(tiers.keys) + 1)]
    old = F.col(value)
    first_hit = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in enumerate(found, 1)))
    if restamp:
        matched = match(target, tiers, empty_if_null)
        tier = F.when(found[0].isNotNull(), F.lit(1)).when(old.isNull(), first_hit)
        candidates = [found[0], old, *found[1:]]
    else:
        matched = match(target, tiers, empty_if_null, asked=old.isNull())
        tier, candidates = first_hit, [old, *found]
    return matched.select(
        *(F.coalesce(*candidates).alias(value) if c == value else c for c in target.columns),
        tier.cast("int").alias(TIER),
    )


def tier_counts(stamped: DataFrame, value: str = "district_code", tiers: int = 3) -> DataFrame:
    """One row: rows set by each tier and rows still without a value."""
    return stamped.agg(
        *(F.count_if(F.col(TIER) == n).alias(f"tier{n}") for n in range(1, tiers + 1)),
        F.count_if(F.col(value).isNull()).alias("remaining_null"),
    )


def _fill_settlement(rows: DataFrame, restamp: bool) -> DataFrame:
    """Apply the street's ``_code`` to ``settlement_code``; rows without one are untouched."""
    old, new = F.col("settlement_code"), F.col("_code")
    touched = new.isNotNull() if restamp else new.isNotNull() & old.isNull()
    return (
        rows.withColumn("settlement_stamped", touched)
        .withColumn("settlement_code", F.when(F.col("settlement_stamped"), new).otherwise(old))
        .drop("_code")
    )


def stamp_settlements(
    addresses: DataFrame, streets: DataFrame, restamp: bool = False, prefixes=PREFIX_CODES
) -> DataFrame:
    """Fill ``settlement_code`` from the street's name and add ``settlement_stamped``.

    Gated: only NULLs. Restamp: every row whose street classifies. Others keep what they have.
    """
    names = streets.select(F.col("id").alias("street_id"), "raw_name")
    codes = classify_by_prefix(names, "raw_name", prefixes, "_code").drop("raw_name")
    return _fill_settlement(addresses.join(codes, "street_id", "left"), restamp).select(
        *addresses.columns, "settlement_stamped"
    )


def stamp_addresses(
    addresses: DataFrame,
    streets: DataFrame,
    register: Tiers,
    restamp: bool = False,
    prefixes=PREFIX_CODES,
) -> DataFrame:
    """District tiers, then the settlement pass: ``tier`` and ``settlement_stamped`` added."""
    names = streets.select(F.col("id").alias("street_id"), "search_norm", "raw_name")
    facts = classify_by_prefix(names, "raw_name", prefixes, "_code").drop("raw_name")
    located = addresses.join(facts, "street_id", "left")
    stamped = stamp_by_tiers(located, register, restamp=restamp)
    return _fill_settlement(stamped, restamp).select(
        *addresses.columns, TIER, "settlement_stamped"
    )


def plurality_label(votes: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent non-NULL value per group, ties to the smallest: ``group, value``."""
    counted = votes.where(F.col(value).isNotNull()).groupBy(group, value).agg(
        F.count("*").alias("_n")
    )
    return counted.groupBy(group).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value)
    )


def catchment_votes(edges: DataFrame, addresses: DataFrame) -> DataFrame:
    """One vote per edge: ``institution_id, district_code`` (NULL for an unstamped address)."""
    return edges.join(
        addresses.select(F.col("id").alias("address_id"), "district_code"), "address_id"
    ).select("institution_id", "district_code")


def stamp_institutions(
    institutions: DataFrame,
    edges: DataFrame,
    addresses: DataFrame,
    register: Tiers,
    restamp: bool = False,
    localities=LOCALITY_PREFIXES,
) -> DataFrame:
    """Fill ``district_code`` of non-nurseries; add ``stamp`` and ``unresolved_reason``.

    ``stamp`` is ``primary`` (plurality over the catchment), ``fallback`` (the institution's
    own address) or NULL. Addresses must be stamped first. A candidate that resolves neither
    way keeps its value and gets a reason.
    """
    candidate = F.col("kind") != "nursery"
    if not restamp:
        candidate = candidate & F.col("district_code").isNull()
    candidate = F.coalesce(candidate, F.lit(False))

    # Edges are read once, for the votes and for their number.
    votes = edges.join(
        addresses.select(F.col("id").alias("address_id"), "district_code"), "address_id", "left"
    ).groupBy(F.col("institution_id").alias("id"), "district_code").agg(F.count("*").alias("_n"))
    code = F.col("district_code")
    catchment = votes.groupBy("id").agg(
        F.min_by(code, F.when(code.isNotNull(), F.struct(-F.col("_n"), code))).alias("_majority"),
        F.sum("_n").alias("_edges"),
    )
    todo = institutions.where(candidate)
    voted = lookup_join(todo, catchment, ["id"])
    # Only an institution without a majority has its own address taken apart and looked up.
    asked = F.col("_majority").isNull()
    parsed = parse_one_line_addresses(
        voted.withColumn("_asked", F.when(asked, F.col("address"))), "_asked", localities
    )
    looked = match_tiers(parsed, register, ("number_suffix", "entrance"), asked=asked)
    by_address = F.when(F.col("parse_reason").isNull(), F.coalesce("_t1", "_t2", "_t3"))
    resolved = F.coalesce("_majority", by_address)
    no_edges = F.coalesce("_edges", F.lit(0)) == 0
    reason = F.when(
        resolved.isNull(),
        F.when(F.col("parse_reason") == "parse_failed", "address_parse_failed")
        .when(no_edges & F.col("parse_reason").isNull(), "grao_lookup_failed")
        .when(no_edges, "no_catchment")
        .otherwise("all_catchment_null"),
    )
    done = looked.select(
        *(c for c in institutions.columns if c != "district_code"),
        F.coalesce(resolved, F.col("district_code")).alias("district_code"),
        F.when(F.col("_majority").isNotNull(), "primary")
        .when(by_address.isNotNull(), "fallback").alias("stamp"),
        reason.alias("unresolved_reason"),
        F.coalesce("_edges", F.lit(0)).alias("catchment_rows"),
    )
    others = institutions.where(~candidate)
    return done.unionByName(others, allowMissingColumns=True).select(
        *institutions.columns, "stamp", "unresolved_reason", "catchment_rows"
    )


def stamp_counts(stamped: DataFrame) -> DataFrame:
    """One row: ``primary, fallback, remaining_null`` of the institution pass."""
    return stamped.agg(
        F.count_if(F.col("stamp") == "primary").alias("primary"),
        F.count_if(F.col("stamp") == "fallback").alias("fallback"),
        F.count_if(F.col("unresolved_reason").isNotNull()).alias("remaining_null"),
    )


def unresolved_addresses(addresses: DataFrame, streets: DataFrame, sample: int = 5) -> DataFrame:
    """The first few addresses without a district, as readable labels."""
    names = streets.select(F.col("id").alias("street_id"), "raw_name")
    label = address_label(
        F.col("raw_name"), F.col("number_int"), F.col("number_suffix"), F.col("entrance")
    )
    return (
        addresses.where(F.col("district_code").isNull())
        .join(names, "street_id")
        .select("id", label.alias("label"))
        .orderBy("id")
        .limit(sample)
    )


def unresolved_institutions(stamped: DataFrame, sample: int = 5) -> DataFrame:
    """The first few institutions without a district, with the reason."""
    return (
        stamped.where(F.col("unresolved_reason").isNotNull())
        .select("id", "external_id", "name", "address", "unresolved_reason", "catchment_rows")
        .orderBy("id")
        .limit(sample)
    )
