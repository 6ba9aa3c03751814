"""Merge a batch into a table by natural key, and account for every change."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.operators.joins import null_safe_on

CHANGE = "change"
CHANGES = ("inserted", "updated", "unchanged")
RETAINED = "retained"


@dataclass(frozen=True)
class MergePolicy:
    """What an incoming row does to the stored row of the same key.

    ``overwrite`` columns take the new value, even NULL. ``prefer_new`` columns take it
    unless it is NULL. All other columns keep the stored value and are only filled on
    insert. ``compare`` columns decide between updated and unchanged; a NULL in a
    ``prefer_new`` column is no change.
    """

    key: tuple[str, ...]
    overwrite: tuple[str, ...] = ()
    prefer_new: tuple[str, ...] = ()
    compare: tuple[str, ...] = ()


INSTITUTIONS = MergePolicy(
    key=("external_id", "kind"),
    overwrite=("name", "source_url", "address", "has_infant_group", "last_seen_at"),
    prefer_new=("district_code",),
    compare=("name", "source_url", "address", "district_code", "has_infant_group"),
)
STREETS = MergePolicy(key=("raw_name",), overwrite=("search_norm",), compare=("search_norm",))
ADDRESSES = MergePolicy(key=("street_id", "number_int", "number_suffix", "entrance"))
EDGES = MergePolicy(key=("address_id", "institution_id"))


def _new(name: str) -> Column:
    return F.col(f"new.{name}")


def _old(name: str) -> Column:
    return F.col(f"old.{name}")


def classify_changes(policy: MergePolicy) -> Column:
    """Change label over the aliases ``old`` and ``new`` of a full outer join."""
    same = [
        (_new(c).isNull() if c in policy.prefer_new else F.lit(False)) | _new(c).eqNullSafe(_old(c))
        for c in policy.compare
    ]
    unchanged = reduce(Column.__and__, same, F.lit(True))
    return (
        F.when(_new("_there").isNull(), RETAINED)
        .when(_old("_there").isNull(), "inserted")
        .when(unchanged, "unchanged")
        .otherwise("updated")
    )


DIRTY = "dirty"


def merge_upsert(
    existing: DataFrame, incoming: DataFrame, policy: MergePolicy, dirty: bool = False
) -> DataFrame:
    """All rows of the merged table plus ``change``; stored rows not in the batch are kept.

    Keys are unique on both sides, NULL key parts are equal. Columns absent from the batch
    (ids, derived codes) are NULL on inserted rows. A policy without value columns only
    inserts. One join, hence one shuffle of either side, serves the merge and its counts.
    ``dirty`` adds whether any stored value differs, also one that is no change by the policy.
    """
    old = existing.withColumn("_there", F.lit(True)).alias("old")
    new = incoming.withColumn("_there", F.lit(True)).alias("new")
    joined = old.join(new, null_safe_on("old", "new", policy.key), "full_outer")

    def merged(c: str) -> Column:
        if c not in incoming.columns:
            return _old(c)
        if c in policy.overwrite:
            return F.when(_new("_there").isNotNull(), _new(c)).otherwise(_old(c))
        if c in policy.prefer_new:
            return F.coalesce(_new(c), _old(c))
        return F.when(_old("_there").isNotNull(), _old(c)).otherwise(_new(c))

    written = [c for c in (*policy.overwrite, *policy.prefer_new) if c in incoming.columns]
    moved = reduce(Column.__or__, (~merged(c).eqNullSafe(_old(c)) for c in written), F.lit(False))
    more = [(_new("_there").isNotNull() & (_old("_there").isNull() | moved)).alias(DIRTY)] if dirty else []
    return joined.select(
        *(merged(c).alias(c) for c in existing.columns), classify_changes(policy).alias(CHANGE), *more
    )


def insert_only(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet; stored rows are never touched."""
    return incoming.alias("new").join(
        existing.select(*key).alias("old"), null_safe_on("new", "old", key), "left_anti"
    )


def change_counts(merged: DataFrame) -> DataFrame:
    """One row: ``inserted, updated, unchanged``."""
    return merged.agg(*(F.count_if(F.col(CHANGE) == c).alias(c) for c in CHANGES))


def resolve_addresses(addresses: DataFrame, streets: DataFrame) -> DataFrame:
    """Replace the street's natural key by its id; rows without a street are dropped."""
    ids = streets.select(F.col("id").alias("street_id"), "raw_name")
    return addresses.join(ids, "raw_name").drop("raw_name")


def resolve_edges(
    edges: DataFrame, streets: DataFrame, addresses: DataFrame, institutions: DataFrame
) -> DataFrame:
    """Natural keys of both ends to ``address_id, institution_id``."""
    located = resolve_addresses(edges, streets)
    on_address = null_safe_on("e", "a", ADDRESSES.key)
    insts = institutions.select(F.col("id").alias("institution_id"), *INSTITUTIONS.key)
    return (
        located.alias("e")
        .join(addresses.alias("a"), on_address)
        .select(F.col("a.id").alias("address_id"), *(F.col(f"e.{k}") for k in INSTITUTIONS.key))
        .join(insts, list(INSTITUTIONS.key))
        .select("address_id", "institution_id")
    )


def disappeared(institutions: DataFrame, scraped_at: Column) -> DataFrame:
    """Institutions last seen before this snapshot; they stay in the table."""
    return institutions.where(F.col("last_seen_at") < scraped_at)


def cascade_delete(
    removed_streets: DataFrame,
    removed_institutions: DataFrame,
    streets: DataFrame,
    addresses: DataFrame,
    institutions: DataFrame,
    edges: DataFrame,
) -> dict[str, DataFrame]:
    """Tables without the removed ids and without anything that refers to them."""
    gone = removed_streets.select(F.col("id").alias("street_id"))
    left_addresses = addresses.join(gone, "street_id", "left_anti").select(*addresses.columns)
    gone_addresses = addresses.join(gone, "street_id", "left_semi").select(
        F.col("id").alias("address_id")
    )
    gone_insts = removed_institutions.select(F.col("id").alias("institution_id"))
    return {
        "streets": streets.join(removed_streets.select("id"), "id", "left_anti").select(
            *streets.columns
        ),
        "addresses": left_addresses,
        "institutions": institutions.join(
            removed_institutions.select("id"), "id", "left_anti"
        ).select(*institutions.columns),
        "address_institutions": edges.join(gone_addresses, "address_id", "left_anti")
        .join(gone_insts, "institution_id", "left_anti")
        .select(*edges.columns),
    }


def reset_stamps(
    df: DataFrame, columns: Sequence[str], keep_where: Column | None = None
) -> DataFrame:
    """Clear derived codes, except on rows that meet ``keep_where``."""
    kept = F.coalesce(keep_where, F.lit(False)) if keep_where is not None else F.lit(False)
    return df.withColumns({c: F.when(kept, F.col(c)) for c in columns})


def run_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """Counters of one run in long form: ``section, metric, value``.

    Each part is a one-row table of counters.
    """
    rows = [
        df.select(
            F.lit(section).alias("section"),
            F.explode(
                F.array(*(
                    F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value"))
                    for c in df.columns
                ))
            ).alias("_m"),
        ).select("section", "_m.metric", "_m.value")
        for section, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows)
