"""The weekly batch: snapshot to merged, stamped and published tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal import schemas
from kvartal.operators import contract, dedupe, lookup, merge, numbering, standardise
from kvartal.session import materialise
from kvartal.sources import snapshot, split_json
from kvartal.sources.tables import Tables

STREET_KEY = ("raw_name",)
ADDRESS_KEY = ("raw_name", "number_int", "number_suffix", "entrance")
INSTITUTION_KEY = ("external_id", "kind")


@dataclass(frozen=True)
class Batch:
    """A snapshot as de-duplicated rows with natural keys."""

    institutions: DataFrame
    streets: DataFrame
    addresses: DataFrame
    edges: DataFrame
    quarantine: DataFrame
    address_null: DataFrame


def plan_batch(docs: DataFrame, localities=schemas.LOCALITY_PREFIXES) -> Batch:
    """Explode, standardise, quarantine and de-duplicate the documents ``doc, raw``.

    The documents are parsed once and the entries standardised once; both are written, since
    several tables are built from each. Streets are taken apart after they are distinct.
    """
    occurrences = materialise(
        snapshot.institutions(snapshot.raw_institutions(docs)), "occurrences"
    )
    rows = occurrences.select(
        *INSTITUTION_KEY, "name", "source_url", "address", "district_code", "has_infant_group",
        F.col("scraped_at").alias("last_seen_at"), "doc", "inst_pos",
    )
    entries = materialise(
        standardise.standardise_entries(
            snapshot.explode_entries(occurrences), localities=localities
        ).select(
            *INSTITUTION_KEY, "street", "number", *ADDRESS_KEY, standardise.REASON
        ),
        "entries",
    )
    good = standardise.accepted(entries)
    streets = standardise.standardise_streets(
        good.select(F.col("raw_name").alias("street")).distinct(), localities=localities
    )
    return Batch(
        institutions=dedupe.dedupe_last_wins(
            rows, INSTITUTION_KEY, ("last_seen_at", "doc", "inst_pos")
        ).drop("doc", "inst_pos"),
        streets=streets.drop("street", standardise.REASON),
        addresses=good.select(*ADDRESS_KEY).distinct(),
        edges=dedupe.distinct_edges(good, ADDRESS_KEY, INSTITUTION_KEY),
        quarantine=standardise.quarantined(entries),
        address_null=dedupe.null_count(rows, "address", "address_null"),
    )


def _with_ids(merged: DataFrame, existing: DataFrame, order) -> DataFrame:
    """Ids for the inserted rows of a merge; all others keep theirs."""
    fresh = merged.where(F.col(merge.CHANGE) == "inserted").drop("id")
    kept = merged.where(F.col(merge.CHANGE) != "inserted")
    return kept.unionByName(numbering.assign_ids(fresh, existing, order))


def _null_order(keys) -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in keys]


def upsert(
    existing: dict[str, DataFrame], batch: Batch, write: Callable[[DataFrame, str], DataFrame] = materialise
) -> dict[str, DataFrame]:
    """Merge a batch into the four tables; each result still carries ``change``.

    Merges and the numbers of the inserted rows are written, which fixes the ids; institutions and
    addresses are put together from them by whoever reads them. ``write`` writes the two tables
    that are final here, streets and edges, and reads them back.
    """
    institutions = _with_ids(
        materialise(
            merge.merge_upsert(existing["institutions"], batch.institutions, merge.INSTITUTIONS),
            "institutions-merge",
        ),
        existing["institutions"], _null_order(INSTITUTION_KEY),
    )
    streets = write(_with_ids(
        materialise(
            merge.merge_upsert(existing["streets"], batch.streets, merge.STREETS), "streets-merge"
        ),
        existing["streets"], _null_order(STREET_KEY),
    ), "streets")
    addresses = _with_ids(
        materialise(
            merge.merge_upsert(
                existing["addresses"],
                merge.resolve_addresses(batch.addresses, streets), merge.ADDRESSES,
            ),
            "addresses-merge",
        ),
        existing["addresses"], _null_order(merge.ADDRESSES.key),
    )
    edges = write(
        merge.merge_upsert(
            existing["address_institutions"],
            merge.resolve_edges(batch.edges, streets, addresses, institutions), merge.EDGES,
        ),
        "address_institutions",
    )
    return {
        "institutions": institutions, "streets": streets, "addresses": addresses,
        "address_institutions": edges,
    }


def summarise(
    merged: dict[str, DataFrame], batch: Batch, stamped_addresses: DataFrame,
    stamped_institutions: DataFrame, scraped_at: Column,
) -> DataFrame:
    """All counters of the run: ``section, metric, value``."""
    return merge.run_summary({
        **{name: merge.change_counts(df) for name, df in merged.items()},
        "run": batch.address_null,
        "skipped": batch.quarantine.agg(F.count("*").alias("skipped_rows")),
        "disappeared": merge.disappeared(merged["institutions"], scraped_at).agg(
            F.count("*").alias("institutions_disappeared")
        ),
        "addresses_district": lookup.tier_counts(stamped_addresses),
        "addresses_settlement": stamped_addresses.agg(
            F.count_if("settlement_stamped").alias("settlement_stamped")
        ),
        "institutions_district": lookup.stamp_counts(stamped_institutions),
    })


def ingest(
    spark: SparkSession, snapshot_path: str, root: str, lines: bool = False, split: bool = False
) -> DataFrame:
    """Validate, merge, stamp and publish one snapshot; returns the run summary.

    A file is one JSON document, or one per line if ``lines``; with ``split`` one document of any
    size, read by many tasks. Nothing is published unless every step succeeds.
    """
    if split:
        read = split_json.read_snapshot_splits
    else:
        read = snapshot.read_snapshot_lines if lines else snapshot.read_snapshots
    docs = materialise(read(spark, snapshot_path), "snapshot")
    contract.require_valid(docs)
    return ingest_documents(docs, root)


def ingest_documents(docs: DataFrame, root: str) -> DataFrame:
    """``ingest`` for valid documents ``doc, raw``; of equal times the last ``doc`` wins."""
    tables = Tables(docs.sparkSession, root)
    existing = {name: tables.read(name, schema) for name, schema in schemas.TABLES.items()}
    staged: dict[str, str] = {}

    def write(df: DataFrame, name: str) -> DataFrame:
        staged[name], rows = tables.stage_and_read(name, df, schemas.TABLES[name])
        return rows

    batch = plan_batch(docs)
    merged = upsert(existing, batch, write)
    register = lookup.build_tiers(existing["register"])
    addresses = write(
        lookup.stamp_addresses(merged["addresses"].drop(merge.CHANGE), merged["streets"], register),
        "addresses",
    )
    institutions = write(
        lookup.stamp_institutions(
            merged["institutions"].drop(merge.CHANGE), merged["address_institutions"], addresses,
            register,
        ),
        "institutions",
    )
    scraped_at = snapshot.envelopes(docs).agg(F.max("scraped_at")).first()[0]
    summary = materialise(
        summarise(merged, batch, addresses, institutions, F.lit(scraped_at)), "summary"
    )
    # What this snapshot's entries lost, with institution and reason.
    tables.publish({**staged, "quarantine": tables.stage("quarantine", batch.quarantine)})
    return summary
