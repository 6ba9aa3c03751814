"""Propagate a changed register: only what the change can reach is looked up again.

Two versions of the register are compared tier by tier. A row is reached if the code of one of its
keys differs between them; every other row would get the same codes again, and a restamp leaves
it as it is. An institution is reached if an address of its catchment got another code, or if its
own address is one that the change reaches.

The tables must be as a restamp by the old register leaves them: then applying the changes gives
what a restamp of all rows by the new one gives.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.operators.joins import lookup_join
from kvartal.operators.lookup import TIER, Tiers, stamp_by_tiers, stamp_institutions
from kvartal.operators.standardise import parse_one_line_addresses
from kvartal.schemas import LOCALITY_PREFIXES
from kvartal.session import materialise

EMPTY_IF_NULL = ("number_suffix", "entrance")
BEFORE = "before"


def changed_keys(old: Tiers, new: Tiers) -> tuple[DataFrame, ...]:
    """Per tier the keys whose code differs. A key that is missing finds nothing, like one without
    an agreed code; keys with a NULL part find nothing in either version."""
    if old.keys != new.keys:
        raise ValueError(f"tiers differ: {old.keys} and {new.keys}")
    changed = []
    for keys, before, after in zip(old.keys, old.tables, new.tables):
        both = before.withColumnRenamed("_code", "_old").join(
            after.withColumnRenamed("_code", "_new"), list(keys), "full_outer"
        )
        changed.append(materialise(both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys), "changed-keys"))
    return tuple(changed)


def leading(changed: Sequence[DataFrame], tiers: Tiers) -> DataFrame:
    """The leading keys (streets) under which any key changed."""
    (lead, *_), = {keys[:1] for keys in tiers.keys}
    return reduce(DataFrame.unionByName, (keys.select(lead) for keys in changed)).distinct()


def reached(
    target: DataFrame, changed: Sequence[DataFrame], tiers: Tiers, empty_if_null: Sequence[str] = EMPTY_IF_NULL
) -> DataFrame:
    """The rows one of whose keys changed.

    Rows under an untouched leading key are left out first, by one join with few keys.
    """
    kinds = dict(tiers.tables[0].dtypes)
    lead = tiers.keys[0][0]
    few = lookup_join(target, leading(changed, tiers).withColumn("_lead", F.lit(True)), [lead], "inner").drop("_lead")
    on = {}
    for key in tiers.keys[0]:
        column = F.coalesce(F.col(key), F.lit("")) if key in empty_if_null else F.col(key)
        on[f"_k_{key}"] = column.cast(kinds[key])
    for n, (keys, table) in enumerate(zip(tiers.keys, changed)):
        names = [f"_k_{k}" for k in keys]
        marked = table.toDF(*names).withColumn(f"_c{n}", F.lit(True))
        few = lookup_join(few, marked, names, on={k: on[k] for k in names})
    hit = reduce(lambda a, b: a | b, (F.col(f"_c{n}").isNotNull() for n in range(len(changed))))
    return few.where(hit).select(*target.columns)


def restamp_reached(
    target: DataFrame, old: Tiers, new: Tiers, empty_if_null: Sequence[str] = EMPTY_IF_NULL,
    changed: Sequence[DataFrame] | None = None,
) -> DataFrame:
    """The reached rows with their code by the new version, ``before`` and ``tier``."""
    changed = changed_keys(old, new) if changed is None else changed
    rows = reached(target, changed, new, empty_if_null).withColumn(BEFORE, F.col(new.value))
    return stamp_by_tiers(rows, new, empty_if_null, restamp=True)


def address_changes(
    addresses: DataFrame, streets: DataFrame, old: Tiers, new: Tiers, changed: Sequence[DataFrame]
) -> DataFrame:
    """``id, district_code, before, tier`` of the addresses that the change reaches.

    Addresses of other streets are not looked at: streets are matched first.
    """
    names = streets.select(F.col("id").alias("street_id"), "search_norm")
    few = lookup_join(names, leading(changed, new).withColumn("_lead", F.lit(True)), ["search_norm"], "inner")
    located = addresses.join(few.drop("_lead"), "street_id")
    return restamp_reached(located, old, new, changed=changed).select("id", "district_code", BEFORE, TIER)


def institution_changes(
    institutions: DataFrame, edges: DataFrame, addresses: DataFrame, changes: DataFrame,
    new: Tiers, changed: Sequence[DataFrame], localities=LOCALITY_PREFIXES,
) -> DataFrame:
    """The institutions that the change can reach, stamped again, with ``before``.

    ``addresses`` are those before the change, ``changes`` what became of some of them. Votes are
    counted for reached institutions alone, over all their edges.
    """
    moved = changes.where(~F.col(BEFORE).eqNullSafe(F.col("district_code")))
    by_votes = edges.join(moved.select(F.col("id").alias("address_id")), "address_id", "left_semi").select(
        F.col("institution_id").alias("id")
    )
    parsed = parse_one_line_addresses(
        institutions.where((F.col("kind") != "nursery") & F.col("address").isNotNull()).select("id", "address"),
        "address", localities,
    ).where(F.col("parse_reason").isNull())
    by_address = reached(parsed, changed, new).select("id")
    ids = materialise(by_votes.unionByName(by_address).distinct(), "reached-institutions")
    few = institutions.join(ids, "id", "left_semi")
    # Read twice: for the addresses and for the votes.
    own = materialise(
        edges.join(ids.withColumnRenamed("id", "institution_id"), "institution_id", "left_semi"), "reached-edges"
    )
    now = _applied(
        addresses.select("id", "district_code").join(
            own.select(F.col("address_id").alias("id")).distinct(), "id", "left_semi"
        ),
        moved,
    )
    before = few.select("id", F.col("district_code").alias(BEFORE))
    return stamp_institutions(few, own, now, new, restamp=True, localities=localities).join(before, "id")


def _applied(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows with the changed codes; a restamp never clears one."""
    new = changes.select("id", F.col("district_code").alias("_now"))
    return lookup_join(rows, new, ["id"]).withColumn("district_code", F.coalesce("_now", "district_code")).drop("_now")


def apply_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """A whole table with the changed rows' codes, ready to be written."""
    return _applied(rows, changes.where(~F.col(BEFORE).eqNullSafe(F.col("district_code")))).select(*rows.columns)


def restamp_counts(changes: DataFrame) -> DataFrame:
    """One row: ``reached, moved``."""
    return changes.agg(
        F.count("*").alias("reached"),
        F.count_if(~F.col(BEFORE).eqNullSafe(F.col("district_code"))).alias("moved"),
    )
