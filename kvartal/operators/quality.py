"""Data-quality reports: one pass and one row per table, then long form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.schemas import (
    CITY_CODE, DISTRICT_CODES, KINDS, LOCALITY_TYPES, MAX_LENGTHS, REGISTER, SETTLEMENT_DIM,
)


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def address_summary(addresses: DataFrame) -> DataFrame:
    district, settlement = F.col("district_code"), F.col("settlement_code")
    return addresses.agg(
        F.count("*").alias("total"),
        _count(district.isNotNull(), "district_known"),
        _count(district.isNull() & settlement.isNotNull(), "settlement_known_no_district"),
        _count(district.isNull() & settlement.isNull(), "no_settlement_no_district"),
        _count(~district.isin(*DISTRICT_CODES), "invalid_district_codes"),
        _count(district.isNull() & (settlement == CITY_CODE), "city_without_district"),
    )


def unknown_settlement_codes(addresses: DataFrame, settlements: DataFrame) -> DataFrame:
    """Number of distinct codes without a settlement row."""
    used = addresses.where(F.col("settlement_code").isNotNull()).select(
        F.col("settlement_code").alias("code")
    ).distinct()
    return used.join(settlements.select("code"), "code", "left_anti").agg(
        F.count("*").alias("unknown_settlement_codes")
    )


def settlement_summary(settlements: DataFrame) -> DataFrame:
    return settlements.agg(
        *(_count(F.col("locality_type") == t, t) for t in LOCALITY_TYPES)
    )


def institution_summary(institutions: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return institutions.agg(
        *(_count(kind == k, k) for k in KINDS),
        _count((kind == "kindergarten") & F.col("has_infant_group"), "infant_group_kindergartens"),
        _count(kind.isNull() | ~kind.isin(*KINDS), "invalid_kinds"),
        _count((kind == "nursery") & F.col("district_code").isNull(), "nursery_without_district"),
    )


def coverage_edge_summary(edges: DataFrame, institutions: DataFrame) -> DataFrame:
    """Edges per institution kind. Edges are counted per institution before the join."""
    per_inst = edges.groupBy(F.col("institution_id").alias("id")).agg(F.count("*").alias("_n"))
    joined = per_inst.join(institutions.select("id", "kind"), "id")
    return joined.agg(
        *(
            F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("_n"))), F.lit(0)).alias(k)
            for k in KINDS
        )
    )


def _long(counters: DataFrame, metrics: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One row of counters to ``severity, metric, value`` rows."""
    return counters.select(
        F.explode(
            F.array(*(
                F.struct(
                    F.lit(severity).alias("severity"), F.lit(name).alias("metric"),
                    value.cast("long").alias("value"),
                )
                for severity, name, value in metrics
            ))
        ).alias("_m")
    ).select("_m.*")


def match_data_report(
    addresses: DataFrame, settlements: DataFrame, institutions: DataFrame, edges: DataFrame
) -> DataFrame:
    """Every counter in long form: ``severity, metric, value``.

    Severities are ``info``, ``warning`` and ``failure``. The metric ``failed`` is 1 when any
    failure counter is above 0; warnings never fail the check.
    """

    def info(counters: DataFrame, prefix: str, leave_out: str = "") -> list:
        return [
            ("info", f"{prefix}_{c}", F.col(c)) for c in counters.columns if c != leave_out
        ]

    def none(name: str) -> Column:
        return F.col(name) == 0

    def failure(name: str, column: str) -> tuple[str, str, Column]:
        return ("failure", name, F.col(column))

    address = address_summary(addresses)
    inst = institution_summary(institutions)
    edge = coverage_edge_summary(edges, institutions)
    settlement = settlement_summary(settlements)
    unknown = unknown_settlement_codes(addresses, settlements)
    rows = reduce(DataFrame.unionByName, [
        _long(address, [
            *info(address, "addresses", leave_out="city_without_district"),
            ("warning", "city_without_district", F.col("city_without_district")),
            failure("no_settlement_no_district_addresses", "no_settlement_no_district"),
            failure("invalid_address_district_codes", "invalid_district_codes"),
        ]),
        _long(settlement, info(settlement, "settlements")),
        _long(unknown, [failure("unknown_settlement_codes", "unknown_settlement_codes")]),
        _long(inst, [
            *info(inst, "institutions"),
            ("warning", "zero_infant_group_kindergartens", none("infant_group_kindergartens")),
            failure("nursery_without_district", "nursery_without_district"),
            failure("invalid_institution_kinds", "invalid_kinds"),
        ]),
        _long(edge, [
            *info(edge, "edges"),
            ("warning", "zero_kindergarten_edges", none("kindergarten")),
            ("warning", "zero_preschool_edges", none("preschool")),
            failure("nursery_coverage_edges", "nursery"),
        ]),
    ])
    # The subtotal of a severity comes with its rows, so that the tables are read once.
    summed = rows.rollup("severity", "metric").agg(F.sum("value").alias("value"))
    total = F.col("metric").isNull()
    return summed.where(~total | (F.col("severity") == "failure")).select(
        "severity", F.when(total, "failed").otherwise(F.col("metric")).alias("metric"),
        F.when(total, (F.col("value") > 0).cast("long")).otherwise(F.col("value")).alias("value"),
    )


def null_rate_report(addresses: DataFrame, limit: float = 0.02) -> DataFrame:
    """Missing codes, and whether too many city addresses lack a district."""
    district, settlement = F.col("district_code"), F.col("settlement_code")
    counted = addresses.agg(
        _count(district.isNull(), "no_district"),
        _count(settlement.isNull(), "no_settlement"),
        F.count("*").alias("total"),
        _count(settlement == CITY_CODE, "city_total"),
        _count((settlement == CITY_CODE) & district.isNull(), "city_no_district"),
    )
    # Compared as whole numbers: no rounding at the limit.
    stale = F.col("city_no_district") * 10_000 > F.col("city_total") * round(limit * 10_000)
    return counted.withColumn("stale", stale)


def duplicate_keys(df: DataFrame, key: Sequence[str], nulls_distinct: bool = False) -> DataFrame:
    """Keys held by more than one row, with the row count."""
    if nulls_distinct:
        df = df.dropna(subset=list(key))
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose reference is set but has no parent."""
    return child.where(F.col(column).isNotNull()).join(
        parent.select(F.col(parent_key).alias(column)), column, "left_anti"
    )


@dataclass(frozen=True)
class TableRules:
    """What the rows of one table must meet.

    ``keys`` are unique; in ``optional_keys`` rows with a NULL part are exempt. ``references``
    name a column and the table whose ``id`` it holds.
    """

    required: tuple[str, ...]
    enums: dict[str, Sequence[str]] = field(default_factory=dict)
    keys: tuple[tuple[str, ...], ...] = ()
    optional_keys: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[str, str], ...] = ()


_DISTRICT = {"district_code": DISTRICT_CODES}
RULES = {
    "institutions": TableRules(
        ("id", "external_id", "name", "kind", "source_url", "has_infant_group", "last_seen_at"),
        {"kind": KINDS, **_DISTRICT}, keys=(("id",), ("external_id", "kind")),
    ),
    "streets": TableRules(
        ("id", "city", "raw_name", "street_part", "search_norm"), keys=(("id",), ("raw_name",)),
    ),
    "addresses": TableRules(
        ("id", "street_id", "number_int"), _DISTRICT, keys=(("id",),),
        optional_keys=(("street_id", "number_int", "number_suffix", "entrance"),),
        references=(("street_id", "streets"),),
    ),
    "address_institutions": TableRules(
        ("address_id", "institution_id"), keys=(("address_id", "institution_id"),),
        references=(("address_id", "addresses"), ("institution_id", "institutions")),
    ),
    # The register may hold a cell more than once.
    "register": TableRules(tuple(f.name for f in REGISTER), _DISTRICT),
    "settlements": TableRules(
        tuple(f.name for f in SETTLEMENT_DIM), {"locality_type": LOCALITY_TYPES}, keys=(("code",),),
    ),
}


def _row_rules(name: str, rules: TableRules) -> list[tuple[str, str, Column]]:
    """Rule, column and breach of the rules that a row meets by itself."""
    return [
        *(("not_null", c, F.col(c).isNull()) for c in rules.required),
        *(("enum", c, ~F.col(c).isin(*values)) for c, values in rules.enums.items()),
        *(("too_long", c, F.length(c) > n) for c, n in MAX_LENGTHS.get(name, {}).items()),
    ]


def _entry(rule: int, key: Column, rows: Column, held: bool = False) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), key.cast("string").alias("key"), rows.cast("long").alias("rows"), F.lit(held).alias("held")
    )


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rule, columns, violations`` for every rule of the given tables (see ``RULES``).

    One scan per table and one shuffle for all rules of all tables: a row says which of its own
    rules it breaks, which keys it holds, which parents it refers to and which it is. These are
    counted per rule and value, so a hot value is one row before it is shuffled.
    """
    listed: list[tuple[str, str, str]] = []  # table, rule, columns; a rule's place is its number

    def number(*rule: str) -> int:
        listed.append(rule)
        return len(listed) - 1

    none = F.lit(None).cast("string")
    entries: dict[str, list[Column]] = {name: [] for name in tables}
    for name in tables:
        rules = RULES[name]
        for rule, column, broken in _row_rules(name, rules):
            entries[name].append(F.when(broken, _entry(number(name, rule, column), none, F.lit(1))))
        for key in rules.keys + rules.optional_keys:
            # JSON leaves NULLs out, so equal texts are equal keys, NULLs included.
            entry = _entry(number(name, "duplicate_key", ",".join(key)), F.to_json(F.struct(*key)), F.lit(1))
            whole = reduce(Column.__and__, (F.col(c).isNotNull() for c in key))
            entries[name].append(F.when(whole, entry) if key in rules.optional_keys else entry)
        for column, parent in rules.references:
            place = number(name, "orphan", column)
            entries[name].append(F.when(F.col(column).isNotNull(), _entry(place, F.col(column), F.lit(1))))
            entries[parent].append(_entry(place, F.col("id"), F.lit(0), held=True))
    found = reduce(DataFrame.unionByName, (
        df.select(F.explode(F.filter(F.array(*entries[name]), lambda e: e.isNotNull())).alias("e")).select("e.*")
        for name, df in tables.items()
    ))
    counted = found.groupBy("rule", "key").agg(F.sum("rows").alias("rows"), F.max("held").alias("held"))
    kinds = F.array(*(F.lit(rule) for _, rule, _ in listed))
    kind = F.get(kinds, F.col("rule"))
    violations = (
        F.when(kind == "duplicate_key", (F.col("rows") > 1).cast("long"))
        .when(kind == "orphan", F.when(F.col("held"), 0).otherwise(F.col("rows"))).otherwise(F.col("rows"))
    )
    summed = counted.groupBy("rule").agg(F.sum(violations).alias("violations"))
    spark = next(iter(tables.values())).sparkSession
    rules = spark.createDataFrame([(i, *rule) for i, rule in enumerate(listed)], "_rule int, table string, rule string, columns string")
    return rules.join(summed.withColumnRenamed("rule", "_rule"), "_rule", "left").select(
        "table", "rule", "columns", F.coalesce("violations", F.lit(0)).alias("violations")
    )
