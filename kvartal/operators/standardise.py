"""Standardise streets and numbers; rejects go to a side table with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.functions.addresses import (
    NUMBER_TEMPS, STREET_TEMPS, add_steps, code_by_prefix, house_number_steps, last_word_steps,
    street_steps,
)
from kvartal.functions.text import search_key
from kvartal.operators.joins import lookup_join
from kvartal.schemas import LOCALITY_PREFIXES, PREFIX_CODES

REASON = "reject_reason"
ADDRESS_KEY = ("search_norm", "number_int", "number_suffix", "entrance")


def standardise_numbers(df: DataFrame, column: str = "number") -> DataFrame:
    """Add ``number_int, number_suffix, entrance, reject_reason``."""
    return (
        add_steps(df, *house_number_steps(F.col(column)))
        .withColumn(REASON, F.col("_number_reason"))
        .drop(*NUMBER_TEMPS)
    )


def standardise_streets(df: DataFrame, column: str = "street", localities=LOCALITY_PREFIXES) -> DataFrame:
    """Add ``city, type_marker, street_part, search_norm, raw_name, reject_reason``."""
    return (
        add_steps(df, *street_steps(F.col(column), localities))
        .withColumn(REASON, F.when(F.col("_base").isNull(), "unknown_locality"))
        .drop(*STREET_TEMPS)
    )


def standardise_entries(
    df: DataFrame, street: str = "street", number: str = "number", localities=LOCALITY_PREFIXES
) -> DataFrame:
    """Both of the above; a bad locality is reported before a bad number.

    Entries are many and streets few: each distinct street is taken apart once, and its parts
    are joined back. The numbers' patterns stay above that join.
    """
    streets = standardise_streets(df.select(street).distinct(), street, localities)
    parts = [c for c in streets.columns if c not in (street, REASON)]
    known = streets.where(F.col(REASON).isNull()).select(street, *parts)
    joined = lookup_join(df, known, [street])
    return (
        add_steps(joined, *house_number_steps(F.col(number)))
        .withColumn(
            REASON,
            F.when(F.col("raw_name").isNull(), "unknown_locality").otherwise(F.col("_number_reason")),
        )
        .drop(*NUMBER_TEMPS)
    )


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col(REASON).isNull()).drop(REASON)


def quarantined(df: DataFrame) -> DataFrame:
    return df.where(F.col(REASON).isNotNull())


def quarantine_counts(df: DataFrame) -> DataFrame:
    """Skipped rows by reason."""
    return quarantined(df).groupBy(REASON).agg(F.count("*").alias("skipped_rows"))


def add_search_key(df: DataFrame, column: str, name: str = "search_norm") -> DataFrame:
    return df.withColumn(name, search_key(F.col(column)))


def parse_one_line_addresses(
    df: DataFrame, column: str = "address", localities=LOCALITY_PREFIXES
) -> DataFrame:
    """Add the look-up key of a one-line address and ``parse_reason``.

    ``no_address`` (NULL or empty), ``parse_failed`` (no space, bad head or bad tail), or
    NULL when it parsed. The key columns are NULL unless it parsed.
    """
    text = F.col(column)
    reason = F.when(F.coalesce(text, F.lit("")) == "", "no_address").when(
        F.col("_base").isNull() | F.col("number_int").isNull(), "parse_failed"
    )
    parsed = add_steps(
        df, *last_word_steps(text), *street_steps(F.col("_head"), localities),
        *house_number_steps(F.col("_tail")), {"parse_reason": reason},
    )
    good = F.col("parse_reason").isNull()
    return parsed.select(
        *df.columns, *(F.when(good, F.col(k)).alias(k) for k in ADDRESS_KEY), "parse_reason"
    )


def classify_by_prefix(
    df: DataFrame, column: str, prefixes=PREFIX_CODES, name: str = "settlement_code"
) -> DataFrame:
    """Code of the first matching prefix. The prefixes are constants, so no join is needed."""
    return df.withColumn(name, code_by_prefix(F.col(column), prefixes))
