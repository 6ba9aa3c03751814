"""De-duplication by key. All are partial aggregates, so a hot key shrinks before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def dedupe_last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; NULL key parts are equal."""
    return _keep(df, keys, order, F.max_by)


def dedupe_first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; NULL key parts are equal."""
    return _keep(df, keys, order, F.min_by)


def distinct_edges(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    return df.select(*left, *right).distinct()


def null_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with a NULL, counted before any de-duplication."""
    return df.agg(F.count_if(F.col(column).isNull()).alias(name))
