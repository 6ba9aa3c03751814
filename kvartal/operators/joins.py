"""Join forms shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_on(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality in which NULL equals NULL, for the aliases ``left`` and ``right``."""
    return reduce(
        Column.__and__,
        (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys),
    )


def lookup_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", on: dict[str, Column] | None = None
) -> DataFrame:
    """Join rows to an aggregate that has one row per key, safe for hot and NULL keys.

    An aggregate already sits on its key's partitioning, and AQE splits a skewed partition
    only where both join sides are fresh shuffles. A hash of the key as a further join
    condition makes Spark shuffle the (small, aggregated) table once more, so the hot side can
    be split; a table that proves small at run time is still broadcast. The hash is compared, not
    carried: it does not compress. ``on`` gives, for keys that are no columns of the rows, what they
    are there.
    """
    on = {k: F.col(f"l.`{k}`") for k in keys} | (on or {})
    left, right = rows.alias("l"), table.alias("r")
    kinds, table_kinds = dict(left.select(*(on[k].alias(k) for k in keys)).dtypes), dict(table.dtypes)
    unlike = [k for k in keys if kinds[k] != table_kinds[k]]
    if unlike:  # equal numbers of unlike types hash differently
        raise TypeError(f"key types differ: {unlike}")
    same = reduce(Column.__and__, (on[k] == F.col(f"r.`{k}`") for k in keys))
    hashed = F.xxhash64(*(on[k] for k in keys)) == F.xxhash64(*(F.col(f"r.`{k}`") for k in keys))
    return left.join(right, same & hashed, how).select(
        *(F.col(f"l.`{c}`") for c in rows.columns), *(F.col(f"r.`{c}`") for c in table.columns if c not in keys)
    )
