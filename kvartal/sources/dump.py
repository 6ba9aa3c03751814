"""Ordered JSON dumps and their content tag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.operators.numbering import Order, with_position


def json_row(columns: Sequence[str]) -> Column:
    """Compact JSON of the named columns, NULLs written out, times in UTC to the microsecond."""
    return F.to_json(F.struct(*columns), {
        "ignoreNullFields": "false", "timeZone": "UTC",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    })


def ordered_dump(df: DataFrame, columns: Sequence[str], order: Order) -> DataFrame:
    """One JSON row per line (``value``), sorted; ready for ``write.text``."""
    return df.orderBy(*order).select(json_row(columns).alias("value"))


def numbered_dump(df: DataFrame, columns: Sequence[str], order: Order) -> DataFrame:
    """The same rows with their place in the dump: ``position, value``."""
    return with_position(df, order).select("position", json_row(columns).alias("value"))


def content_fingerprint(df: DataFrame, columns: Sequence[str], order_name: str) -> DataFrame:
    """One row ``rows, tag``; the tag changes when the dumped content changes.

    The dump's order is total, so its text is a function of the set of rows and of the
    order's name. Row digests can then be added up in any order: no sort, one small row per
    task. The tag has the form ``v1-`` and 16 hex digits, but is not the hash of the dump's
    bytes.
    """
    digest = df.select(F.sha2(json_row(columns), 256).alias("_d"))
    pieces = [
        F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)
    ]
    summed = digest.agg(
        F.count("*").alias("rows"),
        *(F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").alias(f"_s{i}") for i, p in enumerate(pieces)),
    )
    text = F.concat_ws(
        ":", F.lit(order_name), F.col("rows").cast("string"),
        *(F.col(f"_s{i}").cast("string") for i in range(4)),
    )
    return summed.select(
        "rows", F.concat(F.lit("v1-"), F.substring(F.sha2(text, 256), 1, 16)).alias("tag")
    )
