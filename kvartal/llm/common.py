"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvartal.operators.numbering import ROW_BITS
from kvartal.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def placed(df: DataFrame, order: list[Column | str], label: str) -> DataFrame:
    """Range-sort ``df`` and write it, with the partition (``_part``) and row (``_row``) of each row.

    Both numbers are fixed by the written table, so later passes agree on them.
    """
    sorted_rows = materialise(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), label
    )
    return (
        sorted_rows.withColumn("_part", F.shiftright("_place", ROW_BITS))
        .withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        .drop("_place")
    )


def over_parts(totals: DataFrame) -> tuple[DataFrame, Window]:
    """Frame with one row per partition of a sorted table, and the window over what precedes it.

    The only window without a key: its rows are partitions, never data.
    """
    return totals, Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
