"""Positions in a total order, without one task or group ever holding all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvartal.operators.joins import lookup_join
from kvartal.session import materialise

# monotonically_increasing_id keeps the partition above this bit, the row below it.
ROW_BITS = 33
# Rows that are counted together: 2**16 places.
RUN_BITS = 16

Order = Sequence[Column | str]


def with_position(df: DataFrame, order: Order, name: str = "position") -> DataFrame:
    """Add the 1-based place of each row in ``order``.

    A range sort spreads the rows; each then gets its place inside its partition. The result
    is written once, so that both numbers stay fixed, and the partitions' offsets (one row
    per partition) are broadcast back.
    """
    placed = materialise(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "positions"
    )
    part = F.shiftright("_place", ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part")).count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    row = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + row + 1)
        .drop("_part", "_before", "_place")
    )


def with_group_position(
    df: DataFrame, groups: Sequence[str], order: Order, name: str = "position"
) -> DataFrame:
    """Add the 1-based place of each row inside its group; a group may span many tasks."""
    numbered = with_position(df, [*groups, *order], "_global")
    first = numbered.groupBy(*groups).agg(F.min("_global").alias("_first"))
    return (
        lookup_join(numbered, first, groups)
        .withColumn(name, F.col("_global") - F.col("_first") + 1)
        .drop("_global", "_first")
    )


def with_running_count(rows: DataFrame, counted: Column, name: str, position: str = "position") -> DataFrame:
    """Add how many ``counted`` rows there are up to each row, by its place in the whole order.

    Runs of ``2**RUN_BITS`` places are counted first, so a window holds one run, or one row per run.
    """
    marked = rows.withColumn("_counted", counted.cast("long")).withColumn("_run", F.shiftright(position, RUN_BITS))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = marked.groupBy("_run").agg(F.sum("_counted").alias("_n")).select(
        "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_run").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(runs, "_run").withColumn(name, F.col("_before") + F.sum("_counted").over(inside)).drop(
        "_run", "_before", "_counted"
    )


def assign_ids(
    new_rows: DataFrame, existing: DataFrame, order: Order, id_column: str = "id"
) -> DataFrame:
    """Give each new row a fresh id above every existing one, in ``order``."""
    top = existing.agg(F.max(id_column)).first()[0] or 0
    return with_position(new_rows, order, "_n").withColumn(
        id_column, F.col("_n") + F.lit(top).cast("long")
    ).drop("_n")
