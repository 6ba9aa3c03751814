"""Carry the last seen value down an ordered file, without one task reading the whole file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 16  # rows of one run: at most 2**16 places
SPAN_BITS = 10  # runs of one span: at most 2**10


def _lasts(names: Sequence[str], at: Column) -> list[Column]:
    """Per group the non-NULL value of each name that comes last by ``at``."""
    return [F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in names]


def _before(names: Sequence[str], partition: Sequence[str], order: Sequence[str]) -> list[Column]:
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return [F.last(n, ignorenulls=True).over(window).alias(f"_in{n}") for n in names]


def _reaching(runs: DataFrame, group: str, chunk: Sequence[str], names: list[str]) -> DataFrame:
    """Per run the values that reach it from the runs before, as ``_in`` columns.

    Runs are gathered into spans first, so that a whole group's window holds one row per span.
    """
    span = [*chunk[:-1], "_span"]
    runs = runs.withColumn("_span", F.shiftright(chunk[-1], SPAN_BITS))
    spans = runs.groupBy(group, *span).agg(*_lasts(names, F.struct(*chunk)))
    reached = spans.select(group, *span, *_before(names, [group], span))
    inner = runs.select(group, *span, chunk[-1], *_before(names, [group, *span], chunk[-1:]))
    return (
        inner.alias("i")
        .join(reached.alias("r"), [group, *span])
        .select(
            group, *chunk,
            *(F.coalesce(F.col(f"i._in{n}"), F.col(f"r._in{n}")).alias(f"_in{n}") for n in names),
        )
    )


def carry_forward(
    rows: DataFrame,
    group: str,
    place: Sequence[str],
    chunk: Sequence[str],
    values: dict[str, Column],
) -> DataFrame:
    """Add, per name in ``values``, the last non-NULL value at or before each row.

    ``place`` orders the rows of a ``group``; ``chunk`` columns, the last of them a number, cut
    that order into runs of bounded size and sort like it. Each run is first reduced to its
    last values, those few rows are carried along the group, and each run then starts from
    what reached it. Only the rows of a run, never of a whole group, are sorted together.
    """
    names = [f"_v_{name}" for name in values]
    marked = rows.withColumns(dict(zip(names, values.values())))
    runs = marked.groupBy(group, *chunk).agg(*_lasts(names, F.struct(*place)))
    inside = Window.partitionBy(group, *chunk).orderBy(*place).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return marked.join(_reaching(runs, group, chunk, names), [group, *chunk]).select(
        *rows.columns,
        *(
            F.coalesce(F.last(n, ignorenulls=True).over(inside), f"_in{n}").alias(name)
            for n, name in zip(names, values)
        ),
    )
