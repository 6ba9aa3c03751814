"""Merge a batch into a table kept in parts, rewriting the parts it changes and no others."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.operators import merge
from kvartal.operators.merge import MergePolicy
from kvartal.session import materialise
from kvartal.sources.tables import Tables


class Merged(NamedTuple):
    """Folders to publish, the merged rows of the parts the batch meets, and how many parts there are:
    met by the batch, written, and in all."""

    parts: dict[str, str]
    rows: DataFrame
    met: int
    written: int
    total: int


def key_range(column: str, width: int) -> Column:
    """Number of the range of ``width`` keys that a key lies in: rows with near keys are kept together."""
    return F.floor(F.col(column) / width).cast("long")


def upsert_parts(
    tables: Tables, name: str, incoming: DataFrame, policy: MergePolicy, part: Column, schema: T.StructType
) -> Merged:
    """What ``merge_upsert`` does to the whole table, in the parts that the batch's keys lie in.

    ``part`` is a function of the key, over columns that both sides have. Only the parts of the
    batch are read, and of these only the ones with a row that differs are written: a batch
    that repeats what is stored writes nothing. The other parts keep their folders. What
    reaches the driver are numbers of parts.
    """
    held = tables.parts(name)
    numbers = lambda df: [str(r.part) for r in df.select(part.cast("string").alias("part")).distinct().collect()]
    met = numbers(incoming)
    existing = tables.read_parts(name, schema, met)
    merged = materialise(merge.merge_upsert(existing, incoming, policy, dirty=True), f"{name}-parts")
    changed = numbers(merged.where(merge.DIRTY))
    staged = {}
    if changed:
        rows = merged.where(part.cast("string").isin(changed))
        staged = tables.stage_parts(name, rows, part, schema)
    parts = {**held, **staged}
    return Merged(parts, merged.drop(merge.DIRTY), len(met), len(staged), len(parts))
