"""Contiguous shards of near equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvartal.llm.common import over_parts, placed

SHARDS = 16


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Cut the documents, in order of ``doc_id``, into ``shards`` runs of near equal size.

    A document's size is its UTF-8 bytes plus one (a null text has none). The slim rows are
    range-sorted and written; each partition's total gives the sizes before it, a running sum
    the rest. A document belongs to the target its middle byte falls in, so a shard is off its
    target by at most one document at either end. No key groups rows, so none can be hot.

    Null ids come last; equal ids are ordered by checksum and size, and identical rows
    are interchangeable. An empty table gives no rows. Columns other than doc_id and text
    are not read. Result: doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = placed(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        [F.col("doc_id").asc_nulls_last(), "text_crc32", "size"],
        "shard-order",
    )
    totals, before = over_parts(
        rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    )
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = (
        rows.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn("_middle", 2 * start + F.col("size"))
        .withColumn("shard", F.expr(f"int(least({shards - 1}, (_middle * {shards}) div (2 * _total)))"))
        .withColumn("_position", F.col("_rows_before") + F.col("_row"))
        .select("doc_id", "size", "text_crc32", "shard", "_position")
    )
    firsts = cut.groupBy("shard").agg(F.min("_position").alias("_first"))
    return (
        cut.join(F.broadcast(firsts), "shard")  # one row per shard
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_position") - F.col("_first")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
