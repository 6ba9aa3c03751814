"""Exact duplicates by a distributed content sort and comparison of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvartal.llm.common import over_parts
from kvartal.operators.joins import lookup_join
from kvartal.session import materialise

SPACE = "[\\x20\\x09-\\x0D]+"
# Characters of a text that its place in the order starts with.
LEAD = 32


def normalise(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _runs(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """Sort by content over the cluster and mark where neighbours differ.

    Spark samples the splitters of the range partitioning. They hold the start of a text, its
    checksum and its id, so their size is bounded, neither a long common start nor a group of
    copies can stay unsplit, and equal texts are neighbours in the full order. Per row:
    _part, _run (number of the run of equal texts inside the partition), _starts, _id,
    _sha, and _edge: the text itself, for the first and the last row of a partition.
    """
    place = [F.col("_lead"), F.col("_check"), F.col("_id").asc_nulls_last()]
    order = [F.col("_lead"), F.col("_check"), F.col("_norm"), F.col("_id").asc_nulls_last()]
    in_part = Window.partitionBy("_part").orderBy(*order)
    before, after = F.lag("_norm").over(in_part), F.lead("_norm").over(in_part)
    starts = F.coalesce(before != F.col("_norm"), F.lit(True))
    return (
        docs.select(
            F.col("doc_id").alias("_id"), normalise(F.col("text")).alias("_norm"), *carried
        )
        .withColumn("_lead", F.substring("_norm", 1, LEAD))
        .withColumn("_check", F.xxhash64("_norm"))
        .repartitionByRange(*place)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_starts", starts)
        .withColumn("_head", before.isNull())
        .withColumn("_tail", after.isNull())
        .withColumn(
            "_run",
            F.sum(F.col("_starts").cast("long")).over(
                in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
    )


def _stitched(rows: DataFrame) -> DataFrame:
    """One row per partition: _joins (its first text equals the last one before it), runs' chains.

    Full texts of neighbouring partitions' edges are compared by a join on the partition's
    number; only slim rows, one per partition, are ever put in one order.
    """
    heads = rows.where("_head").select("_part", F.col("_edge").alias("_first_text"))
    tails = rows.where("_tail").select("_part", F.col("_edge").alias("_last_text"), F.col("_run").alias("_last_run"))
    parts, _ = over_parts(tails.select("_part", "_last_run"))
    neighbours = parts.withColumn("_before", F.lag("_part").over(Window.orderBy("_part")))
    return (
        neighbours.join(heads, "_part")
        .join(tails.select(F.col("_part").alias("_before"), "_last_text"), "_before", "left")
        .select(
            "_part", "_last_run",
            F.coalesce(F.col("_first_text") == F.col("_last_text"), F.lit(False)).alias("_joins"),
        )
    )


def _marked(docs: DataFrame, carried: list[Column], keep: list[Column], only_starts: bool) -> DataFrame:
    marked = _runs(docs, carried)
    if only_starts:
        marked = marked.where("_starts OR _tail")
    return materialise(
        marked.select(
            "_part", "_run", "_starts", "_head", "_tail", "_id",
            F.when(F.col("_head") | F.col("_tail"), F.col("_norm")).alias("_edge"), *keep,
        ),
        "content-order",
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """For every row its group of equal normalised texts: doc_id, keep_id, group_size, kept, text_sha256.

    Kept is the row with the smallest doc_id. Null texts are empty texts. Null ids come last: a
    group of nothing else keeps one of them, with a null keep_id. Of rows with the same id and
    text, one is kept. An empty table gives no rows. Only doc_id and text are read.
    """
    rows = _marked(docs, [], [F.sha2("_norm", 256).alias("text_sha256")], only_starts=False)
    parts = _stitched(rows)
    # Heads and tails of partitions in order; a chain of equal texts ends where a break comes.
    ends = parts.select(
        "_part", "_joins", "_last_run",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("_end"),
    ).select(
        "_part", "_end", F.when(F.col("_end") == 0, F.lit(1)).otherwise(F.col("_last_run")).alias("_run"),
        F.when(F.col("_end") == 0, ~F.col("_joins")).otherwise(F.col("_last_run") > 1).alias("_breaks"),
    )
    chains = (
        ends.withColumn(
            "_chain",
            F.sum(F.col("_breaks").cast("long")).over(
                Window.orderBy("_part", "_end").rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .groupBy("_part", "_run").agg(F.min("_chain").alias("_chain"))
    )
    runs = rows.groupBy("_part", "_run").agg(
        F.min("_id").alias("_keep"), F.count("*").alias("_size")
    )
    linked = runs.join(F.broadcast(chains), ["_part", "_run"], "left")  # two rows per partition
    whole = (
        linked.where("_chain IS NOT NULL").groupBy("_chain")
        .agg(F.min("_keep").alias("_chain_keep"), F.sum("_size").alias("_chain_size"))
    )
    groups = linked.join(F.broadcast(whole), "_chain", "left").select(
        "_part", "_run",
        F.when(F.col("_chain").isNull(), F.col("_keep")).otherwise(F.col("_chain_keep")).alias("keep_id"),
        F.coalesce("_chain_size", "_size").alias("group_size"),
    )
    joined = F.broadcast(parts.select("_part", "_joins"))
    return (
        lookup_join(rows, groups, ["_part", "_run"]).join(joined, "_part")
        .select(
            F.col("_id").alias("doc_id"), "keep_id", "group_size",
            (F.col("_starts") & ~(F.col("_joins") & (F.col("_run") == 1))).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The kept rows of ``exact_groups`` with all their columns, whatever their names.

    The texts travel once: beside the normalised text goes the original only where they differ.
    """
    rest = [c for c in docs.columns if c != "text"]
    norm = normalise(F.col("text"))
    same = F.col("text").eqNullSafe(norm)
    carried = [
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"),
        same.alias("_same"),
        F.when(~same, F.col("text")).alias("_own"),
    ]
    keep = [
        F.when(F.col("_starts"), F.col("_rest")).alias("_rest"),
        F.when(F.col("_starts"), F.when(F.col("_same"), F.col("_norm")).otherwise(F.col("_own"))).alias("_text"),
    ]
    rows = _marked(docs, carried, keep, only_starts=True)
    parts = F.broadcast(_stitched(rows).select("_part", "_joins"))  # one row per partition
    kept = rows.where("_starts").join(parts, "_part").where("NOT (_joins AND _run = 1)")
    return kept.select(
        *(F.col("_text").alias(c) if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns)
    )
