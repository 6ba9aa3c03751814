"""A content tag as the root of a hash tree over the dump's rows, and which ranges two trees differ in.

Rows are cut into ranges where their own digest says so, not every so many rows: a row that is
added or lost changes its own range and leaves all others as they are. A range's digest is that
of its rows' digests in order; ranges are cut and hashed the same way, level by level, up to one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvartal.operators.numbering import RUN_BITS, Order, with_position, with_running_count
from kvartal.session import materialise
from kvartal.sources.dump import json_row

# A digest that starts like this begins a range: one in 256.
START = "00"


def _starts() -> Column:
    return (F.substring("digest", 1, len(START)) == START) | (F.col("position") == 1)


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``node``, the number of range starts up to each row."""
    return with_running_count(rows, _starts(), "node")


def _lowest(placed: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The ranges of the rows themselves.

    Rows move once, by runs of ``2**RUN_BITS`` places, and get their digests where they arrive: a digest
    is larger than most rows and does not compress. A run is cut into pieces there; only those
    at its ends, which a range of another run may go on with, still hold their rows' digests.
    """
    moved = placed.withColumn("_run", F.shiftright("position", RUN_BITS)).repartition("_run")
    hashed = moved.withColumn("digest", F.sha2(json_row(columns), 256)).withColumn("_start", _starts().cast("long"))
    run = Window.partitionBy("_run")
    passed = run.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    cut = hashed.withColumns({"_piece": F.sum("_start").over(passed), "_starts": F.sum("_start").over(run)})
    listed = F.transform(F.sort_array(F.collect_list(F.struct("position", "digest"))), lambda r: r["digest"])
    ends = F.struct(*key)
    pieces = cut.groupBy("_run", "_piece", "_starts").agg(
        F.count("*").alias("rows"), F.min_by(ends, "position").alias("_first"), F.max_by(ends, "position").alias("_last"),
        F.array_join(listed, "").alias("_digests"),
    )
    whole = (F.col("_piece") > 0) & (F.col("_piece") < F.col("_starts"))
    pieces = materialise(pieces.select(
        "_run", "_piece", "_starts", "rows", F.to_json("_first").alias("first_key"), F.to_json("_last").alias("last_key"),
        F.when(whole, F.sha2("_digests", 256)).alias("digest"), F.when(~whole, F.col("_digests")).alias("_digests"),
    ), "merkle-pieces")
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = pieces.groupBy("_run").agg(F.max("_starts").alias("_n")).select(
        "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    numbered = pieces.join(runs, "_run").withColumn("node", F.col("_before") + F.col("_piece"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("_run", "_digests"))), lambda p: p["_digests"])
    joined = numbered.where(F.col("digest").isNull()).groupBy("node").agg(
        F.sum("rows").alias("rows"), F.min_by("first_key", "_run").alias("first_key"),
        F.max_by("last_key", "_run").alias("last_key"), F.sha2(F.array_join(texts, ""), 256).alias("digest"),
    )
    return numbered.where(F.col("digest").isNotNull()).select(*joined.columns).unionByName(joined)


def _above(rows: DataFrame) -> DataFrame:
    """The ranges of numbered rows: ``node, rows, first_key, last_key, digest``."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("position", "digest"))), lambda r: r["digest"])
    return rows.groupBy("node").agg(
        F.sum("rows").alias("rows"), F.min_by("first_key", "position").alias("first_key"),
        F.max_by("last_key", "position").alias("last_key"), F.sha2(F.array_join(listed, ""), 256).alias("digest"),
    )


def merkle_tree(df: DataFrame, columns: Sequence[str], order: Order, key: Sequence[str]) -> DataFrame:
    """``level, node, parent, rows, first_key, last_key, digest`` of all ranges, level 1 over the rows.

    The digests depend on the rows' dumped columns and their order alone: not on partitions,
    nor on anything else in the table. ``key`` names the columns that tell a range's ends. The
    order must be total, over dumped and key columns. The last level has one node, its parent is 0; an empty table has none.
    """
    placed = with_position(df.select(*dict.fromkeys([*columns, *key])), order)
    levels, level = [], 1
    nodes = materialise(_lowest(placed, columns, key), "merkle")
    while nodes.count() > 1:
        numbered = _numbered(nodes.withColumnRenamed("node", "position"))
        levels.append(numbered.select(
            F.lit(level).alias("level"), F.col("position").alias("node"), F.col("node").alias("parent"), "rows", "first_key", "last_key", "digest"
        ))
        nodes, level = materialise(_above(numbered), "merkle"), level + 1
    levels.append(nodes.select(
        F.lit(level).alias("level"), "node", F.lit(0).cast("long").alias("parent"), "rows", "first_key", "last_key", "digest"
    ))
    return materialise(reduce(DataFrame.unionByName, levels), "merkle-tree")


def tree_tag(tree: DataFrame, order_name: str) -> DataFrame:
    """One row ``rows, tag`` from the root: the form of a content tag."""
    root = tree.where(F.col("parent") == 0).agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("digest"), F.lit("")).alias("_root")
    )
    text = F.concat_ws(":", F.lit(order_name), F.col("rows").cast("string"), "_root")
    return root.select("rows", F.concat(F.lit("v1-"), F.substring(F.sha2(text, 256), 1, 16)).alias("tag"))


def changed_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """``side, node, rows, first_key, last_key`` of the ranges (level 1) that the other tree lacks.

    Read from the roots down: what lies below equal digests is not looked at.
    """
    found = []
    for side, tree, other in (("old", old, new), ("new", new, old)):
        top = tree.agg(F.max("level")).first()[0] or 0
        below = None
        for level in range(top, 0, -1):
            nodes = tree.where(F.col("level") == level)
            if below is not None:
                nodes = nodes.join(below.select(F.col("node").alias("parent")), "parent", "left_semi")
            below = nodes.join(other.where(F.col("level") == level).select("digest"), "digest", "left_anti")
        if below is not None:
            found.append(below.select(F.lit(side).alias("side"), "node", "rows", "first_key", "last_key"))
    if not found:
        return old.limit(0).select(F.lit("old").alias("side"), "node", "rows", "first_key", "last_key")
    return reduce(DataFrame.unionByName, found)
