"""Similar keys by trigram overlap: an exact set-similarity join, no pair of which is lost.

Two sets with Jaccard similarity t share at least one member among the first
``n - ceil(t*n) + 1`` of each, whatever common order the members are listed in. Listed
rarest first, these prefixes hold few common trigrams, so a trigram that nearly all keys
share hardly ever joins them. Keys are further joined only within neighbouring size classes.

Candidates are pairs of ids with sizes and 128 bits each. Every member that only one of two sets
has changes one bit, so the bits that differ count members that are not shared: a pair with
too many is none. The trigrams themselves are fetched for the pairs that are left.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.functions.trigrams import trigrams
from kvartal.operators.joins import lookup_join
from kvartal.session import materialise

SCALE = 1000  # thresholds are whole thousandths, so that no bound is rounded


def _ceil_share(part: int, count: Column) -> Column:
    return F.floor((count * part + (SCALE - 1)) / SCALE).cast("int")


def _ordered(keys: DataFrame, frequency: DataFrame, within: list[str]) -> DataFrame:
    """``id, key, grams``: trigrams rarest first. A group is one key's own trigrams."""
    grams = keys.select("id", "key", *within, F.explode_outer(trigrams(F.col("key"))).alias("gram")).where(
        F.col("gram").isNotNull()
    )
    listed = lookup_join(grams, frequency, ["gram"])
    return listed.groupBy("id", "key", *within).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("n", "gram"))), lambda g: g["gram"]
        ).alias("grams")
    )


def _bits(half: int) -> Column:
    """64 of a set's bits: each member changes one of 128."""
    place = lambda g: F.pmod(F.xxhash64(g), F.lit(128))
    own = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), (place(g) % 64).cast("int"))
    return F.aggregate(
        "grams", F.lit(0).cast("long"),
        lambda bits, g: bits.bitwiseXOR(F.when(F.floor(place(g) / 64) == half, own(g)).otherwise(F.lit(0).cast("long"))),
    )


def _prefixes(ordered: DataFrame, part: int, side: str, width: float, reach: int, within: list[str]) -> DataFrame:
    size = F.size("grams")
    bucket = F.floor(F.log(size) / F.lit(width)).cast("int")
    prefixed = ordered.select(
        *within, F.col("id").alias(f"{side}_id"), size.alias(f"{side}_size"),
        _bits(0).alias(f"{side}_low"), _bits(1).alias(f"{side}_high"),
        F.slice("grams", 1, size - _ceil_share(part, size) + 1).alias("_prefix"),
        F.sequence(bucket - reach, bucket + reach).alias("_buckets"),
    )
    return (
        prefixed.select("*", F.explode("_buckets").alias("bucket"))
        .select("*", F.posexplode("_prefix").alias(f"{side}_at", "gram")).drop("_prefix", "_buckets")
    )


def fuzzy_street_join(
    left: DataFrame, right: DataFrame, threshold: float = 0.6, key: str = "search_norm",
    within: Sequence[str] = (),
) -> DataFrame:
    """Pairs of distinct keys at or above the threshold.

    ``left_key, right_key, shared, total``: the similarity is ``shared / total``. The
    threshold is read as whole thousandths above 0. Keys without any trigram match nothing.

    ``within``: columns that must be equal, and come first in the result. Keys that start with
    their locality all resemble each other at a low threshold: there, compare the street's own
    name within its city.
    """
    part = round(threshold * SCALE)
    if not 0 < part <= SCALE:
        raise ValueError(f"threshold must be in (0, 1]: {threshold}")
    within = list(within)
    # Ids are fixed by the written tables.
    sides = [
        materialise(
            df.select(F.col(key).alias("key"), *within).dropna().distinct().withColumn("id", F.monotonically_increasing_id()),
            "names",
        )
        for df in (left, right)
    ]
    frequency = (
        sides[0].unionByName(sides[1])
        .select(F.explode(trigrams(F.col("key"))).alias("gram"))
        .groupBy("gram").agg(F.count("*").alias("n"))
    )
    # Sizes of similar sets differ at most by the factor 1/t: at most one class apart.
    width = math.log(SCALE / part) + 1e-6
    a, b = (materialise(_ordered(side, frequency, within), "name-grams") for side in sides)
    pairs = _prefixes(a, part, "left", width, 1, within).join(
        _prefixes(b, part, "right", width, 0, within), ["gram", "bucket", *within]
    )
    left_size, right_size = F.col("left_size"), F.col("right_size")
    # shared / (left + right - shared) >= t  <=>  shared >= t / (1 + t) * (left + right)
    needed = (left_size + right_size) * part
    # Trigrams before the first common one are not shared, nor is anything past a list's end.
    possible = F.least(left_size - F.col("left_at"), right_size - F.col("right_at"))
    unlike = sum(
        F.call_function("bit_count", F.col(f"left_{half}").bitwiseXOR(F.col(f"right_{half}"))) for half in ("low", "high")
    )
    # left + right - 2 * shared members are not shared: at least as many as bits differ.
    likely = (left_size + right_size - unlike) * (SCALE + part) >= 2 * needed
    survivors = materialise(
        pairs.where((possible * (SCALE + part) >= needed) & likely).select("left_id", "right_id").distinct(), "name-pairs"
    )
    lists = [
        side.select(F.col("id").alias(f"{name}_id"), F.col("key").alias(f"{name}_key"), F.col("grams").alias(f"{name}_grams"), *more)
        for side, name, more in ((a, "left", within), (b, "right", []))
    ]
    sizes = F.size("left_grams") + F.size("right_grams")
    return (
        survivors.join(lists[0], "left_id").join(lists[1], "right_id")
        .withColumn("shared", F.size(F.array_intersect("left_grams", "right_grams")))
        .where(F.col("shared") * (SCALE + part) >= sizes * part)
        .select(
            *within, "left_key", "right_key", F.col("shared").cast("long").alias("shared"),
            (sizes - F.col("shared")).cast("long").alias("total"),
        )
    )
