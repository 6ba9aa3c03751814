"""The tiered look-up in one shuffle: a merge in key order instead of a join per tier.

The keys of the tiers are prefixes of one another. Rows that ask and the rows of all tiers are
brought together once, by leading key and a part of it, and sorted by full key: the coarse row of a
street comes first, the row of a house before its entrances, and each row that asks right behind
the keys it can match. One pass keeps the last row of every tier it has met.

A street is cut into parts by house number, and a house that holds a large share of all rows into
further ones, so no key makes one task large. Only the tiers' rows are repeated for that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvartal.operators.lookup import Tiers
from kvartal.session import materialise

# Parts of every leading key, by the second key column.
PARTS = 8
# Pairs of the first two key columns with more than one in HOT rows get SALTS parts of their own: at
# most HOT of them, found in a sample of the rows. What the sample misses costs time, not rows.
HOT, SALTS, SAMPLE = 200, 64, 0.02
_ASKS = 9


def _hot_pairs(rows: DataFrame, first: str, second: str) -> DataFrame:
    """_k1, _k2, _place of the pairs that hold a large share: HOT rows at most."""
    known = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(first, second)
    drawn = materialise(known.sample(SAMPLE, seed=1), "drawn-keys")
    counts = drawn.groupBy(F.col(first).alias("_k1"), F.col(second).alias("_k2")).agg(F.count("*").alias("_n"))
    total = drawn.agg(F.count("*").alias("_all"))
    hot = counts.join(F.broadcast(total), F.col("_n") * HOT > F.col("_all")).where("_n >= 20")  # one row
    return hot.select("_k1", "_k2", F.pmod(F.xxhash64("_k1", "_k2"), F.lit(1 << 20)).cast("int").alias("_place"))


def _parts(pair_hash: Column, salt: Column) -> Column:
    """Part of a row: one of PARTS, or behind them one of the salts of its hot pair."""
    return F.when(F.col("_place").isNotNull(), PARTS + F.col("_place") * SALTS + salt).otherwise(pair_hash)


def match_in_one_pass(
    target: DataFrame, tiers: Tiers, empty_if_null: Sequence[str] = (), asked: Column | None = None
) -> DataFrame:
    """Add ``_t1 .. _tn``, as ``lookup.match_tiers`` does, with one exchange of the rows that ask.

    Rows that are not ``asked``, or have no leading key, find nothing and are not moved at all.
    """
    full = tiers.keys[0]
    if any(keys != full[: len(keys)] for keys in tiers.keys) or len(full) < 2 or tiers.keys[-1] != full[:1]:
        raise ValueError(f"tiers must be prefixes of one key, down to its first column: {tiers.keys}")
    kinds, keys = dict(tiers.tables[0].dtypes), [f"_k_{k}" for k in full]
    # Read for the sample, for the rows that ask and for the others; whatever made them runs once.
    keyed = target = materialise(target, "asking-rows")
    for key, name in zip(full, keys):
        column = F.coalesce(F.col(key), F.lit("")) if key in empty_if_null else F.col(key)
        keyed = keyed.withColumn(name, column.cast(kinds[key]))
    asks = F.col(keys[0]).isNotNull() & (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False)))
    found = [f"_t{n}" for n in range(1, len(tiers.keys) + 1)]
    code = tiers.tables[0].schema["_code"].dataType
    idle = keyed.where(~asks).select(*target.columns, *(F.lit(None).cast(code).alias(t) for t in found))

    moving = keyed.where(asks)
    # HOT rows at most; written, so that all sides cut the keys alike.
    hot = F.broadcast(materialise(_hot_pairs(moving, keys[0], keys[1]), "hot-pairs"))
    pair = F.pmod(F.xxhash64(keys[1]), F.lit(PARTS)).cast("int")

    def with_place(rows: DataFrame) -> DataFrame:
        return rows.join(hot, (F.col(keys[0]) == F.col("_k1")) & (F.col(keys[1]) == F.col("_k2")), "left")

    # A row without a second key column can only match its leading key: any part will do.
    spread = F.xxhash64(*target.columns) + F.spark_partition_id()
    part = F.when(F.col(keys[1]).isNull(), F.pmod(spread, F.lit(PARTS)).cast("int")).otherwise(
        _parts(pair, F.pmod(spread, F.lit(SALTS)).cast("int"))
    )
    row = F.struct(*target.columns)
    sides = [with_place(moving).select(*keys, part.alias("_part"), F.lit(_ASKS).alias("_level"), F.lit(None).cast(code).alias("_code"), row.alias("_row"))]
    for level, (names, table) in enumerate(zip(tiers.keys, tiers.tables)):
        known = table.where(F.col("_code").isNotNull()).select(*(F.col(k).alias(f"_k_{k}") for k in names), "_code")
        if len(names) == 1:
            # Wherever rows of the street are: in its parts, and in those of its hot houses.
            places = hot.groupBy("_k1").agg(F.collect_list("_place").alias("_places"))
            salts = F.flatten(F.transform(
                F.coalesce("_places", F.array().cast("array<int>")),
                lambda p: F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: PARTS + p * SALTS + s),
            ))
            parts = F.concat(F.sequence(F.lit(0), F.lit(PARTS - 1)), salts)
            known = known.join(F.broadcast(places), F.col(keys[0]) == F.col("_k1"), "left").withColumn("_part", F.explode(parts))
        else:
            salts = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: PARTS + F.col("_place") * SALTS + s)
            known = with_place(known).withColumn("_part", F.explode(F.when(F.col("_place").isNotNull(), salts).otherwise(F.array(pair))))
        rest = [F.lit(None).cast(kinds[k]).alias(f"_k_{k}") for k in full[len(names) :]]
        sides.append(known.select(
            *(f"_k_{k}" for k in names), *rest, "_part", F.lit(len(tiers.keys) - level).alias("_level"), "_code",
            F.lit(None).cast(sides[0].schema["_row"].dataType).alias("_row"),
        ))
    together = reduce(DataFrame.unionByName, sides)
    # NULLs come first, so a tier's row stands ahead of all longer keys that it is a prefix of.
    order = Window.partitionBy(keys[0], "_part").orderBy(*(F.col(k).asc_nulls_first() for k in keys[1:]), "_level")
    passed = order.rowsBetween(Window.unboundedPreceding, 0)
    columns = {}
    for n, names in enumerate(tiers.keys, 1):
        own = [f"_k_{k}" for k in names[1:]]
        level = len(tiers.keys) - n + 1
        last = F.last(F.when(F.col("_level") == level, F.struct(*own, "_code")), ignorenulls=True).over(passed)
        columns[f"_l{n}"] = last
    merged = together.withColumns(columns).where(F.col("_level") == _ASKS)
    codes = []
    for n, names in enumerate(tiers.keys, 1):
        last = F.col(f"_l{n}")
        same = reduce(lambda a, b: a & b, (last[f"_k_{k}"] == F.col(f"_k_{k}") for k in names[1:]), F.lit(True))
        codes.append(F.when(same, last["_code"]).alias(f"_t{n}"))
    return merged.select("_row.*", *codes).unionByName(idle)
