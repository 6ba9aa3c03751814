import pytest
from pyspark.sql import functions as F

from kvartal.operators import lookup, prefix_lookup
from kvartal.schemas import ADDRESSES, INSTITUTIONS, STREETS

REGISTER = (
    "search_norm string, number_int smallint, number_suffix string, entrance string, "
    "district_code string"
)


def address(id, street, number, suffix=None, entrance=None, district=None, settlement=None):
    return (id, street, number, suffix, entrance, district, settlement)


def street(id, raw, norm):
    return (id, "city", raw, "part", "УЛ.", norm)


# One street per case: (number, suffix, entrance, old code), register rows, expected code and tier.
CASES = {
    "exact": ((7, None, "А", None), [(7, "", "А", "02")], ("02", 1)),
    "null_is_empty": ((5, None, None, None), [(5, "", "", "01")], ("01", 1)),
    "exact_disagrees": ((2, None, None, None), [(2, "", "", "02"), (2, "", "", "05")], (None, None)),
    "entrance_dropped": ((5, "А", "1", None), [(5, "А", "", "04")], ("04", 2)),
    "entrance_split": ((5, "А", "1", None), [(5, "А", "А", "01"), (5, "А", "Б", "02")], (None, None)),
    "street_agrees": ((99, None, None, None), [(2, "", "", "03"), (4, "", "", "03")], ("03", 3)),
    "street_split": ((999, None, None, None), [(10, "", "", "01"), (20, "", "", "02")], (None, None)),
    "already_set": ((5, None, None, "04"), [(5, "", "", "03")], ("04", None)),
    "no_match_keeps": ((5, None, None, "04"), [(6, "", "", "03"), (7, "", "", "01")], ("04", None)),
    "later_tier_keeps": ((5, None, None, "04"), [(6, "", "", "03")], ("04", None)),
}


@pytest.fixture(scope="module")
def tables(spark):
    streets, addresses, register = [], [], []
    for id, (name, ((number, suffix, entrance, old), refs, _)) in enumerate(CASES.items(), 1):
        streets.append(street(id, f"ГР.ВАРНА УЛ.{name}", name))
        addresses.append(address(id, id, number, suffix, entrance, old))
        register += [(name, *r) for r in refs]
    return (
        spark.createDataFrame(addresses, ADDRESSES), spark.createDataFrame(streets, STREETS),
        lookup.build_tiers(spark.createDataFrame(register, REGISTER)),
    )


def results(df):
    names = list(CASES)
    return {names[r.id - 1]: (r.district_code, r.tier) for r in df.collect()}


def test_gated_tiers(tables):
    stamped = lookup.stamp_addresses(*tables)
    assert results(stamped) == {name: expected for name, (_, _, expected) in CASES.items()}
    assert tuple(lookup.tier_counts(stamped).first()) == (2, 1, 1, 3)
    labels = lookup.unresolved_addresses(stamped, tables[1]).collect()
    assert labels[0].label == "ГР.ВАРНА УЛ.exact_disagrees 2"


def test_gated_rerun_changes_nothing(tables):
    addresses, streets, register = tables
    once = lookup.stamp_addresses(addresses, streets, register).select(*addresses.columns)
    again = lookup.stamp_addresses(once, streets, register)
    assert tuple(lookup.tier_counts(again).first()) == (0, 0, 0, 3)


def test_restamp_overwrites_by_first_tier_only(tables):
    expected = {name: e for name, (_, _, e) in CASES.items()} | {"already_set": ("03", 1)}
    assert results(lookup.stamp_addresses(*tables, restamp=True)) == expected


def test_settlement_pass(spark):
    streets = spark.createDataFrame(
        [street(1, "С.КАМЕНАР УЛ. Х", "k"), street(2, "ДРУГО", "d")], STREETS
    )
    addresses = spark.createDataFrame([
        address(10, 1, 1), address(11, 1, 2, settlement="99999"), address(12, 2, 3, settlement="1"),
    ], ADDRESSES)

    def codes(restamp):
        out = lookup.stamp_settlements(addresses, streets, restamp).collect()
        return {r.id: (r.settlement_code, r.settlement_stamped) for r in out}

    assert codes(False) == {10: ("35701", True), 11: ("99999", False), 12: ("1", False)}
    assert codes(True) == {10: ("35701", True), 11: ("35701", True), 12: ("1", False)}


def inst(id, kind="kindergarten", address=None, district=None):
    return (id, str(id), f"Name {id}", kind, "https://x", address, district, False, None)


def test_institution_pass(spark):
    addresses = spark.createDataFrame(
        [address(n, 1, n, district=d) for n, d in enumerate(
            ["04", "04", "04", "05", "04", "04", "02", "02", None], 1)],
        ADDRESSES,
    )
    institutions = spark.createDataFrame([
        inst(1), inst(2), inst(3, address="ГР.ВАРНА БУЛ.СИНЯ ВЕТРЕНИЦА 26"),
        inst(4, address="ГР.ВАРНА УЛ.ЖЪЛЪД 83"), inst(5, "nursery"), inst(6),
        inst(7, address="GARBAGE"), inst(8, address="ГР.ВАРНА УЛ.НЯМА 1"), inst(9, address=""),
        inst(10, address="ГР.ВАРНА УЛ.НЯМА 1"), inst(11, district="01"),
    ], INSTITUTIONS)
    edges = spark.createDataFrame(
        [(a, 1) for a in (1, 2, 3, 4)] + [(a, 2) for a in (5, 6, 7, 8)]
        + [(9, 4), (9, 6), (1, 5), (9, 10), (7, 11)],
        "address_id long, institution_id long",
    )
    register = spark.createDataFrame([
        ("gr.varna bul.sinya vetrenitsa", 26, "", "", "04"), ("gr.varna ul.zhalad", 1, "", "", "03"),
    ], REGISTER)

    tiers = lookup.build_tiers(register)

    def stamped(restamp):
        out = lookup.stamp_institutions(institutions, edges, addresses, tiers, restamp)
        return out, {r.id: (r.district_code, r.stamp, r.unresolved_reason) for r in out.collect()}

    out, gated = stamped(False)
    assert gated == {
        1: ("04", "primary", None), 2: ("02", "primary", None), 3: ("04", "fallback", None),
        4: ("03", "fallback", None), 5: (None, None, None), 6: (None, None, "all_catchment_null"),
        7: (None, None, "address_parse_failed"), 8: (None, None, "grao_lookup_failed"),
        9: (None, None, "no_catchment"), 10: (None, None, "all_catchment_null"),
        11: ("01", None, None),
    }
    assert tuple(lookup.stamp_counts(out).first()) == (2, 2, 5)
    assert [r.id for r in lookup.unresolved_institutions(out).collect()] == [6, 7, 8, 9, 10]
    assert stamped(True)[1][11] == ("02", "primary", None)


def test_hot_key_is_split(spark):
    """A street with most of all rows: the look-up join splits its partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",  # keep many small map outputs
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500))
            .alias("search_norm"),
            (F.col("id") % 1000).cast("smallint").alias("number_int"),
            F.lit(None).cast("string").alias("number_suffix"),
            F.col("id").cast("string").alias("entrance"),
            F.lit(None).cast("string").alias("district_code"),
        )
        register = spark.range(500).select(
            F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("search_norm"),
            F.lit(1).cast("smallint").alias("number_int"), F.lit("Я").alias("number_suffix"),
            F.lit("").alias("entrance"), F.lit("01").alias("district_code"),
        )
        stamped = lookup.stamp_by_tiers(rows, lookup.build_tiers(register))
        frame = stamped.where("tier = 3")
        counted = frame.collect()
        assert len(counted) == 59_960
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan, plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_small_files_with_many_rows_are_not_broadcast_by_their_size(spark, tmp_path):
    """Half a million short rows take a megabyte or two of parquet, and over ten in memory."""
    from kvartal.session import tune

    path = str(tmp_path / "rows")
    spark.range(0, 500_000, 1, 1).selectExpr("abs(hash(id)) % 1000 AS id", "abs(hash(-id)) % 1000 AS n").write.parquet(path)
    tune(spark)
    rows = spark.read.parquet(path)
    plan = rows.join(rows.withColumnRenamed("n", "m"), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_keys_and_hashes_do_not_travel(spark):
    """Rows are shuffled as they are: keys and their hash are worked out in the join."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select(
            F.concat(F.lit("s"), F.col("id") % 5).alias("search_norm"), (F.col("id") % 9).cast("smallint").alias("number_int"),
            F.lit(None).cast("string").alias("number_suffix"), F.lit("").alias("entrance"),
            F.lit(None).cast("string").alias("district_code"),
        )
        register = spark.createDataFrame([("s1", 1, "", "", "02"), ("s2", 3, "", "", "03")], REGISTER)
        stamped = lookup.stamp_by_tiers(rows, lookup.build_tiers(register), restamp=True)
        assert stamped.where("district_code IS NOT NULL").count() == 40
        plan = stamped._jdf.queryExecution().optimizedPlan().toString()
        moved = [line for line in plan.splitlines() if "coalesce(number_suffix" in line and "Project" in line]
        assert "Join" in plan and "_key_hash" not in plan and not moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_asking_rows_are_computed_once(spark):
    """One pass reads its rows for a sample, to match them, and to pass them by."""
    rows = spark.range(100).select(
        F.concat(F.lit("s"), F.col("id") % 5).alias("search_norm"), (F.col("id") % 9).cast("smallint").alias("number_int"),
        F.lit(None).cast("string").alias("number_suffix"), F.lit("").alias("entrance"),
        F.when(F.col("id") % 2 == 0, "09").alias("district_code"),
    )
    tiers = lookup.build_tiers(spark.createDataFrame([("s1", 1, "", "", "02"), ("s2", 3, "", "", "03")], REGISTER))
    passed = lookup.stamp_by_tiers(rows, tiers, match=prefix_lookup.match_in_one_pass)
    assert "Range (" not in passed._jdf.queryExecution().optimizedPlan().toString()
    joined = lookup.stamp_by_tiers(rows, tiers)
    assert passed.count() == 100 and passed.exceptAll(joined).count() == 0
