import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.operators import merge, numbering
from kvartal.plans import upsert
from kvartal.schemas import ADDRESSES, INSTITUTIONS, STREETS
from kvartal.session import materialise
from kvartal.sources.tables import Tables

OLD, NEW = datetime(2026, 5, 4), datetime(2026, 5, 11)
COLUMNS = [f.name for f in INSTITUTIONS]


def inst(id, external, name="n", address="a", district="01", seen=OLD, kind="preschool"):
    return (id, external, name, kind, "https://x", address, district, False, seen)


def test_institution_policy(spark):
    stored = spark.createDataFrame(
        [inst(n, e) for n, e in enumerate(["same", "renamed", "no_address", "no_district", "gone"], 1)],
        INSTITUTIONS,
    )
    incoming = spark.createDataFrame([
        inst(None, "same", seen=NEW), inst(None, "renamed", name="m", seen=NEW),
        inst(None, "no_address", address=None, seen=NEW),
        inst(None, "no_district", district=None, seen=NEW), inst(None, "fresh", seen=NEW),
        inst(None, "same", seen=NEW, kind="nursery"),
    ], INSTITUTIONS).drop("id")
    merged = merge.merge_upsert(stored, incoming, merge.INSTITUTIONS)
    got = {(r.external_id, r.kind): r for r in merged.collect()}
    assert {k[0]: r.change for k, r in got.items() if k[1] == "preschool"} == {
        "same": "unchanged", "renamed": "updated", "no_address": "updated",
        "no_district": "unchanged", "gone": "retained", "fresh": "inserted",
    }
    assert got["no_address", "preschool"].address is None
    assert got["no_district", "preschool"].district_code == "01"
    assert got["same", "preschool"].last_seen_at == NEW
    assert (got["same", "preschool"].id, got["same", "nursery"].id) == (1, None)
    assert tuple(merge.change_counts(merged).first()) == (2, 2, 2)
    gone = merge.disappeared(merged, F.lit(NEW)).collect()
    assert [r.external_id for r in gone] == ["gone"]


def test_older_batch_moves_last_seen_back(spark):
    stored = spark.createDataFrame([inst(1, "x", seen=NEW)], INSTITUTIONS)
    incoming = spark.createDataFrame([inst(None, "x", seen=OLD)], INSTITUTIONS).drop("id")
    row = merge.merge_upsert(stored, incoming, merge.INSTITUTIONS).first()
    assert (row.change, row.last_seen_at) == ("unchanged", OLD)


def test_street_policy_updates_key_only(spark):
    stored = spark.createDataFrame([(1, "c", "r", "p", "УЛ.", "old")], STREETS)
    incoming = spark.createDataFrame([(None, "d", "r", "q", None, "new")], STREETS).drop("id")
    row = merge.merge_upsert(stored, incoming, merge.STREETS).first()
    assert tuple(row) == (1, "c", "r", "p", "УЛ.", "new", "updated")


def test_insert_only_with_null_equal_keys(spark):
    stored = spark.createDataFrame(
        [(7, 1, 5, None, None, "01", None), (9, 1, 5, "А", None, None, None)], ADDRESSES
    )
    incoming = spark.createDataFrame(
        [(1, 5, None, None), (1, 5, None, "1"), (1, 4, None, None)],
        "street_id long, number_int smallint, number_suffix string, entrance string",
    )
    merged = merge.merge_upsert(stored, incoming, merge.ADDRESSES).collect()
    assert sorted((r.id or 0, r.change) for r in merged) == [
        (0, "inserted"), (0, "inserted"), (7, "unchanged"), (9, "retained"),
    ]
    fresh = merge.insert_only(stored, incoming, merge.ADDRESSES.key)
    order = [F.col(k).asc_nulls_first() for k in merge.ADDRESSES.key]
    ids = numbering.assign_ids(fresh, stored, order).collect()
    assert {r.id: r.number_int for r in ids} == {10: 4, 11: 5}
    first = numbering.assign_ids(fresh, stored.limit(0), order)
    assert sorted(r.id for r in first.collect()) == [1, 2]


def test_cascade_and_reset(spark):
    streets = spark.createDataFrame([(n, "c", str(n), "", None, "") for n in (1, 2)], STREETS)
    addresses = spark.createDataFrame(
        [(n, s, 1, None, None, "01", "10135") for n, s in ((10, 1), (11, 2), (12, 2))], ADDRESSES
    )
    insts = spark.createDataFrame([inst(1, "a"), inst(2, "b", kind="nursery")], INSTITUTIONS)
    edges = spark.createDataFrame(
        [(10, 1), (11, 1), (11, 2), (12, 2)], "address_id long, institution_id long"
    )
    left = merge.cascade_delete(
        streets.where("id = 1"), insts.where("id = 2"), streets, addresses, insts, edges
    )
    assert {name: df.count() for name, df in left.items()} == {
        "streets": 1, "addresses": 2, "institutions": 1, "address_institutions": 1,
    }
    reset = merge.reset_stamps(insts, ("district_code",), F.col("kind") == "nursery").collect()
    assert {r.id: r.district_code for r in reset} == {1: None, 2: "01"}


def test_positions_are_dense_over_many_partitions(spark):
    rows = spark.range(0, 20_000, 1, 16).withColumn("group", F.col("id") % 3)
    got = numbering.with_position(rows, [F.col("id").desc()])
    wrong = got.where(F.col("position") != 20_000 - F.col("id"))
    assert got.count() == 20_000 and wrong.count() == 0
    grouped = numbering.with_group_position(rows, ["group"], ["id"])
    wrong = grouped.where(F.col("position") != F.floor(F.col("id") / 3) + 1)
    assert grouped.count() == 20_000 and wrong.count() == 0


def test_parts_are_merged_like_the_whole_table(spark, tmp_path):
    """Random batches: same rows as one merge, and only parts with a changed row get new folders."""
    rng = random.Random(2)
    schema = INSTITUTIONS
    row = lambda i: (None, f"E{i}", rng.choice(["nursery", "preschool"]), rng.choice("ab"), "u", rng.choice([None, "x"]), rng.choice([None, "01"]), False, None)
    columns = ["id", "external_id", "kind", "name", "source_url", "address", "district_code", "has_infant_group", "last_seen_at"]
    types = {f.name: f.dataType for f in schema}
    frame = lambda rows: spark.createDataFrame(rows, T.StructType([T.StructField(c, types[c]) for c in columns])).select(*schema.names)
    part = F.length("external_id") * 10 + F.substring("external_id", -1, 1).cast("int")
    tables = Tables(spark, str(tmp_path))
    whole = frame([])
    for batch in ([row(i) for i in range(40)], [row(7), row(17), row(140)], [], [row(55)]):
        batch = list({(r[1], r[2]): r for r in batch}.values())
        incoming = frame(batch).drop("id")
        before = dict(tables.parts("institutions"))
        merged = upsert.upsert_parts(tables, "institutions", incoming, merge.INSTITUTIONS, part, schema)
        tables.publish({"institutions": merged.parts})
        expected = materialise(merge.merge_upsert(whole, incoming, merge.INSTITUTIONS), "whole")
        assert merge.change_counts(merged.rows).collect() == merge.change_counts(expected).collect()
        whole = expected.select(*schema.names)
        got = Tables(spark, str(tmp_path)).read("institutions", schema)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
        kept = [p for p, folder in before.items() if merged.parts[p] == folder]
        assert merged.written == len(merged.parts) - len(kept) <= merged.met
        assert len(batch) > 30 or merged.written <= len(batch)
    # The same batch again: nothing is written.
    repeated = whole.where("external_id IN ('E55', 'E7')").drop("id")
    merged = upsert.upsert_parts(tables, "institutions", repeated, merge.INSTITUTIONS, part, schema)
    assert (merged.written, merged.met) == (0, repeated.select(part).distinct().count())
    with pytest.raises(ValueError):
        other = Tables(spark, str(tmp_path / "flat"))
        other.replace("t", whole, schema)
        other.parts("t")


def test_parts_are_written_in_few_files(spark, tmp_path):
    """A file per part and task would be 16 times as many."""
    rows = spark.range(0, 4000, 1, 16).selectExpr("id * 7919 % 50 AS street_id", "id", "cast(id AS string) AS entrance")
    tables = Tables(spark, str(tmp_path))
    with_parts = tables.stage_parts("t", rows, F.col("street_id"), rows.schema)
    files = [f for folder in with_parts.values() for f in (tmp_path / folder).glob("*.parquet")]
    assert len(with_parts) == 50 and len(files) <= 50 + 4
    got = tables._read(list(with_parts.values()), rows.schema)
    assert sorted(got.collect()) == sorted(rows.collect())
