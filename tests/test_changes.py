"""Response classes, hash trees, change propagation, substring postings and split JSON."""

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kvartal import schemas
from kvartal.operators import browse, lookup, prefix_lookup, quality, responses, restamp, routing, substrings
from kvartal.plans import refresh
from kvartal.schemas import ADDRESSES, INSTITUTIONS, STREETS, settlements_dim
from kvartal.session import discard, materialise
from kvartal.sources import merkle, snapshot, split_json
from kvartal.sources.tables import MovedTables, Tables

EDGE = "address_id long, institution_id long"


def random_city(spark, seed, n=80, institutions=40):
    rng = random.Random(seed)
    districts = ["01", "02", "03", None]
    insts = [
        (i, f"X{i}", f"Name {rng.randrange(12)}", rng.choice(["nursery", "kindergarten", "preschool"]), "u", None,
         rng.choice(districts), rng.random() < 0.5, None)
        for i in range(1, institutions + 1)
    ]
    addresses = [(i, 1, i, None, None, rng.choice(districts), rng.choice(["10135", None])) for i in range(100, 100 + n)]
    sets = [rng.sample(range(1, institutions + 1), k) for k in (0, 1, 2, 5)]
    edges = [(a[0], i) for a in addresses for i in (rng.choice(sets) if rng.random() < 0.8 else rng.sample(range(1, institutions + 1), 3))]
    return spark.createDataFrame(addresses, ADDRESSES), spark.createDataFrame(edges, EDGE), spark.createDataFrame(insts, INSTITUTIONS)


@pytest.mark.parametrize("seed, kind, size", [(1, None, 3), (2, "preschool", 2), (4, "kindergarten", 1)])
def test_classes_expand_to_every_response(spark, seed, kind, size):
    """Against the plain way: route, expand and rank each address by itself."""
    tables = random_city(spark, seed)
    plain = {}
    ranked = routing.rank_offerings(routing.expand_offerings(routing.route_addresses(*tables, kind=kind)))
    for r in ranked.orderBy("rank").collect():
        plain.setdefault(r.address_id, []).append((r.id, r.reception_kind, r.offering, r.match_basis))
    got = {}
    response = responses.routing_response(*tables, settlements_dim(spark), kind, size)
    for r in response.orderBy("page_no").collect():
        page = [(o.id, o.reception_kind, o.offering, o.match_basis) for o in r.results]
        assert len(page) == size or r.page_no == 0 or len(page) == len(plain[r.address_id]) % size
        got.setdefault(r.address_id, []).extend(page)
    assert got == {r.id: plain.get(r.id, []) for r in tables[0].collect()}


@pytest.mark.parametrize("size, pages", [(2, 2), (4, 3), (3, 3), (1, 10_000)])
def test_responses_over_several_spans(spark, monkeypatch, size, pages):
    """A response is looked up in spans; their borders show in no page."""
    tables = random_city(spark, 5, n=40, institutions=90)
    plain = {}
    ranked = routing.rank_offerings(routing.expand_offerings(routing.route_addresses(*tables)))
    for r in ranked.orderBy("rank").collect():
        plain.setdefault(r.address_id, []).append((r.id, r.reception_kind, r.offering, r.match_basis))
    monkeypatch.setattr(responses, "SPAN", size)
    found = responses.factorise(*tables)
    for of_class in (False, True):
        rows = responses.class_pages(found, pages).join(found.members, "class_id") if of_class else responses.member_pages(found, pages)
        got = {}
        for r in rows.orderBy("page_no").collect():
            assert r.page_no * pages == len(got.setdefault(r.address_id, []))
            got[r.address_id].extend((o.id, o.reception_kind, o.offering, o.match_basis) for o in r.results)
        assert got == {r.id: plain.get(r.id, []) for r in tables[0].collect()}


def test_pages_are_made_after_the_last_shuffle(spark):
    """Neither a shuffle nor a file holds pages: the plan, from its top, first cuts pages, then shuffles."""
    response = responses.routing_response(*random_city(spark, 3), settlements_dim(spark), None, 2)
    plan = response._jdf.queryExecution().executedPlan().toString()
    assert -1 < plan.index("Generate") < plan.index("Exchange")
    assert plan.index("page_no") < plan.index("Exchange") and "page_no" not in plan[plan.index("Exchange"):]


def test_own_offers_are_numbers_until_their_places_are_known(spark, monkeypatch):
    """Texts of an offer stand once per institution; of the tables by edge one has them, the last."""
    from kvartal.operators import numbering

    written = []
    for module in (responses, numbering):
        monkeypatch.setattr(module, "materialise", lambda df, label: written.append((label, df.schema.simpleString())) or materialise(df, label))
    responses.routing_response(*random_city(spark, 9), settlements_dim(spark), None, 2)
    by_edge = [label for label, columns in written if re.search("(class|address|example)_id:", columns) and "source_url:" in columns]
    assert by_edge == ["response-offers"] and len(written) > 5


def test_a_response_moves_in_rows_of_many_results(spark, monkeypatch):
    """3,000 institutions of a district and no edge: one row per address is dealt out, not one per 2,048 results."""
    _, _, insts = random_city(spark, 3, institutions=5)
    many = spark.range(3000).selectExpr(
        "id + 1000 AS id", "concat('X', id) AS external_id", "'n' AS name", "'preschool' AS kind", "'u' AS source_url",
        "cast(null AS string) AS address", "'07' AS district_code", "false AS has_infant_group", "cast(null AS timestamp) AS last_seen_at",
    ).select(insts.columns)
    addresses = spark.createDataFrame([(i, 1, 1, None, None, "07", None) for i in range(5)], ADDRESSES)
    dealt, repartition = [], type(insts).repartition
    monkeypatch.setattr(type(insts), "repartition", lambda self, *by: dealt.append(self.count()) or repartition(self, *by))
    found = responses.factorise(addresses, spark.createDataFrame([], EDGE), many)
    pages = responses.member_pages(found, 1000)
    assert dealt == [5] and sorted((r.address_id, r.page_no, len(r.results)) for r in pages.collect()) == [
        (a, p, 1000) for a in range(5) for p in range(3)
    ]


def test_offers_without_a_name(spark):
    """A name that is missing sorts as in the plain way."""
    addresses, edges, insts = random_city(spark, 10, n=30)
    insts = insts.withColumn("name", F.when(F.col("id") % 3 > 0, F.col("name")))
    plain, got = {}, {}
    for r in routing.rank_offerings(routing.expand_offerings(routing.route_addresses(addresses, edges, insts))).orderBy("rank").collect():
        plain.setdefault(r.address_id, []).append((r.id, r.reception_kind, r.offering))
    for r in responses.routing_response(addresses, edges, insts, settlements_dim(spark), None, 3).orderBy("page_no").collect():
        got.setdefault(r.address_id, []).extend((o.id, o.reception_kind, o.offering) for o in r.results)
    assert got == {r.id: plain.get(r.id, []) for r in addresses.collect()}


def test_addresses_that_repeat_or_have_no_id(spark):
    addresses, edges, insts = random_city(spark, 12, n=20)
    twice = addresses.where("id < 103")
    nameless = twice.withColumn("id", F.lit(None).cast("long")).withColumn("district_code", F.lit("01"))
    found = responses.factorise(addresses.unionByName(twice).unionByName(nameless), edges, insts)
    once = responses.factorise(addresses.unionByName(nameless.limit(1)), edges, insts)
    rows = lambda of: sorted((r.address_id or 0, r.page_no, [(o.id, o.offering) for o in r.results]) for r in responses.member_pages(of, 3).collect())
    plain = rows(once)
    assert rows(found) == sorted(r for r in plain for _ in range({0: 3, 100: 2, 101: 2, 102: 2}.get(r[0], 1)))


def test_rows_are_those_of_classes_and_addresses(spark):
    """Many addresses of one district with the same edges: their response is there once."""
    _, _, insts = random_city(spark, 6, institutions=60)
    addresses = spark.range(500).selectExpr(
        "id", "1L AS street_id", "cast(1 AS smallint) AS number_int", "cast(null AS string) AS number_suffix",
        "cast(id AS string) AS entrance", "IF(id % 10 = 0, '02', '01') AS district_code", "cast(null AS string) AS settlement_code",
    )
    edges = spark.range(500).selectExpr("id AS address_id", "1 + id % 2 AS institution_id")
    found = responses.factorise(addresses, edges, insts)
    classes = found.classes.collect()
    assert found.members.count() == 500 and len(classes) <= 4 and sum(c.addresses for c in classes) == 500
    assert found.offers.count() <= 2 * len(classes)
    assert responses.class_pages(found, 1000).count() == len(classes)
    assert found.roster.count() == insts.where("kind <> 'kindergarten' AND district_code IS NOT NULL").count()
    again = responses.factorise(addresses.repartition(7), edges.repartition(3), insts)
    assert {c.class_id for c in classes} == {c.class_id for c in again.classes.collect()}


def test_published_routes(spark, tmp_path):
    addresses, edges, insts = random_city(spark, 7)
    tables = Tables(spark, str(tmp_path))
    tables.publish({
        "addresses": tables.stage("addresses", addresses, ADDRESSES), "institutions": tables.stage("institutions", insts, INSTITUTIONS),
        "address_institutions": tables.stage("address_institutions", edges),
    })
    counts = refresh.publish_routes(spark, str(tmp_path)).first()
    now = Tables(spark, str(tmp_path)).versions()
    routes, pages = (spark.read.parquet(f"{tmp_path}/{now[n]}") for n in ("routes", "route_pages"))
    assert counts.addresses == routes.count() == 80 and pages.count() == counts.classes
    joined = {r.address_id: [o.id for o in r.results] for r in routes.join(pages, "class_id").collect()}
    assert joined == {r.address_id: [o.id for o in r.results] for r in refresh.route_all(spark, str(tmp_path)).collect()}


def test_routes_published_in_parts_hold_no_pages(spark, tmp_path):
    """What is written grows with addresses, classes, offers and institutions, not with their responses."""
    addresses, edges, insts = random_city(spark, 8, n=120, institutions=120)
    tables = Tables(spark, str(tmp_path))
    tables.publish({
        "addresses": tables.stage("addresses", addresses, ADDRESSES), "institutions": tables.stage("institutions", insts, INSTITUTIONS),
        "address_institutions": tables.stage("address_institutions", edges),
    })
    counts = refresh.publish_routes(spark, str(tmp_path), factorised=True).first()
    now = Tables(spark, str(tmp_path)).versions()
    assert "route_pages" not in now and set(refresh.ROUTE_PARTS) <= set(now)
    written = sum(spark.read.parquet(f"{tmp_path}/{now[n]}").count() for n in refresh.ROUTE_PARTS)
    assert written <= 120 + counts.classes + 2 * edges.count() + 120
    found = refresh.published_responses(spark, str(tmp_path))
    got = {}
    for r in responses.member_pages(found, 4).orderBy("page_no").collect():
        got.setdefault(r.address_id, []).extend(o.id for o in r.results)
    assert got == {r.address_id: [o.id for o in r.results] for r in refresh.route_all(spark, str(tmp_path)).collect()}
    assert sum(map(len, got.values())) > written


@pytest.mark.parametrize("factorised", [True, False])
def test_publishing_routes_leaves_its_tables_alone(spark, tmp_path, factorised):
    """What responses are made from is not kept a second time beside the published tables."""
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    addresses, edges, insts = random_city(spark, 11, n=30)
    tables = Tables(spark, str(tmp_path))
    tables.publish({
        "addresses": tables.stage("addresses", addresses, ADDRESSES), "institutions": tables.stage("institutions", insts, INSTITUTIONS),
        "address_institutions": tables.stage("address_institutions", edges),
    })
    before = set(shared.iterdir())
    counts = refresh.publish_routes(spark, str(tmp_path), factorised=factorised).first()
    kept = {p.name.rpartition("-")[0] for p in set(shared.iterdir()) - before}
    assert kept <= {"route-counts"} and counts.addresses == 30
    now = Tables(spark, str(tmp_path)).versions()
    assert spark.read.parquet(f"{tmp_path}/{now['routes']}").count() == 30


def test_job_publishes_no_pages(spark, monkeypatch):
    from kvartal import catalog

    written, stage = [], Tables.stage
    monkeypatch.setattr(Tables, "stage", lambda self, name, *rest: written.append(name) or stage(self, name, *rest))
    assert catalog.QUERIES["publish_routes_job"](spark, "/root/testdata/sf0.001").count() > 0
    assert "route_pages" not in written and written[-4:] == list(refresh.ROUTE_PARTS)


# --- hash trees ----------------------------------------------------------------------------------------


def street_rows(spark, n, changed=()):
    rows = [(i, "city", f"street {i:06}" + ("!" if i in changed else ""), "p", None, "n") for i in range(n) if -i not in changed]
    return spark.createDataFrame(rows, STREETS)


def tree_of(df):
    return merkle.merkle_tree(df, browse.STREET_COLUMNS, browse.street_order(), ["id"])


def tag_of(tree, name="streets"):
    return merkle.tree_tag(tree, name).first()


def test_tree_does_not_depend_on_partitions(spark):
    rows = street_rows(spark, 3000)
    trees = [tree_of(df) for df in (rows, rows.repartition(7), rows.orderBy(F.desc("id")).coalesce(1))]
    first, *others = [sorted(map(tuple, t.collect())) for t in trees]
    assert all(t == first for t in others)
    assert tag_of(trees[0]).rows == 3000 and tag_of(trees[0]) == tag_of(trees[1])


def test_tag_follows_content_and_order(spark):
    rows = street_rows(spark, 700)
    base = tag_of(tree_of(rows)).tag
    assert tag_of(tree_of(rows.withColumn("search_norm", F.lit("other")))).tag == base  # not dumped
    assert tag_of(tree_of(street_rows(spark, 700, {5}))).tag != base
    assert tag_of(tree_of(street_rows(spark, 701))).tag != base
    backwards = merkle.merkle_tree(rows, browse.STREET_COLUMNS, [F.desc("id")], ["id"])
    assert tag_of(backwards).tag != base and tag_of(tree_of(rows), "other").tag != base
    assert tag_of(tree_of(rows.limit(0))).rows == 0 and tree_of(rows.limit(0)).count() == 0


def test_changed_ranges_hold_the_changes_and_little_else(spark):
    old, new = tree_of(street_rows(spark, 5000)), tree_of(street_rows(spark, 5000, {1234, -4000, 4500}))
    found = merkle.changed_ranges(old, new).collect()
    assert {r.side for r in found} == {"old", "new"} and sum(r.rows for r in found) < 5000
    ends = [(r.side, json.loads(r.first_key)["id"], json.loads(r.last_key)["id"]) for r in found]
    for side, id in [("old", 1234), ("new", 1234), ("old", 4000), ("old", 4500), ("new", 4500)]:
        assert any(s == side and a <= id <= b for s, a, b in ends), (side, id, ends)
    assert merkle.changed_ranges(old, old).count() == 0
    empty = tree_of(street_rows(spark, 0))
    assert sum(r.rows for r in merkle.changed_ranges(empty, old).collect()) == 5000


def test_ranges_across_runs_are_the_same(spark, monkeypatch):
    rows = street_rows(spark, 3000)
    whole = sorted(map(tuple, tree_of(rows).collect()))
    for bits in (1, 5, 9):  # a range lies in one run, in two, in many
        monkeypatch.setattr(merkle, "RUN_BITS", bits)
        assert sorted(map(tuple, tree_of(rows).collect())) == whole


def test_digests_of_rows_are_not_written(spark, monkeypatch):
    from kvartal.operators import numbering

    written = []

    def noted(materialise):
        return lambda df, label: written.append(df.columns) or materialise(df, label)

    monkeypatch.setattr(numbering, "materialise", noted(numbering.materialise))
    assert tag_of(tree_of(street_rows(spark, 300))).rows == 300
    assert written and not any("digest" in columns for columns in written)


# --- change propagation ----------------------------------------------------------------------------------

REGISTER = "search_norm string, number_int smallint, number_suffix string, entrance string, district_code string"


def random_register(rng, streets=12):
    return {
        (f"s{rng.randrange(streets)}", rng.randrange(1, 6), rng.choice(["", "А"]), rng.choice(["", "1"])): rng.choice(["01", "02"])
        for _ in range(40)
    }


def changed_register(rng, register):
    out = dict(register)
    for key in rng.sample(sorted(out), 3):
        out[key] = rng.choice(["01", "02", "03"])
    del out[rng.choice(sorted(out))]
    return out | dict([rng.choice(sorted(random_register(rng).items()))])


def restamp_tables(spark, rng):
    streets = [(i, "c", f"ГР.ВАРНА УЛ.S{i}", "p", "УЛ.", f"s{i}") for i in range(14)]
    addresses = [
        (100 + i, rng.randrange(14), rng.randrange(1, 6), rng.choice([None, "А"]), rng.choice([None, "1"]), rng.choice([None, None, "05"]), None)
        for i in range(120)
    ]
    insts = [
        (i, f"E{i}", "n", rng.choice(["nursery", "kindergarten", "preschool"]), "u",
         rng.choice([None, f"ГР.ВАРНА УЛ.S{rng.randrange(14)} {rng.randrange(1, 6)}", "?"]), rng.choice([None, "04"]), False, None)
        for i in range(1, 31)
    ]
    edges = {(100 + rng.randrange(120), rng.randrange(1, 24)) for _ in range(60)}
    return (
        spark.createDataFrame(addresses, ADDRESSES), spark.createDataFrame(streets, STREETS),
        spark.createDataFrame(insts, INSTITUTIONS), spark.createDataFrame(sorted(edges), EDGE),
    )


def register_rows(spark, register, prefix=""):
    return spark.createDataFrame([(prefix + k[0], *k[1:], d) for k, d in sorted(register.items())], REGISTER)


def rows_of(df, schema):
    return sorted(map(repr, df.select(*schema.names).collect()))


@pytest.mark.parametrize("seed", range(2))
def test_changes_equal_a_full_restamp(spark, seed):
    rng = random.Random(seed)
    addresses, streets, insts, edges = restamp_tables(spark, rng)
    first = random_register(rng)
    later = changed_register(rng, first)
    # One-line addresses are looked up by their own search key.
    both = lambda r: register_rows(spark, r).unionByName(register_rows(spark, r, "gr.varna ul."))
    old, new = lookup.build_tiers(both(first)), lookup.build_tiers(both(later))

    def full(a, i, tiers):
        a = materialise(lookup.stamp_addresses(a, streets, tiers, restamp=True).select(*ADDRESSES.names), "a")
        return a, materialise(lookup.stamp_institutions(i, edges, a, tiers, restamp=True).select(*INSTITUTIONS.names), "i")

    base = full(addresses, insts, old)
    changed = restamp.changed_keys(old, new)
    moved = restamp.address_changes(base[0], streets, old, new, changed)
    got_addresses = restamp.apply_changes(base[0], moved)
    stamped = restamp.institution_changes(base[1], edges, base[0], moved, new, changed)
    expected = full(*base, new)
    assert rows_of(got_addresses, ADDRESSES) == rows_of(expected[0], ADDRESSES)
    assert rows_of(restamp.apply_changes(base[1], stamped), INSTITUTIONS) == rows_of(expected[1], INSTITUTIONS)
    assert 0 < moved.count() < 120 and stamped.count() < 30
    none = restamp.changed_keys(old, old)
    assert restamp.address_changes(base[0], streets, old, old, none).count() == 0


def test_restamp_changes_job(spark, tmp_path):
    rng = random.Random(9)
    addresses, streets, insts, edges = restamp_tables(spark, rng)
    first = random_register(rng)
    later = changed_register(rng, first)
    results = []
    for job in (refresh.restamp, refresh.restamp_changes):
        root = str(tmp_path / job.__name__)
        tables = Tables(spark, root)
        schema = schemas.REGISTER

        def register(rows, now):
            full = register_rows(spark, rows)
            for field in schema:
                if field.name not in full.columns:
                    full = full.withColumn(field.name, F.lit("0").cast(field.dataType))
            return now.stage("register", full, schema)

        tables.publish({
            "addresses": tables.stage("addresses", addresses, ADDRESSES), "streets": tables.stage("streets", streets, STREETS),
            "institutions": tables.stage("institutions", insts, INSTITUTIONS),
            "address_institutions": tables.stage("address_institutions", edges, schemas.TABLES["address_institutions"]),
            "register": register(first, tables),
        })
        metrics = {(r.section, r.metric) for r in refresh.restamp_changes(spark, root).collect()}
        assert ("addresses_district", "tier1") in metrics  # nothing is recorded yet: all rows
        second = Tables(spark, root)
        second.publish({"register": register(later, second)})
        metrics = {(r.section, r.metric): r.value for r in job(spark, root).collect()}
        if job is refresh.restamp_changes:
            assert 0 < metrics["addresses_district", "reached"] < 120
        now = Tables(spark, root)
        results.append([rows_of(now.read(n, s), s) for n, s in (("addresses", ADDRESSES), ("institutions", INSTITUTIONS))])
        # Another publish in between: all rows again.
        now.replace("addresses", now.read("addresses", ADDRESSES), ADDRESSES)
        assert ("addresses_district", "tier1") in {(r.section, r.metric) for r in refresh.restamp_changes(spark, root).collect()}
    assert results[0] == results[1]


# --- one-shuffle look-up -------------------------------------------------------------------------------------

TARGET = "id long, search_norm string, number_int int, number_suffix string, entrance string, district_code string"


def asking_rows(rng, n):
    """Half of the rows on one street, a third in one of its houses; some without street or number."""
    rows = []
    for i in range(n):
        street, number = rng.choice([("s0", 3), ("s0", rng.randrange(1, 8)), ("s0", 3), (f"s{rng.randrange(9)}", rng.randrange(1, 8)), (None, 3), ("s1", None)])
        rows.append((i, street, number, rng.choice([None, "", "А", "Б"]), rng.choice([None, "", "1", "2"]), rng.choice([None, None, "09"])))
    return rows


@pytest.mark.parametrize("seed, sample", [(1, 1.0), (2, 0.0)])
def test_one_pass_finds_what_the_joins_find(spark, seed, sample, monkeypatch):
    monkeypatch.setattr(prefix_lookup, "SAMPLE", sample)
    monkeypatch.setattr(prefix_lookup, "HOT", 10)
    rng = random.Random(seed)
    target = spark.createDataFrame(asking_rows(rng, 1500), TARGET).repartition(5)
    register = random_register(rng, 9)
    tiers = lookup.build_tiers(register_rows(spark, register))
    if sample:
        hot = prefix_lookup._hot_pairs(target, "search_norm", "number_int").collect()
        assert ("s0", 3) in {(r._k1, r._k2) for r in hot} and len(hot) <= 10
    for asked in (None, F.col("district_code").isNull()):
        plain, merged = (
            sorted(map(repr, match(target, tiers, ("number_suffix", "entrance"), asked).collect()))
            for match in (lookup.match_tiers, prefix_lookup.match_in_one_pass)
        )
        assert plain == merged
    for restamp_all in (True, False):
        both = [
            sorted(map(repr, lookup.stamp_by_tiers(target, tiers, restamp=restamp_all, match=m).collect()))
            for m in (lookup.match_tiers, prefix_lookup.match_in_one_pass)
        ]
        assert both[0] == both[1]


def test_one_pass_moves_the_target_once(spark):
    rng = random.Random(4)
    target = spark.createDataFrame(asking_rows(rng, 300), TARGET)
    tiers = lookup.build_tiers(register_rows(spark, random_register(rng)))
    found = prefix_lookup.match_in_one_pass(target, tiers, ("number_suffix", "entrance"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1
    physical = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in physical and "ShuffledHashJoin" not in physical
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert executed.count("hashpartitioning(_k_search_norm") == 1
    with pytest.raises(ValueError):
        prefix_lookup.match_in_one_pass(target, lookup.Tiers((("a", "b"), ("b",)), "c", tiers.tables[:2]))


def test_of_two_writers_one_publishes(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "id long")
    first, second = Tables(spark, str(tmp_path)), Tables(spark, str(tmp_path))
    assert first.versions() == second.versions() == {}
    staged = [t.stage("t", rows) for t in (first, second)]
    first.publish({"t": staged[0]})
    # The second one has seen nothing of it: the number it wants is taken.
    with pytest.raises(MovedTables):
        second.publish({"t": staged[1]})
    assert Tables(spark, str(tmp_path)).versions() == {"t": staged[0]}
    first.publish({"t": staged[1]})
    assert Tables(spark, str(tmp_path)).versions() == {"t": staged[1]}


# --- substrings --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_contains(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abаб %_\\") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 25))) for i in range(150)] + [(900, None), (901, "aaaaaaaaaa"), (901, "aaaaaaaaaa")]
    strings = [word(rng.randrange(0, 7)) for _ in range(60)] + ["", "a", "aaa", "aaaa", "zzz", None, "aaa"]
    got = substrings.substring_matches(
        spark.createDataFrame(texts, "id long, search_norm string"), spark.createDataFrame([(s,) for s in strings], "string string")
    ).collect()
    expected = {(s, i) for s in strings if s is not None for i, t in texts if t is not None and s in t}
    assert len(got) >= len(expected) and {tuple(r) for r in got} == expected


def test_exploded_texts_are_not_broadcast(spark, tmp_path):
    """Their size is guessed from the texts' files, so only the strings that are asked for may be."""
    path = str(tmp_path / "texts")
    spark.range(2000).selectExpr("id", "concat('street ', id) AS text").write.parquet(path)
    texts = spark.read.parquet(path)
    strings = spark.range(500_000).selectExpr("concat(id, '') AS string")
    for found in (substrings._postings(texts, strings.toDF("gram")), substrings._short(texts, strings, 2)):
        assert "BuildLeft" not in found._jdf.queryExecution().sparkPlan().toString()


def test_search_addresses_takes_all_searches(spark):
    streets = spark.createDataFrame([(1, "c", "Raw A", "p", None, "lipa alley"), (2, "c", "Raw B", "p", None, "alley lipa")], STREETS)
    addresses = spark.createDataFrame([(n, 1 + n % 2, n, None, None, "01", None) for n in range(1, 7)], ADDRESSES)
    searches = spark.createDataFrame([(1, "lipa a", None), (2, "lipa", 3), (3, "none", None), (4, "y", 2)], "search_id long, string string, number int")
    got = {(r.search_id, r.id) for r in substrings.search_addresses(streets, addresses, searches).collect()}
    assert got == {(1, 2), (1, 4), (1, 6), (2, 3), (4, 2)}
    for text, number in [("lipa a", None), ("lipa", 3), ("y", 2)]:
        plain = browse.search_streets_substring(streets, addresses, text, number)
        (search,) = [s for s, t, n in [(1, "lipa a", None), (2, "lipa", 3), (4, "y", 2)] if t == text]
        assert {r.id for r in plain.collect()} == {i for s, i in got if s == search}


def test_strings_of_one_shape_share_their_pieces(spark, monkeypatch):
    """Many strings with the same rarest trigram at the same place ask for one piece of a text, not one each."""
    names = [f"{letter}qz {number}" for letter in "abcdefghijkl" for number in range(10, 90)]
    texts = spark.createDataFrame([*enumerate(names), (1000, None)], "id long, search_norm string")
    strings = spark.createDataFrame([(n,) for n in [*names, "aqz 90", None]], "string string")
    written, write = {}, substrings.materialise

    def kept(df, label):
        written[label] = write(df, label)
        return written[label]

    monkeypatch.setattr(substrings, "materialise", kept)
    found = {(r.string, r.id) for r in substrings.substring_matches(texts, strings).collect()}
    assert found == {(n, i) for i, n in enumerate(names)}
    assert written["gram-shapes"].count() <= 81



# --- split JSON ------------------------------------------------------------------------------------------------

NASTY = ["a,b", "{[", "}],", 'say "hi", {', "back\\slash", '\\",', "tab\t", "é,ü\n,", "", ']}', ',"institutions":[', 'x\\\\,\\"']


def random_value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return [rng.choice(NASTY), rng.randrange(1000), rng.choice([None, True, 1.5])][kind]
    if kind == 3:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(NASTY) + str(i): random_value(rng, depth + 1) for i in range(rng.randrange(4))}


def random_document(rng):
    listed = [
        random_value(rng) if rng.random() < 0.2 else
        {"external_id": str(i), "name": rng.choice(NASTY), "address_entries": [{"street": rng.choice(NASTY), "number": "1"} for _ in range(rng.randrange(3))]}
        for i in range(rng.choice([0, 1, 30]))
    ]
    doc = {"schema_version": 1, "scraped_at": "2026-01-01T00:00:00Z", "city": rng.choice(NASTY)}
    if rng.random() < 0.3:
        doc["extra"] = {"a": {"b": [1, {"c": "},{"}]}, "d": [{"x": 1}, {"y": 2}]}
    if rng.random() < 0.9:
        doc["institutions"] = listed if rng.random() < 0.9 else {"a": 1, "b": [1, 2]}
    members = list(doc.items())
    rng.shuffle(members)
    return json.dumps(dict(members), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 2]))


def test_split_documents_equal_whole_ones(spark, tmp_path):
    rng = random.Random(3)
    for n in range(40):
        text = random_document(rng)
        text = {20: '{"institutions": [ \n ], "city": "x"}', 21: '{"institutions":[null]}', 22: ' {"city":"x" }\n', 23: "[1, 2]"}.get(n, text)
        (tmp_path / f"{n:02}.json").write_text(text[:-2] if n == 9 else text + "\n" if n == 10 else text)
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 30
        split = materialise(split_json.read_snapshot_splits(spark, str(tmp_path)), "split")
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    whole = snapshot.read_snapshots(spark, str(tmp_path))
    name = F.regexp_extract("doc", r"(\d+\.json)", 1).alias("file")

    def listed(docs, order):
        out = {}
        for r in snapshot.raw_institutions(docs).select(name, F.col(order).alias("at"), "inst_raw", "scraped_at").orderBy("at").collect():
            out.setdefault(r.file, []).append((r.inst_raw, r.scraped_at))
        return out

    def envelopes(docs):
        return {tuple(r) for r in snapshot.envelopes(docs).select(name, "schema_version", "scraped_at", "city").collect()}

    expected = listed(whole, "inst_pos")
    assert sum(map(len, expected.values())) > 90 and listed(split, "doc") == expected
    assert envelopes(split) == envelopes(whole)
    assert split.where("doc LIKE '%09.json%'").select("raw").collect() == [("{",)]


# --- constraints ----------------------------------------------------------------------------------------------


def test_constraints_in_one_scan_per_table(spark):
    addresses = spark.createDataFrame([
        (1, 1, 1, None, None, "01", None), (1, 2, None, None, None, "77", None), (1, 9, 3, "А", "1", None, None),
        (2, 9, 3, "А", "1", None, None), (None, None, 4, None, None, None, None), (None, 1, 1, None, None, None, None),
    ], "id long, street_id long, number_int int, number_suffix string, entrance string, district_code string, settlement_code string")
    streets = spark.createDataFrame([(1, "c", "r", "p", None, "n"), (2, "c", "r", "p", None, "n")], STREETS)
    report = quality.constraint_report({"addresses": addresses, "streets": streets})
    got = {(r.table, r.rule, r.columns): r.violations for r in report.collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("addresses", "duplicate_key", "id"): 2, ("addresses", "not_null", "id"): 2, ("addresses", "not_null", "street_id"): 1,
        ("addresses", "not_null", "number_int"): 1, ("addresses", "enum", "district_code"): 1,
        ("addresses", "duplicate_key", "street_id,number_int,number_suffix,entrance"): 1,
        ("addresses", "orphan", "street_id"): 2, ("streets", "duplicate_key", "raw_name"): 1,
    }
    rules = quality.RULES
    assert len(got) == sum(
        len(rules[t].required) + len(rules[t].enums) + len(quality.MAX_LENGTHS.get(t, {})) + len(rules[t].keys)
        + len(rules[t].optional_keys) + len(rules[t].references) for t in ("addresses", "streets")
    )
    scans = report._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")
    assert scans == 2
    assert {tuple(r) for r in quality.duplicate_keys(addresses, ["id"]).collect()} == {(1, 3), (None, 2)}
    assert quality.orphans(addresses, "street_id", streets).count() == 2
    empty = quality.constraint_report({"addresses": addresses.limit(0), "streets": streets.limit(0)})
    assert {r.violations for r in empty.collect()} == {0}


def test_discarded_tables_are_gone(spark, tmp_path):
    rows = materialise(spark.range(10).withColumn("x", F.col("id") * 2), "to-go")
    kept = materialise(rows.where("id > 3"), "to-stay")
    outside = str(tmp_path / "other" / "t")
    rows.write.parquet(outside)
    folder = rows.inputFiles()[0].rpartition("/")[0].removeprefix("file://").removeprefix("file:")
    assert Path(folder).is_dir()
    discard(rows)
    discard(spark.read.parquet(outside))
    assert not Path(folder).exists() and spark.read.parquet(outside).count() == 10 and kept.count() == 6
