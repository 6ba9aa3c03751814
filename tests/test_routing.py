import json

import pytest
from pyspark.sql import functions as F

from kvartal.operators import browse, quality, responses, routing
from kvartal.schemas import ADDRESSES, INSTITUTIONS, REGISTER, STREETS, settlements_dim
from kvartal.sources import dump

EDGE = "address_id long, institution_id long"


def inst(id, external, name, kind, district, infant=False):
    return (id, external, name, kind, f"https://x/{external}", None, district, infant, None)


def address(id, district, settlement, street=1, number=1, suffix=None, entrance=None):
    return (id, street, number, suffix, entrance, district, settlement)


INSTS = [
    inst(11, "Z1", "Врабче", "nursery", "03"),
    inst(12, "Z2", "Бряст", "nursery", "05"),
    inst(13, "Z3", "Калина", "nursery", None),
    inst(21, "D1", "Щурче", "kindergarten", "03", True),
    inst(22, "D2", "Мак", "kindergarten", "05"),
    inst(23, "D3", "Незабравка", "kindergarten", None, True),
    inst(31, "U1", "Извор", "preschool", "03"),
    inst(32, "U2", "Роса", "preschool", "05"),
    inst(33, "U3", "Хвойна", "preschool", "05"),
]
ADDRS = [
    address(101, "03", "10135"), address(102, "05", "10135"), address(103, "05", None),
    address(104, None, None), address(105, None, "35701"), address(106, None, "10135"),
]
EDGES = [(103, 21), (104, 33), (106, 23), (101, 32), (102, 22), (101, 21), (101, 12)]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(ADDRS, ADDRESSES), spark.createDataFrame(EDGES, EDGE),
        spark.createDataFrame(INSTS, INSTITUTIONS),
    )


def offers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.address_id, []).append(
            (r.rank, r.external_id, r.reception_kind, r.offering, r.match_basis)
        )
    return {k: [o[1:] for o in sorted(v)] for k, v in out.items()}


def near(name, kind):
    return (name, kind, "standard", "district")


def own(name, kind, offering="standard"):
    return (name, kind, offering, "address")


EXPECTED = {
    101: [near("Z1", "nursery"), own("D1", "nursery", "infant_group"), own("D1", "kindergarten"),
          own("U2", "preschool")],
    102: [near("Z2", "nursery"), own("D2", "kindergarten"), near("U2", "preschool"),
          near("U3", "preschool")],
    103: [near("Z2", "nursery"), own("D1", "nursery", "infant_group"), own("D1", "kindergarten"),
          near("U2", "preschool"), near("U3", "preschool")],
    104: [own("U3", "preschool")],
    106: [own("D3", "nursery", "infant_group"), own("D3", "kindergarten")],
}


def only(letter):
    found = {a: [o for o in offered if o[0][0] == letter] for a, offered in EXPECTED.items()}
    return {a: offered for a, offered in found.items() if offered}


BY_KIND = {None: EXPECTED, "nursery": only("Z"), "kindergarten": only("D"), "preschool": only("U")}


@pytest.mark.parametrize("kind", BY_KIND)
def test_routes(tables, kind):
    expanded = routing.expand_offerings(routing.route_addresses(*tables, kind=kind))
    assert offers(routing.rank_offerings(expanded)) == BY_KIND[kind]


@pytest.mark.parametrize("kind, page_size, pages", [
    (None, 10, {0}), ("preschool", 10, {0}), (None, 2, {0, 1, 2}), ("preschool", 1, {0, 1}),
])
def test_response(spark, tables, kind, page_size, pages):
    got, seen = {}, set()
    response = responses.routing_response(*tables, settlements_dim(spark), kind, page_size)
    for r in response.orderBy("page_no").collect():
        assert r.address.id == r.address_id and len(r.results) <= page_size
        got.setdefault(r.address_id, []).extend(
            (o.external_id, o.reception_kind, o.offering, o.match_basis) for o in r.results
        )
        seen.add(r.page_no)
        if r.address_id == 105:
            assert (r.address.settlement.code, r.address.settlement.locality_type) == ("35701", "village")
        if r.address_id == 104:
            assert r.address.settlement is None
    assert got == {a: BY_KIND[kind].get(a, []) for a in range(101, 107)}
    assert seen == pages


def test_more_institutions_change_no_page_of_others(spark, tables):
    """The number of institutions never decides the form of a response."""
    addresses, edges, insts = tables
    many = spark.range(300).selectExpr(
        "id + 1000 AS id", "concat('X', id) AS external_id", "concat('Ябълка ', id) AS name",
        "'preschool' AS kind", "'u' AS source_url", "cast(null AS string) AS address",
        "'01' AS district_code", "false AS has_infant_group", "cast(null AS timestamp) AS last_seen_at",
    )
    wide = insts.unionByName(many.select(insts.columns))
    settlements = settlements_dim(spark)

    def rows(institutions):
        response = responses.routing_response(addresses, edges, institutions, settlements, page_size=3)
        return sorted(map(repr, response.collect()))

    assert rows(insts) == rows(wide)


def test_district_roster(tables):
    roster = routing.district_roster(tables[2], "nursery", "preschool").orderBy("district_code", "rank")
    assert [(r.district_code, r.external_id, r.rank) for r in roster.collect()] == [
        ("03", "Z1", 1), ("03", "U1", 2), ("05", "Z2", 1), ("05", "U2", 2), ("05", "U3", 3),
    ]


def test_wanted_addresses_only(tables):
    addresses, edges, insts = tables
    routed = routing.route_addresses(addresses.where("id = 103"), edges, insts)
    assert {r.address_id for r in routed.collect()} == {103}


def test_profile_pages_and_order(spark):
    streets = spark.createDataFrame([
        (1, "Б", "Б ул", "p", None, "n"), (2, "А", "Я ул", "p", "УЛ.", "n"),
        (3, "А", "А ул", "p", "УЛ.", "n"),
    ], STREETS)
    addresses = spark.createDataFrame([
        address(11, None, None, 3, 2), address(12, None, None, 3, 1),
        address(13, None, None, 3, 2, "А"), address(14, None, None, 3, 2, "А", "1"),
        address(15, None, None, 3, 2, None, "1"), address(16, None, None, 2, 5),
        address(17, None, None, 1, 9),
    ], ADDRESSES)
    edges = spark.createDataFrame([(a, 11) for a in range(11, 18)], EDGE)
    insts = spark.createDataFrame(INSTS[:2], INSTITUTIONS)

    def profile(page_size):
        out = {}
        rows = browse.institution_profile(insts, edges, addresses, streets, page_size)
        for r in rows.orderBy("id", "page_no").collect():
            out[r.id, r.page_no] = [(g.street.id, [a.id for a in g.addresses]) for g in r.coverage]
        return out

    assert profile(100) == {
        (11, 0): [(3, [12, 14, 13, 15, 11]), (2, [16]), (1, [17])], (12, 0): [],
    }
    assert profile(3) == {
        (11, 0): [(3, [12, 14, 13])], (11, 1): [(3, [15, 11]), (2, [16])], (11, 2): [(1, [17])],
        (12, 0): [],
    }


def test_profile_of_edges_that_lead_nowhere(spark, tables):
    """An institution all of whose edges lead to unknown addresses is listed, with an empty page."""
    addresses, _, _ = tables
    streets = spark.createDataFrame([(1, "А", "А ул", "p", None, "n")], STREETS)
    edges = spark.createDataFrame([(101, 11), (999, 12), (998, 12)], EDGE)
    insts = spark.createDataFrame(INSTS[:3], INSTITUTIONS)
    rows = browse.institution_profile(insts, edges, addresses, streets)
    assert sorted((r.id, r.page_no, [a.id for g in r.coverage for a in g.addresses]) for r in rows.collect()) == [
        (11, 0, [101]), (12, 0, []), (13, 0, []),
    ]


# By kind in listing order, then by name.
LISTED = [12, 11, 13, 22, 23, 21, 31, 32, 33]


def test_listings(spark, tables):
    addresses, _, insts = tables
    assert [r.id for r in browse.list_institutions(insts).collect()] == LISTED
    nulls_last = spark.createDataFrame([
        address(1, None, None, 1, 5), address(2, None, None, 1, 5, "А"),
        address(3, None, None, 1, 5, "А", "1"), address(4, None, None, 1, 4),
    ], ADDRESSES)
    assert [r.id for r in browse.list_addresses(nulls_last).collect()] == [4, 3, 2, 1]
    streets = spark.createDataFrame(
        [(1, "Я", "А", "", None, "vaptsarov"), (2, "А", "Я", "", None, "x"), (3, "А", "Б", "", None, "x")],
        STREETS,
    )
    assert [r.id for r in browse.list_streets(streets).collect()] == [3, 2, 1]
    found = browse.search_streets_substring(streets, addresses, "aptsar", 1)
    assert found.count() == 6
    assert browse.search_streets_substring(streets, addresses, "vapcarov").count() == 0


def test_dump_and_fingerprint(spark):
    streets = spark.createDataFrame([(2, "А", "Я", "", None, "k"), (1, "А", "Б", "п", "УЛ.", "k")], STREETS)
    columns = browse.STREET_COLUMNS
    lines = [r.value for r in dump.ordered_dump(streets, columns, browse.street_order()).collect()]
    assert [json.loads(x)["id"] for x in lines] == [1, 2]
    assert lines[1] == '{"id":2,"city":"А","raw_name":"Я","street_part":"","type_marker":null}'

    def tag(df, order="streets"):
        return dump.content_fingerprint(df, columns, order).first().tag

    first = tag(streets)
    assert len(first) == 19 and first.startswith("v1-")
    assert tag(streets.repartition(3).orderBy("id")) == first
    assert tag(streets.replace("УЛ.", "БУЛ.")) != first
    assert tag(streets.limit(1)) != first and tag(streets.union(streets)) != first
    assert tag(streets, "other order") != first
    assert tag(streets.withColumn("search_norm", streets.city)) == first


def test_dumped_times_are_in_utc(spark):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP '2025-11-02T08:30:00+02:00' AS seen, CAST(NULL AS STRING) AS note")
    (line,) = dump.ordered_dump(df, ("id", "seen", "note"), [F.col("id")]).collect()
    assert line.value == '{"id":1,"seen":"2025-11-02T06:30:00.000000Z","note":null}'


CLEAN = (
    [address(1, "01", "10135"), address(2, None, "35701")],
    [INSTS[0], INSTS[3], INSTS[6]], [(1, 21), (1, 31)],
)


@pytest.mark.parametrize("change, metric", [
    (None, None),
    (("a", address(3, None, None)), "no_settlement_no_district_addresses"),
    (("a", address(3, "01", "99999")), "unknown_settlement_codes"),
    (("i", inst(9, "Z9", "n", "nursery", None)), "nursery_without_district"),
    (("e", (2, 11)), "nursery_coverage_edges"),
    (("i", inst(9, "X", "n", "infant", "01")), "invalid_institution_kinds"),
    (("i", inst(9, "X", "n", None, "01")), "invalid_institution_kinds"),
    (("a", address(3, "99", "10135")), "invalid_address_district_codes"),
])
def test_validation_failures(spark, change, metric):
    a, i, e = (list(x) for x in CLEAN)
    if change:
        {"a": a, "i": i, "e": e}[change[0]].append(change[1])
    report = quality.match_data_report(
        spark.createDataFrame(a, ADDRESSES), settlements_dim(spark),
        spark.createDataFrame(i, INSTITUTIONS), spark.createDataFrame(e, EDGE),
    ).collect()
    failures = {r.metric for r in report if r.severity == "failure" and r.value}
    assert failures == ({metric, "failed"} if metric else set())
    assert {r.value for r in report if r.severity == "warning"} == {0}


def test_warnings_do_not_fail(spark):
    report = quality.match_data_report(
        spark.createDataFrame([address(1, None, "10135")], ADDRESSES), settlements_dim(spark),
        spark.createDataFrame([INSTS[0]], INSTITUTIONS), spark.createDataFrame([], EDGE),
    ).collect()
    assert {r.metric: r.value for r in report if r.severity == "warning"} == {
        "city_without_district": 1, "zero_infant_group_kindergartens": 1,
        "zero_kindergarten_edges": 1, "zero_preschool_edges": 1,
    }
    assert {r.value for r in report if r.severity == "failure"} == {0}


def test_constraints_and_null_rate(spark):
    addresses = spark.createDataFrame([
        address(1, "01", "10135", 1, 5, "А", "1"), address(2, "77", "10135", 1, 5, "А", "1"),
        address(3, None, "10135", 9, 5), address(4, None, None, 1, 5), address(5, None, None, 1, 5),
    ], ADDRESSES)
    streets = spark.createDataFrame([(1, "c" * 65, "r", "", None, "n"), (2, "c", "r", "", None, None)], STREETS)
    cell = ["00217", "УЛ.ЛЮЛЯК", "gr.varna ul.lyulyak", 3, "", "", "04", "РАЙОН", "10135", 1]
    wrong = [*cell[:5], None, "09", "Р" * 65, *cell[8:]]
    places = settlements_dim(spark)
    report = quality.constraint_report({
        "institutions": spark.createDataFrame([*INSTS, INSTS[0]], INSTITUTIONS).fillna({"name": ""}),
        "streets": streets, "addresses": addresses,
        "address_institutions": spark.createDataFrame([(1, 11), (1, 11), (9, 11), (1, 99)], EDGE),
        "register": spark.createDataFrame([cell, cell, wrong], REGISTER),
        "settlements": places.union(places.limit(1)).replace("ВАРНА", "В" * 65).replace("city", "hamlet"),
    })
    found = {(r.table, r.rule, r["columns"]): r.violations for r in report.collect() if r.violations}
    assert found == {
        ("institutions", "duplicate_key", "id"): 1,
        ("institutions", "duplicate_key", "external_id,kind"): 1,
        ("register", "not_null", "entrance"): 1, ("register", "enum", "district_code"): 1,
        ("register", "too_long", "district_name"): 1,
        ("settlements", "duplicate_key", "code"): 1, ("settlements", "enum", "locality_type"): 2,
        ("settlements", "too_long", "municipality_name"): 7,
        ("institutions", "not_null", "last_seen_at"): 10,
        ("streets", "duplicate_key", "raw_name"): 1, ("streets", "too_long", "city"): 1,
        ("streets", "not_null", "search_norm"): 1,
        ("addresses", "duplicate_key", "street_id,number_int,number_suffix,entrance"): 1,
        ("addresses", "enum", "district_code"): 1, ("addresses", "orphan", "street_id"): 1,
        ("address_institutions", "duplicate_key", "address_id,institution_id"): 1,
        ("address_institutions", "orphan", "address_id"): 1,
        ("address_institutions", "orphan", "institution_id"): 1,
    }
    rates = quality.null_rate_report(addresses).first()
    assert tuple(rates) == (3, 2, 5, 3, 1, True)
