import json
import re

import pytest
from pyspark.sql import functions as F

from kvartal.operators import carry, contract, fuzzy, standardise
from kvartal.schemas import REGISTER, settlements_dim
from kvartal.sources import register, snapshot
from kvartal.sources.tables import Tables

HEADER = (
    "област 03 ВАРНА               община 06 ВАРНА               "
    "район {0}       {1}       секция {2}"
)


def data(code, name, cells):
    return f" {code} {name}".ljust(38) + cells


def more(cells):
    return " " * 38 + cells


REPORT = [
    "                       КЛАСИФИКАТОР НА АДРЕСИТЕ ПО СЕКЦИИ",
    "  01.04.2026  ",
    data("00001", "УЛ.ПРЕДИ ЗАГЛАВИЕ", "001"),
    more("002"),
    HEADER.format("05_АСПАРУХОВО", "10135 ГР.ВАРНА", "281"),
    "  код   име на пътна артерия    номер",
    "----- ----- -----",
    more("088"),  # no street yet in this section
    # A name that reaches past its column, one blank before its cells.
    " 00512 УЛ.ПРОФЕСОР Д-Р ЯБЪЛКА КРУШЕВА 009,014",
    data("00640", "УЛ.ЗЕЛЕНА МЕТЛА", "021,022,"),
    more("023,031,"),
    "58",
    more("032"),
    data("00641", "УЛ.СЧУПЕНА", "abc"),  # malformed: the street before goes on
    more("033"),
    HEADER.format("02_ПРИМОРСКИ", "10135 ГР.ВАРНА", "017").replace("област", "ОБЛАСТ"),
    more("144"),
    # Six digits, of which the last five count; a suffix, an entrance, and both written apart.
    data("204417", "УЛ.Ц.Ю.ЩЪРКЕЛОВ", "011 Б,026В,035 7, 013 Г"),
    more("013 Ж"),
    data("8765", "М-СТ ДОЛНА ЧЕШМА", "016Б,016В"),  # four digits are filled up
    data("54321", "УЛ.ДЪЛГА", "45000,006 ГДЕЖЗ"),  # a number and an entrance that don't fit
    "текст, който не е ред",
]
EXPECTED = [
    ("00512", 9, "", ""), ("00512", 14, "", ""),
    *(("00640", number, "", "") for number in (21, 22, 23, 31, 32, 33)),
    ("04417", 11, "", "Б"), ("04417", 26, "В", ""), ("04417", 35, "", "7"), ("04417", 13, "", "Г"),
    ("04417", 13, "", "Ж"), ("08765", 16, "Б", ""), ("08765", 16, "В", ""),
]
KEY = ["street_code", "number_int", "number_suffix", "entrance"]


@pytest.mark.parametrize("line_end", ["\r\n", "\n", "\x0c\n", "\x1e"])
def test_register_report(spark, tmp_path, line_end):
    path = tmp_path / "report.txt"
    path.write_bytes(line_end.join(REPORT).encode("cp1251"))
    rows = register.read_register(spark, str(path))
    kept = standardise.accepted(rows).collect()
    assert sorted(tuple(r[k] for k in KEY) for r in kept) == sorted(EXPECTED)
    assert standardise.quarantined(rows).count() == 2
    by_code = {r.street_code: r for r in kept}
    row = by_code["04417"]
    assert (row.district_code, row.district_name, row.settlement_code, row.section_no) == (
        "02", "ПРИМОРСКИ", "10135", 17,
    )
    assert row.search_norm == "gr.varna ul.ts.yu.shtarkelov"
    assert by_code["00512"].street_raw == "УЛ.ПРОФЕСОР Д-Р ЯБЪЛКА КРУШЕВА"
    assert by_code["00512"].section_no == 281


def test_state_is_carried_over_splits_and_chunks(spark, tmp_path, monkeypatch):
    """Small splits and chunks: the header and the street reach lines far below them."""
    monkeypatch.setattr(register, "CHUNK_BITS", 2)
    monkeypatch.setattr(carry, "SPAN_BITS", 2)
    lines = [HEADER.format("05_АСПАРУХОВО", "10135 ГР.ВАРНА", "1"), data("00001", "УЛ.ДЪЛГА", "001")]
    lines += [more(f"{n:03d}") for n in range(2, 800)]
    lines += [HEADER.format("04_МЛАДОСТ", "10135 ГР.ВАРНА", "2"), more("900"), data("00002", "УЛ.Б", "1")]
    path = tmp_path / "long.txt"
    path.write_bytes("\n".join(lines).encode("cp1251"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert register.read_report(spark, str(path)).select("block").distinct().count() > 4
        rows = register.read_register(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = sorted(r.number_int for r in rows if r.street_code == "00001")
    assert first == list(range(1, 800))
    assert [(r.number_int, r.district_code) for r in rows if r.street_code == "00002"] == [(1, "04")]


def test_undefined_byte_aborts(spark, tmp_path):
    path = tmp_path / "bad.txt"
    path.write_bytes(b"abc\x98def\n")
    with pytest.raises(Exception, match="not a windows-1251 file"):
        register.read_register(spark, str(path)).count()


def test_replace_table(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    assert tables.read("register", REGISTER).count() == 0
    row = ("00001", "УЛ.Х", "k", 1, "", "", "01", "n", "10135", 1)
    full = spark.createDataFrame([row, row], REGISTER)
    tables.replace("register", full, REGISTER)
    tables.replace("register", full, REGISTER)
    assert tuple(register.load_summary(tables.read("register", REGISTER)).first()) == (2, 1)
    broken = full.withColumn("street_raw", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        tables.replace("register", broken, REGISTER)
    assert tables.read("register", REGISTER).count() == 2
    tables.replace("register", full.limit(0), REGISTER)
    assert tables.read("register", REGISTER).count() == 0


def test_settlements(spark):
    rows = settlements_dim(spark).collect()
    assert len(rows) == 6
    assert [r.code for r in rows if r.locality_type == "city"] == ["10135"]


GOOD = {
    "external_id": "1", "name": "n", "kind": "nursery", "source_url": "https://x.org/1",
    "address_entries": [{"street": "s", "number": "1"}], "address": None, "district_code": "01",
    "has_infant_group": False,
}
ENVELOPE = {"schema_version": 2, "scraped_at": "2026-05-04T01:00:00+02:00", "city": "varna"}


def doc(institutions=None, without=(), **envelope):
    full = {**ENVELOPE, "institutions": [GOOD] if institutions is None else institutions, **envelope}
    return json.dumps({k: v for k, v in full.items() if k not in without})


def one(without=(), **changes):
    row = {k: v for k, v in {**GOOD, **changes}.items() if k not in without}
    return doc([row])


I0, E0 = "institutions[0]", "institutions[0].address_entries[0]"
CONTRACT = {
    doc(): set(),
    doc([]): set(),
    one(without=("address", "district_code"), kind="preschool"): set(),
    one(source_url="HTTPS://X.org"): set(),
    "{bad": {("$", "invalid_json")},
    "[1]": {("$", "invalid_json")},
    doc(without=("schema_version", "city")): {("schema_version", "required"), ("city", "required")},
    doc(without=("institutions",)): {("institutions", "required")},
    doc(institutions={}): {("institutions", "type")},
    doc(["x"]): {(I0, "type")},
    doc(more=1): {("more", "unknown_key")},
    doc(city=5): {("city", "type")},
    doc(city=None): {("city", "type")},
    doc(scraped_at="2026-05-04T01:00:00"): {("scraped_at", "zoned_timestamp")},
    doc(scraped_at="2026-13-04T01:00:00Z"): {("scraped_at", "zoned_timestamp")},
    doc(scraped_at=None): {("scraped_at", "zoned_timestamp")},
    one(external_id=""): {(f"{I0}.external_id", "empty")},
    one(external_id=7): {(f"{I0}.external_id", "type")},
    one(name=None): {(f"{I0}.name", "type")},
    one(kind="school"): {(f"{I0}.kind", "enum")},
    one(source_url="http://x.org"): {(f"{I0}.source_url", "https_url")},
    one(source_url="https://"): {(f"{I0}.source_url", "https_url")},
    one(address=""): {(f"{I0}.address", "empty")},
    one(address=3): {(f"{I0}.address", "type")},
    one(district_code="06"): {(f"{I0}.district_code", "enum")},
    one(district_code=None): {(f"{I0}.district_code", "nursery_needs_district")},
    one(without=("district_code",)): {(f"{I0}.district_code", "nursery_needs_district")},
    one(has_infant_group="true"): {(f"{I0}.has_infant_group", "type")},
    one(without=("has_infant_group", "address_entries")): {
        (f"{I0}.has_infant_group", "required"), (f"{I0}.address_entries", "required"),
    },
    one(address_entries={}): {(f"{I0}.address_entries", "type")},
    one(address_entries=None): {(f"{I0}.address_entries", "type")},
    one(phone="1"): {(f"{I0}.phone", "unknown_key")},
    one(address_entries=[{"street": "", "flat": 1}]): {
        (f"{E0}.street", "empty"), (f"{E0}.number", "required"), (f"{E0}.flat", "unknown_key"),
    },
    one(address_entries=[5]): {(E0, "type")},
    one(address_entries=[{"street": 1, "number": None}]): {
        (f"{E0}.street", "type"), (f"{E0}.number", "type"),
    },
}


def test_contract(spark):
    docs = spark.createDataFrame(
        [(str(n), raw) for n, raw in enumerate(CONTRACT)], "doc string, raw string"
    ).cache()
    found = {str(n): set() for n in range(len(CONTRACT))}
    for r in contract.contract_violations(docs).collect():
        found[r.doc].add((r.path, r.rule))
    assert found == {str(n): rules for n, rules in enumerate(CONTRACT.values())}


def test_contract_looks_once_for_each_member(spark):
    """A member is looked for once, not by each rule; entries are not written as text and parsed again."""
    docs = spark.createDataFrame([("d", doc([]))], "doc string, raw string")
    plan = contract.contract_violations(docs)._jdf.queryExecution().optimizedPlan().toString()
    known = len(contract.ENVELOPE_KEYS) + len(contract.INSTITUTION_KEYS) + len(contract.ENTRY_KEYS)
    assert plan.count("array_contains(") <= known
    assert "to_json" not in plan


def test_entries_of_any_form(spark):
    """Entries travel as parsed: nulls, nested values and numbers are still told from strings."""
    entries = [None, [], {"street": {"a": 1}, "number": [1]}, {"street": "x", "number": "1"}, {"street": None, "number": 1.5}, "text", {}]
    docs = spark.createDataFrame([("d", one(address_entries=entries))], "doc string, raw string")
    at = [f"{I0}.address_entries[{n}]" for n in range(len(entries))]
    expected = {(at[n], "type") for n in (0, 1, 5)}
    expected |= {(f"{at[n]}.{key}", rule) for n, rule in ((2, "type"), (4, "type"), (6, "required")) for key in ("street", "number")}
    assert {(r.path, r.rule) for r in contract.contract_violations(docs).collect()} == expected


def test_contract_is_checked_in_one_pass(spark):
    docs = spark.createDataFrame([("d", doc([]))], "doc string, raw string")
    plan = contract.contract_violations(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1
    twice = doc([GOOD])[:-1] + ', "city": "again"}'
    inner = doc([]).replace("[]", '[{"name": "a", "name": "b"}]')
    docs = spark.createDataFrame([("top", twice), ("in", inner), ("null", None)], "doc string, raw string")
    found = {(r.doc, r.path, r.rule) for r in contract.contract_violations(docs).collect()}
    assert ("in", "institutions[0]", "type") in found and ("null", "$", "invalid_json") in found
    assert {r.doc for r in contract.refused_documents(docs).collect()} >= {"in", "null"}


def test_version_gate(spark):
    versions = {"1": 1, "s": "2", "null": None, "f": 2.5, "ok": 2}
    docs = spark.createDataFrame(
        [(k, doc(schema_version=v)) for k, v in versions.items()]
        + [("absent", doc(without=("schema_version",)))],
        "doc string, raw string",
    )
    refused = {r.doc for r in contract.unsupported_versions(docs).collect()}
    assert refused == {"1", "s", "null", "f"}


def test_snapshot_rows(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(doc([GOOD, {**GOOD, "external_id": "2", "address_entries": []}]))
    docs = snapshot.read_snapshots(spark, str(path))
    top = snapshot.envelopes(docs).first()
    assert (top.schema_version, top.city, str(top.scraped_at)[:13]) == (2, "varna", "2026-05-03 23")
    insts = snapshot.institutions(snapshot.raw_institutions(docs))
    assert sorted(r.external_id for r in insts.collect()) == ["1", "2"]
    entries = snapshot.explode_entries(insts).collect()
    assert [(r.external_id, r.entry_pos, r.street, r.number) for r in entries] == [("1", 0, "s", "1")]


def test_snapshot_lines(spark, tmp_path):
    """A snapshot of one document per line gives the rows of its documents, in line order."""
    insts = [{**GOOD, "external_id": str(n)} for n in range(30)]
    lines = [doc([inst]) for inst in insts]
    (tmp_path / "s.jsonl").write_text("\n".join([*lines[:9], "", "  ", *lines[9:]]) + "\n")
    docs = snapshot.read_snapshot_lines(spark, str(tmp_path / "s.jsonl"))
    assert [r.raw for r in docs.orderBy("doc").collect()] == lines
    assert contract.contract_violations(docs).count() == 0
    read = snapshot.institutions(snapshot.raw_institutions(docs)).collect()
    assert {r.external_id for r in read} == {str(n) for n in range(30)}
    (tmp_path / "empty.jsonl").write_text("")
    assert snapshot.read_snapshot_lines(spark, str(tmp_path / "empty.jsonl")).count() == 0


def brute_trigrams(text):
    out = set()
    for word in re.split(r"[\W_]+", text.lower()):
        padded = f"  {word} "
        out |= {padded[i:i + 3] for i in range(len(word) + 1)} if word else set()
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 0.8, 1.0])
def test_fuzzy_join_equals_all_pairs(spark, threshold):
    words = "gr varna ul bul vapcarov vaptsarov morska morski kapitan admiral a b1 greyg".split()
    texts = [f"{x} {y}" for x in words for y in words] + ["", "..", "vaptsarov"]
    left = spark.createDataFrame([(t,) for t in texts + texts[:50]], "search_norm string")
    right = spark.createDataFrame([(t[::-1],) for t in texts] + [(t,) for t in texts[:60]], "search_norm string")
    expected = {}
    for a in {r[0] for r in left.collect()}:
        for b in {r[0] for r in right.collect()}:
            x, y = brute_trigrams(a), brute_trigrams(b)
            if x and y and len(x & y) * 1000 >= round(threshold * 1000) * len(x | y):
                expected[a, b] = (len(x & y), len(x | y))
    rows = fuzzy.fuzzy_street_join(left, right, threshold).collect()
    assert {(r.left_key, r.right_key): (r.shared, r.total) for r in rows} == expected
    assert len(rows) == len(expected)


def test_carry_forward_brute_force(spark, monkeypatch):
    monkeypatch.setattr(carry, "SPAN_BITS", 2)
    values = [(g, n, n if (n * 7) % 11 == 0 else None) for g in ("a", "b") for n in range(300)]
    df = spark.createDataFrame(values, "file string, place long, mark long").withColumn(
        "run", F.shiftright("place", 3)
    )
    got = carry.carry_forward(df, "file", ("place",), ("run",), {"last": F.col("mark")}).collect()
    assert len(got) == 600
    for r in got:
        seen = [m for g, n, m in values if g == r.file and m is not None and n <= r.place]
        assert r["last"] == max(seen, default=None)


def test_keys_that_share_their_locality_are_compared_within_it(spark):
    """Whole keys of one town all resemble each other; names within a city do not."""
    names = ["липа", "бреза", "явор", "орех", "габър", "клен", "бук", "дъб"]
    keys = spark.createDataFrame(
        [("gr.varna", f"{a}{b}") for a in names for b in names], "city string, name string"
    )
    latin = standardise.add_search_key(keys, "name").select("city", "search_norm")
    found = fuzzy.fuzzy_street_join(latin, latin, within=["city"])
    assert found.columns == ["city", "left_key", "right_key", "shared", "total"]
    pairs = {(r.left_key, r.right_key) for r in found.collect()}
    assert 64 <= len(pairs) < 64 * 8
    other = latin.withColumn("city", F.lit("s. topoli"))
    assert fuzzy.fuzzy_street_join(latin, other, within=["city"]).count() == 0


def test_cell_parts_need_no_pattern(spark):
    """The same parts as one pattern over the cell, and keys made once a street, not once a cell."""
    ws = register.WS
    pattern = rf"^(\d+)([А-Я])?(?:{ws}+([А-Я0-9]+))?\z"
    cells = [f"{n}{s}{e}" for n in ("1", "007", "99999") for s in ("", "А", "Я", "П") for e in ("", " 1", "\u00a0 Б2", "  ЯА", "\t0")]
    rows, *parts = register.cell_parts(spark.createDataFrame([(c,) for c in cells], "_cell string"))
    wanted = [F.regexp_extract("_cell", pattern, n) for n in (1, 2, 3)]
    assert rows.where(~F.col("_cell").rlike(pattern)).count() == 0
    assert rows.select(F.array(*parts).alias("got"), F.array(*wanted).alias("want")).where("got <> want").collect() == []
    lines = spark.createDataFrame([("f", 1, "x")], "file string, position long, line string")
    plan = register.parse_report(lines, place=("position",))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "replace(" not in plan
