"""End-to-end batch: first run, idempotent re-run, change, disappearance, skip, abort."""

import copy
import json

import pytest

from kvartal import schemas
from kvartal.operators.contract import ContractViolation, UnsupportedVersion
from kvartal.plans import ingest as job
from kvartal.plans import refresh
from kvartal.sources.tables import MovedTables, Tables


def inst(external_id, kind, entries, address=None, district=None, infant=False, name=None):
    return {
        "external_id": external_id, "name": name or f"Name {external_id}", "kind": kind,
        "source_url": f"https://example.org/{external_id}",
        "address_entries": [{"street": s, "number": n} for s, n in entries],
        "address": address, "district_code": district, "has_infant_group": infant,
    }


LILAC, SUNRISE, BREEZE = "ГР.ВАРНА УЛ.ЛЮЛЯК", "С. ТОПОЛИ УЛ.ИЗГРЕВ", "ГР.ВАРНА УЛ.ЗЕФИР"
# Three institutions on three streets; the entrance of number 4 is covered by two of them.
SNAPSHOT = {
    "schema_version": 2, "scraped_at": "2025-11-02T06:30:00Z", "city": "varna",
    "institutions": [
        inst("A7", "preschool", [(LILAC, "003"), (LILAC, "4 вх.Б"), (SUNRISE, "15")], "ул. Люляк 3"),
        inst("B2", "nursery", [], "ул. Роза 9", "02"),
        inst("C5", "kindergarten", [(LILAC, "4 вх.Б"), (BREEZE, "21Г")], infant=True),
    ],
}
TABLE_NAMES = ("institutions", "streets", "addresses", "address_institutions")


def run(spark, tmp_path, root, snapshot, name="snapshot"):
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(snapshot, ensure_ascii=False), encoding="utf-8")
    rows = job.ingest(spark, str(path), root).collect()
    return {(r.section, r.metric): r.value for r in rows}


def contents(spark, root):
    tables = Tables(spark, root)
    return {
        n: sorted(map(tuple, tables.read(n, schemas.TABLES[n]).collect()), key=repr)
        for n in TABLE_NAMES
    }


def test_first_run_and_rerun(spark, tmp_path):
    root = str(tmp_path / "tables")
    first = run(spark, tmp_path, root, SNAPSHOT)
    assert [first[t, "inserted"] for t in TABLE_NAMES] == [3, 3, 4, 5]
    assert first["run", "address_null"] == 1
    assert first["skipped", "skipped_rows"] == 0
    before = contents(spark, root)
    assert all(len({row[0] for row in before[t]}) == n for t, n in zip(TABLE_NAMES[:3], (3, 3, 4)))

    again = run(spark, tmp_path, root, SNAPSHOT)
    assert [again[t, "inserted"] for t in TABLE_NAMES] == [0, 0, 0, 0]
    assert [again[t, "unchanged"] for t in TABLE_NAMES] == [3, 3, 4, 5]
    assert contents(spark, root) == before


def test_changes_and_disappearance(spark, tmp_path):
    root = str(tmp_path / "tables")
    run(spark, tmp_path, root, SNAPSHOT)
    edges = contents(spark, root)["address_institutions"]
    newer = copy.deepcopy(SNAPSHOT)
    newer["scraped_at"] = "2025-11-09T06:30:00Z"
    newer["institutions"][2]["address"] = "ул. Зефир 21"
    newer["institutions"][0] = inst("D9", "preschool", [(SUNRISE, "100")])
    second = run(spark, tmp_path, root, newer, "newer")
    counts = [second["institutions", c] for c in ("inserted", "updated", "unchanged")]
    assert counts == [1, 1, 1]
    assert second["disappeared", "institutions_disappeared"] == 1
    after = contents(spark, root)
    assert set(edges) < set(after["address_institutions"])
    assert {r[5] for r in after["institutions"] if r[1] == "C5"} == {"ул. Зефир 21"}
    assert max(r[0] for r in after["institutions"]) == 4


def test_bad_entry_is_skipped_and_its_street_not_created(spark, tmp_path):
    root = str(tmp_path / "tables")
    bad = copy.deepcopy(SNAPSHOT)
    bad["institutions"][1]["address_entries"] += [
        {"street": "ГР.ВАРНА УЛ.НЕВЕН", "number": "срещу парка"},
        {"street": "ГР.ПЛОВДИВ УЛ.ЛИПА", "number": "6"}, {"street": LILAC, "number": "44444"},
    ]
    counts = run(spark, tmp_path, root, bad)
    assert counts["skipped", "skipped_rows"] == 3
    assert counts["streets", "inserted"] == 3
    kept = spark.read.parquet(f"{root}/{Tables(spark, root).versions()['quarantine']}")
    reasons = {(r.external_id, r.kind, r.reject_reason) for r in kept.collect()}
    assert reasons == {("B2", "nursery", r) for r in ("unparseable", "unknown_locality", "out_of_range")}


def test_snapshot_in_lines_gives_the_same_tables(spark, tmp_path):
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    run(spark, tmp_path, whole, SNAPSHOT)
    lines = [{**SNAPSHOT, "institutions": [one]} for one in SNAPSHOT["institutions"]]
    path = tmp_path / "lines.jsonl"
    path.write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    job.ingest(spark, str(path), cut, lines=True)
    assert contents(spark, cut) == contents(spark, whole)


def test_invalid_snapshot_writes_nothing(spark, tmp_path):
    root = str(tmp_path / "tables")
    Tables(spark, root).replace("streets", spark.createDataFrame([], schemas.STREETS), schemas.STREETS)
    before = Tables(spark, root).versions()
    for change, error in (
        ({"schema_version": 1}, UnsupportedVersion),
        ({"extra": 1}, ContractViolation),
        ({"scraped_at": "2025-11-02T06:30:00"}, ContractViolation),
    ):
        with pytest.raises(error):
            run(spark, tmp_path, root, {**SNAPSHOT, **change}, "broken")
    assert Tables(spark, root).versions() == before


def test_register_refresh_restamp_and_routing(spark, tmp_path):
    root = str(tmp_path / "tables")
    report = tmp_path / "report.txt"
    header = "област 03 ВАРНА    община 06 ВАРНА    район 0{0}_РАЙОН    10135 ГР.ВАРНА    секция 112"

    def write(district):
        lines = [
            header.format(district),
            " 00217 УЛ.ЛЮЛЯК".ljust(38) + "003,007", " 00219 УЛ.ЗЕФИР".ljust(38) + "021Г,99999",
            header.format(9), " 00217 УЛ.ЛЮЛЯК".ljust(38) + "005",
        ]
        report.write_bytes("\r\n".join(lines).encode("cp1251"))

    write(4)
    loaded = refresh.refresh_register(spark, str(report), root).first()
    assert tuple(loaded) == (3, 2, 2)
    left_out = spark.read.parquet(f"{root}/{Tables(spark, root).versions()['register_quarantine']}")
    assert sorted(r.reject_reason for r in left_out.collect()) == ["out_of_range", "unknown_district"]
    first = run(spark, tmp_path, root, SNAPSHOT)
    assert [first["addresses_district", f"tier{n}"] for n in (1, 2, 3)] == [2, 0, 1]
    assert first["addresses_settlement", "settlement_stamped"] == 4
    assert first["institutions_district", "primary"] == 2
    districts = {r[1]: r[6] for r in contents(spark, root)["institutions"]}
    assert districts == {"A7": "04", "B2": "02", "C5": "04"}

    write(5)
    refresh.refresh_register(spark, str(report), root)
    assert run(spark, tmp_path, root, SNAPSHOT)["addresses_district", "tier1"] == 0
    refresh.restamp(spark, root)
    assert {r[1]: r[6] for r in contents(spark, root)["institutions"]}["B2"] == "02"
    # The address that only matches by street keeps its old code.
    codes = sorted(r[5] for r in contents(spark, root)["addresses"] if r[5])
    assert codes == ["04", "05", "05"]

    assert refresh.route_all(spark, root).count() == 4
    report_rows = {(r.severity, r.metric): r.value for r in refresh.validate(spark, root).collect()}
    assert report_rows["failure", "failed"] == 0
    refresh.reset(spark, root)
    cleared = contents(spark, root)
    assert {r[5] for r in cleared["addresses"]} == {None}
    assert {r[1]: r[6] for r in cleared["institutions"]}["B2"] == "02"


def test_a_moved_pointer_is_refused_and_reads_are_of_one_version(spark, tmp_path):
    root = str(tmp_path / "tables")
    one = spark.createDataFrame([(1, "c", "r", "", None, "n")], schemas.STREETS)
    Tables(spark, root).replace("streets", one, schemas.STREETS)
    slow, quick = Tables(spark, root), Tables(spark, root)
    assert slow.read("streets", schemas.STREETS).count() == 1
    quick.replace("streets", one.union(one), schemas.STREETS)
    quick.replace("addresses", spark.createDataFrame([], schemas.ADDRESSES), schemas.ADDRESSES)
    assert slow.read("streets", schemas.STREETS).count() == 1
    with pytest.raises(MovedTables):
        slow.replace("streets", one, schemas.STREETS)
    assert set(Tables(spark, root).versions()) == {"streets", "addresses"}
