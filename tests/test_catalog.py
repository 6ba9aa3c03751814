"""A cross-section of the registered queries against their SQL; ``oracle.py`` runs them all."""

from pathlib import Path

import pytest

from kvartal import catalog
from oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = (
    "lookup_gated", "standardise_streets", "parse_one_line_addresses", "merge_institutions",
    "assign_new_ids", "routing_response", "institution_profile", "contract_violations",
    "read_register_files", "match_data_report_faulty", "constraint_report", "fingerprint_streets",
    "dump_institutions", "ingest_job_summary", "response_classes", "merkle_changed_ranges",
    "lookup_gated_one_pass", "substring_matches", "merge_parts_counts", "fuzzy_street_join",
)

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    assert difference(spark, connect(SF_DIR), SF_DIR, name) is None


def test_routing_over_institutions_that_grow(spark):
    rows = {}
    for sf_dir in (SF_DIR, "/root/testdata/sf0.01"):
        for name in ("district_roster_suppliers", "routing_response_pages"):
            assert difference(spark, connect(sf_dir), sf_dir, name) is None
            rows[name] = [*rows.get(name, []), catalog.QUERIES[name](spark, sf_dir).count()]
    assert all(large > small for small, large in rows.values())
    pages = catalog.QUERIES["routing_response_pages"](spark, sf_dir).select("page_no").distinct().collect()
    assert len(pages) > 2


def test_small_splits_are_read_by_few_tasks(spark, monkeypatch):
    """The number of tasks doesn't follow that of the splits, and no setting is left behind."""
    from kvartal.catalog import documents
    from kvartal.sources import split_json

    tasks, write = [], split_json.materialise

    def count(df, label):
        if label == "json-fragments":
            tasks.append(df.rdd.getNumPartitions())
        return write(df, label)

    monkeypatch.setattr(split_json, "materialise", count)
    monkeypatch.setattr(documents, "SPLIT_BYTES", "1024")
    found = catalog.QUERIES["read_snapshot_split"](spark, SF_DIR)
    assert tasks[0] <= 8 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None
    assert found.count() == found.select("part", "place").distinct().count() == 1516


def test_documents_are_checked_once(spark, monkeypatch):
    from kvartal.catalog import documents

    calls, refused = [], documents.contract.refused_documents
    monkeypatch.setattr(documents.contract, "refused_documents", lambda docs: calls.append(1) or refused(docs))
    counts = {(r.section, r.metric): r.value for r in catalog.QUERIES["ingest_first_run"](spark, SF_DIR).collect()}
    assert len(calls) == 1 and counts["documents", "refused"] > 0


def test_views_read_several_times_are_computed_once(spark):
    found = catalog.QUERIES["institution_changes"](spark, SF_DIR)
    assert "l_suppkey" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_profile_deals_no_edges_by_institution(spark):
    """Institutions without coverage are found by the numbered rows' ids; the edges are not read again."""
    found = catalog.QUERIES["institution_profile"](spark, SF_DIR)
    assert "l_suppkey" not in found._jdf.queryExecution().optimizedPlan().toString()
