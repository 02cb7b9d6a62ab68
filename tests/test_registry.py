import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SAMPLE = ("strip_marker_audit", "topk_recall_by_scorer", "auroc_by_scorer", "roc_curve", "delong_tests", "leak_audit",
          "text_hash_split", "ochiai_scores", "strip_variants", "loss_line_listmle", "energy_field", "bootstrap_auroc")

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    state, _, _, diff = check.compare(spark, con, name, SF)
    assert state == "ok", diff


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 3
