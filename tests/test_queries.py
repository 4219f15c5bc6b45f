"""Registered queries against independent SQL on the smallest tables.

A few per area by default; PLUMBLINE_ALL=1 runs every one.
"""

from __future__ import annotations

import os

import pytest

from oracle import compare, connect
from plumbline.plans import queries as Q

Q.load()
QUICK = (
    "met_02_ratio", "met_07_aggregate", "met_16_rollup", "met_18_canonical_values",
    "jn_04_funnel_product", "jn_06_unmatched_keys", "val_04_allowed_values", "val_08_consistency",
    "val_12_validate", "cln_02_row_fix_shift_right", "cln_06_dedupe_exact", "cln_21_surrogate_key",
    "ucl_03_coerce_currency", "prf_02_missing_profile", "prf_06_classify_value", "prf_08_infer_type",
    "ins_03_find_anomalies", "ins_06_period_over_period", "ins_09_movers", "shp_06_dense_trend",
    "brw_02_page_rows", "sch_07_value_overlap", "ver_04_diff_versions", "mon_01_drift_alerts",
    "dic_01_measure_columns", "txt_01_tag_scope", "txt_03_claim_candidates", "fn_05_fmt",
)
NAMES = sorted(Q.SQL) if os.environ.get("PLUMBLINE_ALL") else QUICK


@pytest.fixture(scope="module")
def sf_dir(request):
    from conftest import TESTDATA
    folder = TESTDATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test tables")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert compare(Q.QUERIES[name](spark, sf_dir), connect(sf_dir), Q.SQL[name]) is None


def test_changes_agree_with_sql_on_odd_balances(spark, sf_dir, tmp_path):
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, -0.04, -0.05, 0.25, 1e6]
    spark.createDataFrame(list(enumerate(odd)), "c_custkey bigint, c_acctbal double").coalesce(
        1).write.parquet(f"{tmp_path}/customer.parquet")
    con = connect(sf_dir)
    con.sql(f"CREATE OR REPLACE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
    name = "fn_07_fmt_delta"
    assert compare(Q.QUERIES[name](spark, str(tmp_path)), con, Q.SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(Q.SQL) <= set(Q.QUERIES)
    assert all(sql.strip() for sql in Q.SQL.values())
