"""Every core query against its SQL, and the contract of the entry module."""

import importlib.util
from pathlib import Path

import pytest

from cellweave import frame_workloads, map_workloads, workloads

QUERIES, ORACLE = ({k: v for m in (frame_workloads, map_workloads, workloads) for k, v in getattr(m, kind).items()} for kind in ("QUERIES", "ORACLE"))
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(matches_sql, name):
    matches_sql(QUERIES[name], ORACLE[name])


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry_module", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(QUERIES) <= set(module.queries()) and set(module.oracle_sql()) <= set(module.queries())


@pytest.mark.parametrize("name", ["groupby_index", "join_outer", "add_outer", "loc_dates", "dedup_first", "p5_features", "p5_totals", "p7_key_totals"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_scans_read_only_their_columns(spark):
    plan = QUERIES["groupby_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan
