"""Registered queries against their SQL at the smallest scale, and the plans of the join kernels.

All queries run with TURNLOOM_ALL=1; otherwise a sample of every section does.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a01_corpus_stats", "a10_shot_size", "c06_member_strength", "e02_split_at", "f13_format_position", "i07_evaluate_interactions",
    "j01_majority_join", "j06_asof_child", "n02_past_future_snapshots", "n11_social_state_distance", "o06_social_distance", "q04_coverage_overflow",
    "s02_write_project_faces", "t07_lexical_similarity", "v02_histogram", "v14_silhouette", "w04_detect_cuts",
    "w05_label_recurring", "x01_stream_cuts", "x03_stream_interactions", "x04_stream_past_snapshots", "o04_item_value",
]
NAMES = sorted(entry.queries()) if os.environ.get("TURNLOOM_ALL") else SAMPLE


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    return repr(v) if isinstance(v, bool) or v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got  # rows at least
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(_norm(r[i]) for i in at) for r in cur.fetchall())


def test_every_operator_is_registered():
    """One query at least per line of the inventory."""
    have = {n.split("_")[0] for n in entry.queries()}
    want = {f"{s}{i:02d}" for s, n in dict(s=13, e=5, j=13, w=9, i=12, n=16, c=15, v=20, o=12, q=5, t=7, x=4).items() for i in range(1, n + 1)}
    want |= {f"f{i:02d}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 14, 15, 16, 17, 18)} | {f"a{i:02d}" for i in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13)}
    assert want <= have
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["j01_majority_join", "j02_overlap_join", "j03_overlap_duration", "j04_locate", "j06_asof_child", "j07_same_camera_pairs", "n11_social_state_distance", "t07_lexical_similarity"])
def test_no_nested_loop(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastNestedLoopJoin" in line or "CartesianProduct" in line]
    assert not joins


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["j01_majority_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "props" not in plan
    assert "EqualTo(event_type,view)" in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["unit", "speaker", "strength"] and df.count() > 0
