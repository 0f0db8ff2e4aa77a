"""Every registered query of the core: result against its DuckDB oracle (the driver's check), jobs and plan."""

import os

import pytest

import __spark_entry__ as E
from conftest import SF001, SF01
from oracle_compare import compare, duck
from spendlens.oracle import ORACLE_SQL
from spendlens.plans.queries import QUERIES

NEVER = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "FlatMapGroupsInPandas", "MapInPandas"]
#: tables of the queries whose plan reads no shared frame
READS = {"latest_survey": {"orders"}, "age_band": {"orders", "customer"}}
#: exact band edges are found by jobs of their own
EDGES = ("value_band", "stratum_shares", "balance", "cohort_band", "cohort_grid", "cohort_summary", "spend_share_balanced")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def con01():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con01, name):
    spark.sparkContext.setJobGroup(f"building {name}", "")
    try:
        df = QUERIES[name](spark, SF01)
        jobs = list(spark.sparkContext.statusTracker().getJobIdsForGroup(f"building {name}"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    if not name.startswith(EDGES) or name == "cohort_grid_base_share":
        assert len(jobs) <= 8  # Spark's own, one for the schema of each table read
    plan = executed(df)
    for node in NEVER:
        assert node not in plan
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if " Window [" in line:  # no window over a single partition
            assert not any("SinglePartition" in x for x in lines[i:i + 4]), line
    if name in READS:
        assert {os.path.basename(f).split(".")[0] for f in df.inputFiles()} == READS[name]
    r = compare(spark, con01, name, None, ORACLE_SQL[name], SF01, df)
    assert r["schema"], r["names"]
    assert r["rows"][0] == r["rows"][1]
    assert r["hash"], "value hash differs"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert df.columns == ["row_order", "row_label", "Detractor", "Passive", "Promoter"]


def test_small_scale_oracles(spark):
    con = duck(SF001)
    for name in ["population_joined", "group_summary_continuous"]:
        r = compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF001)
        assert r["hash"] and r["schema"], name


def test_latest_survey_is_group_limit_and_pushed_down(spark):
    p = executed(QUERIES["latest_survey"](spark, SF01))
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in p


@pytest.mark.parametrize("name", ["outcome_report", "group_summary_continuous"])
def test_reports_read_the_people_once(spark, name):
    plan = executed(QUERIES[name](spark, SF01))
    assert sum("o_orderpriority" in x and "Scan" in x for x in plan.split("\n")) == 1


def test_nothing_is_written(spark):
    folders = [spark.conf.get(k).removeprefix("file:") for k in ("spark.sql.warehouse.dir", "spark.checkpoint.dir")]
    files = lambda: {os.path.join(d, f) for top in folders for d, _, names in os.walk(top) for f in names}
    before = files()
    for name in ("cohort_grid", "churn_and_yoy"):
        QUERIES[name](spark, SF01)
    assert files() == before
