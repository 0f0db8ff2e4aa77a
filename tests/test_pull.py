"""The pull's ledger, the relations written for their joins, and the cube."""

import uuid

from pyspark.sql import functions as F

from conftest import SF001
from spendlens.operators.cube import build_cube, cube_levels, cube_measures, merge_cubes
from spendlens.operators.summary import group_measures, level_counts
from spendlens.plans.cohorts import explode_cohorts
from spendlens.plans.ledger import observed_pull
from spendlens.plans.population import build_population
from spendlens.plans.queries import base
from spendlens.plans.report import CATEGORICAL, CUBE_DIMENSIONS, MEANS, outcome_cube, outcome_report, outcome_report_from_cube
from spendlens.sources.relation_store import RelationStore, buckets_for, drop_store, write_store
from spendlens.sources.tpch_binding import COHORTS, LABELS, Binding, BoundTables

B = Binding()


def test_ledger_is_filled_by_the_job_that_pulls(spark):
    tables = BoundTables(spark, SF001)
    people, ledger = observed_pull(tables, B.survey_start, B.survey_end, LABELS, ["category", "tier"])
    assert people.columns == ["party_id", "category", "tier"]
    rows = people.collect()  # the only action
    n = ledger.counts()
    survey = tables["survey"].where(F.col("survey_dt").between(B.survey_start.isoformat(), B.survey_end.isoformat()))
    assert n["in_window"] == survey.count() and n["people"] == len(rows) == survey.select("party_id").distinct().count()
    plain = build_population(tables, B.survey_start, B.survey_end, LABELS, ["own_rev_y1", "own_rev_y2", "cust_value", "category"])
    assert n["in_spend_y2"] == plain.where("own_rev_y2 IS NOT NULL").count()
    assert n["base"] == plain.where("category IS NOT NULL AND own_rev_y1 IS NOT NULL AND cust_value IS NOT NULL").count()
    assert ledger.consistent() and [r.step for r in ledger.frame(spark).orderBy("step_no").collect()][0] == "in_window"


def test_pull_from_the_store_plans_no_exchange(spark):
    prefix = f"test_{uuid.uuid4().hex}"
    tables = BoundTables(spark, SF001)
    write_store(tables, prefix, 3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = build_population(RelationStore(spark, prefix, B.survey_start, B.survey_end), B.survey_start, B.survey_end, LABELS, on_duplicates="trust")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") >= 5 and "Exchange" not in plan
        want = build_population(tables, B.survey_start, B.survey_end, LABELS)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
        scan = RelationStore(spark, prefix, B.survey_start, B.survey_end)["survey"]._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(survey_month" in scan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        drop_store(spark, prefix)


def test_cube_answers_any_cohort(spark):
    people = base(spark, SF001, ["survey_dt", "stage"])
    cube = outcome_cube(people)
    a = outcome_report(explode_cohorts(people, COHORTS), keys=["cohort"]).collect()
    assert a == outcome_report_from_cube(explode_cohorts(cube, COHORTS), keys=["cohort"]).collect() and len(a) == 40
    parts = [outcome_cube(people.where(F.pmod("party_id", F.lit(2)) == k)) for k in (0, 1)]
    merged = merge_cubes(*parts, CUBE_DIMENSIONS)
    assert outcome_report_from_cube(merged).collect() == outcome_report(people).collect()
    levels = lambda f, src: sorted(map(str, f(src, [*CATEGORICAL, "category"]).collect()))
    assert levels(cube_levels, cube) == levels(level_counts, people)


def test_cube_moments_with_nulls_and_single_rows(spark):
    rows = [("a", 1, "10.50"), ("a", 1, None), ("a", 2, "2.25"), ("b", 1, "7.00"), (None, 1, "3.00"), ("c", 1, None)]
    df = spark.createDataFrame(rows, "category string, day int, x string").withColumn("x", F.col("x").cast("decimal(18,2)"))
    cube = build_cube(df, ["category", "day"], ["x"])
    key = lambda f: {(r.category, r._overall): (r.n_rows, r.n_x, r.mean_x, None if r.sd_x is None else round(r.sd_x, 9)) for r in f.collect()}
    assert key(cube_measures(cube, ["x"], "category")) == key(group_measures(df, ["x"], "category"))
    assert MEANS and cube_measures(cube.where("false"), ["x"], "category", ["day"]).count() == 0


def test_buckets_follow_the_surveys(spark):
    """Not the shuffle partitions: each bucket is a file a month."""
    surveys, cores = {"survey": spark.range(50)}, spark.sparkContext.defaultParallelism
    assert buckets_for(surveys) == cores
    assert buckets_for(surveys, rows=2) == max(cores, 25)
