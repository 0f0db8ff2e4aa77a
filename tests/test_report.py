"""Outcome report string view, sink, day stamp, population options."""

import datetime as dt
import os

import pytest

from conftest import SF001
from spendlens.plans import queries as Q
from spendlens.plans.derive import profile
from spendlens.plans.population import build_population
from spendlens.plans.report import format_report
from spendlens.sources import write_report
from spendlens.sources.sinks import run_stamp


def test_format_report(spark):
    rep = spark.createDataFrame(
        [(0, "Sample size", 73.0, None, None), (1, "a", 0.25, 1234.35, -2.0), (4, "s", 33.333, 0.0, 5.05),
         (9, "c", 62.5, 57.142857, 0.0)],
        "row_order int, row_label string, Detractor double, Passive double, Promoter double")
    out = {r.row_order: r for r in format_report(rep).collect()}
    assert (out[0].Detractor, out[0].Passive) == ("73", "")
    assert out[1].Detractor == "$0.2"            # half-even, like Python's '.1f'
    assert out[1].Passive == "$1234.3"           # 1234.35 is below .35 in binary
    assert out[1].Promoter == "$-2.0"
    assert out[4].Detractor == "33.3 %"
    assert out[9].Passive == "57.1 %"


def test_write_report(spark, tmp_path):
    path = str(tmp_path / "r")
    write_report(Q.q_outcome_report(spark, SF001), path, fmt="csv")
    assert spark.read.option("header", "true").csv(path).count() == 10
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 1


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago", "Asia/Tokyo"])
def test_day_stamp_does_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        one = spark.range(1)
        stamp = lambda *a: one.select(run_stamp(*a).alias("s")).first().s
        assert stamp(dt.datetime(2024, 3, 1, 8), "America/Chicago") == "2024_03_01"
        assert stamp(dt.datetime(2024, 3, 1, 2), "America/Chicago") == "2024_02_29"
        assert stamp(dt.datetime(2024, 3, 1, 20), "Asia/Tokyo") == "2024_03_02"
        now = dt.datetime.now(dt.timezone.utc)
        assert stamp(None, "UTC") in {(now + dt.timedelta(days=k)).strftime("%Y_%m_%d") for k in (0, 1)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def population(spark, changed, **options):
    return build_population({**Q.tables(spark, SF001), **changed}, "2000-01-01", "2000-06-30", Q.LABELS, **options)


def test_repeated_rows_do_not_multiply_people(spark):
    t = Q.tables(spark, SF001)
    twice = {"spend_y1": t["spend_y1"].unionByName(t["spend_y1"]), "individual": t["individual"].unionByName(t["individual"])}
    once, doubled = population(spark, {}, columns=["own_rev_y1", "age_band"]), population(spark, twice, columns=["own_rev_y1", "age_band"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, doubled.collect()), key=str) and once.count() == 76
    with pytest.raises(Exception, match="spend_y1: party_id is not unique"):
        population(spark, twice, columns=["own_rev_y1"], on_duplicates="raise").collect()


def test_null_categories_drop_out_of_the_profile(spark):
    t = Q.tables(spark, SF001)
    from pyspark.sql import functions as F

    some = t["survey"].withColumn("category", F.when(F.col("party_id") % 5 != 0, F.col("category")))
    pop = population(spark, {"survey": some}, columns=["category", "own_rev_y2"])
    people = profile(pop)
    assert pop.count() == 76 and people.count() == 76 - pop.where("party_id % 5 = 0").count() < 76


def test_unknown_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="no_such"):
        population(spark, {}, columns=["no_such"])
