"""Hand-made rows for branches the test tables cannot reach."""

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from spendlens.functions import recodes as R
from spendlens.functions.numeric import guarded_log10, sign_category
from spendlens.operators.crosstab import crosstab_margins
from spendlens.operators.share import group_share, with_group_share
from spendlens.operators.summary import summarize_categorical, summarize_continuous
from spendlens.sources.relations import one_per_key


def test_sign_category_and_churn(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (None,), (-1.0,)], "x double")
    out = df.select(sign_category(F.col("x")).alias("c"))
    out = out.withColumn("churn", R.churn_label(F.col("c"))).collect()
    assert [r.c for r in out] == ["0", ">0", "Missing", "Checking"]
    assert [r.churn for r in out] == ["Churned", "Not Churned", "Not Churned", "Not Churned"]


def test_guarded_log10(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (-5.0,), (None,)], "x double")
    r = df.select(guarded_log10(F.col("x"), True).alias("a"),
                  guarded_log10(F.col("x"), False).alias("b"),
                  guarded_log10(F.col("x"), False, parity=True).alias("c")).collect()
    assert [x.a for x in r] == [0.0, 2.0, None, None]
    assert [x.b for x in r] == [None, 2.0, None, None]
    assert r[0].c == float("-inf")


def test_share_edge_cases(spark):
    schema = "g string, own double, tot double"
    df = spark.createDataFrame([
        ("allnull", None, None), ("allnull", None, None),
        ("zero", -4.0, 0.0),
        ("neg", 10.0, -5.0),
        (None, 1.0, 1.0),
    ], schema)
    signed = {r.g: r.s for r in group_share(df, [("own", "tot", "s")], ["g"], "epsilon").collect()}
    clamped = {r.g: r.s for r in group_share(df, [("own", "tot", "s")], ["g"], "clamp").collect()}
    assert None not in signed  # null group key dropped
    assert signed["allnull"] == 0.0
    assert math.isclose(signed["zero"], -4e12)
    assert signed["neg"] == -200.0
    assert math.isclose(clamped["neg"], 1e13)
    attached = with_group_share(df, [("own", "tot", "s")], ["g"], "epsilon")
    assert attached.count() == 4


LABELS = R.Labels(transactor_stages={"1": "one", "2": "two"}, customer_stages={"A": "Stage A"}, other_stage="U", tiers={"t1": "Tier 1"},
                  non_member_flag="N", non_member="none", hubs={"P": R.LOC_PRIMARY, "S": R.LOC_SECONDARY}, home_country="HOME")


def test_recodes(spark):
    rows = [
        (None, "OTHER", "0", "X", "Y", "t9", 1927, 0.0, 3),
        ("P", "OTHER", "2", "A", "N", "t1", 1928, None, None),
        ("S", None, None, None, "Y", "t1", 2025, 5.0, 4),
        ("Q", "HOME", "1", "A", None, None, None, 5.0, 1),
        ("Q", "OTHER", "3", None, "Y", "t1 ", 1980, 1.0, 0),
        ("Q", None, "3", "a", "Y", "T1", 1946, 0.0, None),
    ]
    df = spark.createDataFrame(rows, "airport string, country string, stage string, ctype string, member string, tier string, by int, rpm double, trips int")
    c = F.col

    def results(labels):
        return df.select(R.home_location(c("airport"), c("country"), labels).alias("loc"), R.transactor_stage_label(c("stage"), labels).alias("ts"),
                         R.customer_stage(c("ctype"), labels).alias("cs"), R.tier(c("member"), c("tier"), labels).alias("t"), R.age_band(c("by")).alias("ab"),
                         R.travel_frequency(c("rpm"), c("trips")).alias("tf")).collect()

    out = results(LABELS)
    assert [r.loc for r in out] == [R.LOC_UNKNOWN, R.LOC_PRIMARY, R.LOC_SECONDARY, R.LOC_DOMESTIC, R.LOC_INTERNATIONAL, R.LOC_UNKNOWN]
    assert [r.ts for r in out] == ["0", "two", None, "one", "3", "3"]
    assert [r.cs for r in out] == ["U", "Stage A", "U", "Stage A", "U", "U"]
    assert [r.t for r in out] == [None, "none", "Tier 1", None, None, None]
    assert [r.ab for r in out] == [R.AGE_BAND_NA, "1_Silent_Generation", "6_Alpha", R.AGE_BAND_NA, "3_Gen_X", "2_Baby_Boomers"]
    assert [r.tf for r in out] == [R.NON_FLYER, R.FREQUENCY_ERROR, "4+ Trips", "1 Trip", R.FREQUENCY_ERROR, R.NON_FLYER]
    loose = dataclasses.replace(LABELS, normalize_codes=True, tiers={"T1": "Tier 1"})
    assert [r.t for r in results(loose)][4:] == ["Tier 1", "Tier 1"] and [r.cs for r in results(loose)][5] == "Stage A"


def test_crosstab(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), (None, "x"), ("Total", "x")], "r string, c string")
    out = {(r.r, r.row_total, r.c, r.col_total): r.n for r in crosstab_margins(df, "r", "c").collect()}
    assert out["Total", True, "Total", True] == 5 and out["Total", False, "Total", True] == 1
    assert out["a", False, "Total", True] == 2 and out["Total", True, "x", False] == 4
    assert out["b", False, "y", False] == 0 and out["Total", False, "y", False] == 0  # no such rows
    assert sum(n for (_, rt, _, ct), n in out.items() if not rt and not ct) == 5 and len(out) == 12
    assert crosstab_margins(df.limit(0), "r", "c").count() == 0


def test_summary_ratio_modes(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 1.0, 4.0), (None, 5.0, 5.0)], "category string, own double, tot double")
    ratio = [("own", "tot", "share")]
    true = {r.group: r for r in summarize_continuous(df, ["own"], ratios=ratio).where("variable = 'share'").collect()}
    assert (true["a"].mean, true["a"].sd, true["b"].mean, true["b"].sd) == (100.0, 0.0, 25.0, None)
    assert math.isclose(true["Overall"].mean, 1000 / 13) and true["Overall"].sd is None
    mean = {r.group: r for r in summarize_continuous(df, ["own"], ratios=ratio, overall_ratio="mean").where("variable = 'share'").collect()}
    assert math.isclose(mean["Overall"].mean, (100 + 100 + 25) / 3) and math.isclose(mean["Overall"].sd, 75 / math.sqrt(3))


def test_summary_levels(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "x"), ("b", "y")], "category string, v string")
    out = {(r.group, r.level): (r.n, r.pct) for r in summarize_categorical(df, ["v"]).collect()}
    assert out == {("a", "x"): (2, 100.0), ("a", None): (1, None), ("b", "y"): (1, 100.0), ("Overall", "x"): (2, 100 * 2 / 3), ("Overall", "y"): (1, 100 / 3), ("Overall", None): (1, None)}
    with_null = {(r.group, r.level): r.pct for r in summarize_categorical(df, ["v"], include_null=True).collect()}
    assert with_null["a", None] == 100 / 3


def test_one_per_key(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "party_id long, v string")
    assert sorted((r.party_id, r.v) for r in one_per_key(df).collect()) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="party_id is not unique: 1"):
        one_per_key(df, on_duplicates="raise", name="spend").collect()
    assert one_per_key(df.where("party_id = 2"), on_duplicates="raise").count() == 1
