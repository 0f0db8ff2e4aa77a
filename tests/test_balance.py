"""Balancing: properties, brute force, hand-made edge cases, measured fixture counts."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from spendlens.operators.balance import CATEGORIES, REF_PAIR, _quotas, balance, balance_diagnostics, balance_quota, mark_sample
from spendlens.plans import queries as Q


def make_rows(seed, n=600):
    rnd = random.Random(seed)
    cats = ["Detractor", "Passive", "Promoter"]
    rows = []
    for i in range(n):
        # a hot stratum holding about a third of the rows, and null strata parts
        s1 = "hot" if rnd.random() < 0.35 else rnd.choice(["a", "b", None])
        s2 = rnd.choice([1, 2, None])
        rows.append((i * 7 + 3, rnd.choice(cats), s1, s2))
    return rows


def brute_sample(rows, seed, quotas):
    groups = {}
    for pid, cat, s1, s2 in rows:
        groups.setdefault((s1, s2, cat), []).append(pid)
    out = set()
    for g, ids in groups.items():
        k = quotas.get(g, 0)
        ids.sort(key=lambda p: (hashlib.md5(f"{seed}:{p}".encode()).hexdigest(), p))
        out.update(ids[:k])
    return out


def brute_quotas(rows):
    cats = ["Detractor", "Passive", "Promoter"]
    N = {c: sum(1 for r in rows if r[1] == c) for c in cats}
    cnt = {}
    for _, cat, s1, s2 in rows:
        cnt.setdefault((s1, s2), {c: 0 for c in cats})[cat] += 1
    q = {}
    for s, cc in cnt.items():
        m = min(cc["Detractor"] / N["Detractor"], cc["Promoter"] / N["Promoter"])
        for c in cats:
            q[(*s, c)] = min(cc[c], math.floor(N[c] * m))
    return q


@pytest.mark.parametrize("hash_bits", [1, 7, 12])
def test_sample_matches_brute_force(spark, hash_bits):
    rows = make_rows(5)
    df = spark.createDataFrame(rows, "party_id long, category string, s1 string, s2 int").repartition(7)
    got = {r.party_id for r in balance(df, ["s1", "s2"], seed=88, hash_bits=hash_bits).collect()}
    want = brute_sample(rows, 88, brute_quotas(rows))
    assert got == want


def test_properties(spark):
    rows = make_rows(9)
    df = spark.createDataFrame(rows, "party_id long, category string, s1 string, s2 int")
    a = balance(df.repartition(3), ["s1", "s2"], seed=7).collect()
    b = balance(df.repartition(11), ["s1", "s2"], seed=7).collect()
    c = balance(df, ["s1", "s2"], seed=8).collect()
    ids_a = [r.party_id for r in a]
    assert len(ids_a) == len(set(ids_a))                       # no repeats
    assert set(ids_a) <= {r[0] for r in rows}                   # subset
    assert set(ids_a) == {r.party_id for r in b}                # partition independent
    assert len(c) == len(a) and {r.party_id for r in c} != set(ids_a)  # other seed, same size
    q = balance_quota(df, ["s1", "s2"]).collect()
    per = {}
    for r in a:
        per[(r.s1, r.s2, r.category)] = per.get((r.s1, r.s2, r.category), 0) + 1
    for r in q:
        assert per.get((r.s1, r.s2, r.category), 0) == r.quota <= r.available


def test_float_floor_and_exact(spark):
    # N = 49 detractors, one in stratum x: double floor(49 * (1/49)) = 0, exact = 1
    rows = [(i, "Detractor", "x" if i == 0 else "y") for i in range(49)]
    rows += [(100 + i, "Promoter", "x" if i < 10 else "y") for i in range(49)]
    df = spark.createDataFrame(rows, "party_id long, category string, s string")
    dq = {(r.s, r.category): r.quota for r in balance_quota(df, ["s"], quota="double").collect()}
    eq = {(r.s, r.category): r.quota for r in balance_quota(df, ["s"], quota="exact").collect()}
    assert dq[("x", "Detractor")] == 0
    assert eq[("x", "Detractor")] == 1


def test_missing_category_and_null_strata(spark):
    rows = [(1, "Detractor", None), (2, "Detractor", None), (3, "Promoter", None), (4, "Promoter", "a")]
    df = spark.createDataFrame(rows, "party_id long, category string, s string")
    q = {(r.s, r.category): r.quota for r in balance_quota(df, ["s"]).collect()}
    assert q[(None, "Passive")] == 0
    got = balance(df, ["s"], seed=1).collect()
    assert {r.category for r in got} <= {"Detractor", "Promoter"}
    assert sum(1 for r in got if r.s is None) == 2  # null is a stratum like any other


@pytest.mark.parametrize("sf,strata,want", [
    (SF01, ["value_band", "stage"], {"Detractor": 213, "Passive": 84, "Promoter": 185}),
    (SF001, ["stage"], {"Detractor": 17, "Passive": 7, "Promoter": 27}),
])
def test_measured_fixture_counts(spark, sf, strata, want):
    base = Q.banded_base(spark, sf, strata)
    got = {r.category: r["count"] for r in balance(base, strata, seed=88).groupBy("category").count().collect()}
    assert got == want


def test_slice_sizes(spark):
    base = Q.narrow_base(spark, SF01, ["survey_dt"])
    def counts(a, b):
        d = base.where(F.col("survey_dt").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
        return {r.category: r["count"] for r in d.groupBy("category").count().collect()}
    assert counts("2000-04-01", "2000-06-30") == {"Detractor": 180, "Passive": 102, "Promoter": 180}
    assert counts("2000-06-01", "2000-06-30") == {"Detractor": 75, "Passive": 37, "Promoter": 65}


def test_unknown_categories_are_reported(spark):
    rows = [(i, c, "x") for i, c in enumerate(["Detractor", "Promoter", "Passive", "Neutral", None, "Neutral"])]
    marked = mark_sample(spark.createDataFrame(rows, "party_id long, category string, s string"), ["s"], seed=1)
    out = {r.category: (r.available, r.sampled) for r in balance_diagnostics(marked).collect()}
    assert out == {"Detractor": (1, 1), "Promoter": (1, 1), "Passive": (1, 1), "Neutral": (2, 0), None: (1, 0)}


def test_many_strata_and_huge_counts(spark):
    # more strata than any list on the driver should hold, one row of each reference category in each
    n = 120_000
    df = (spark.range(2 * n).select(F.col("id").alias("party_id"), F.when(F.col("id") % 2 == 0, "Detractor").otherwise("Promoter").alias("category"),
                                    F.floor(F.col("id") / 2).alias("s")))
    assert balance(df, ["s"], seed=3, quota="exact").count() == 2 * n
    huge = 4 * 10 ** 12
    counts = spark.createDataFrame([("x", "Detractor", huge), ("x", "Promoter", huge // 2), ("y", "Promoter", huge), ("y", "Detractor", 1)], "s string, category string, n long")
    got = {(r.s, r.category): r.quota for r in _quotas(counts, ["s"], "category", CATEGORIES, REF_PAIR, [], "exact").collect()}
    assert got["x", "Detractor"] == (huge + 1) * (huge // 2) // (huge + huge // 2) and got["y", "Promoter"] == 1


def test_nothing_runs_while_building(spark):
    df = spark.createDataFrame([(1, "Detractor", "a")], "party_id long, category string, s string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        balance(df, ["s"], seed=1)
        balance_quota(df, ["s"])
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()
