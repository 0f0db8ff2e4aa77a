"""Derivations on the pulled population: narrow column expressions, no shuffle.

population -> profile (people with a category; match flag, logs, sign categories)
           -> analysis_base (first-year and customer-value filters, zero flag,
              fill, churn, year-on-year differences)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions import recodes as R
from spendlens.functions.numeric import guarded_log10, sign_category

# The columns filled with 0 after the filters (a person in year
# 1 but absent in year 2 counts as churned); first-year total spend is not
# in the list.
FILL_ZERO = [
    "own_rev_y2", "total_spend_y2", "own_share_pct", "other_spend", "own_rev_log",
    "total_spend_log", "flight_rev_y1", "flight_rev_y2", "flight_revenue_y1",
    "flight_revenue_y2", "currency_rev_y1", "currency_rev_y2",
]

#: shares: numerator, denominator, name
SHARE_SPECS = [
    ("own_rev_y2", "total_spend_y2", "spend_share_y2"),
    ("own_rev_y1", "total_spend_y1", "spend_share_y1"),
]


def profile(pop: DataFrame, log_parity: bool = False) -> DataFrame:
    """People with a category and their row-level flags.

    A person whose latest survey has no category drops out here (after the
    deduplication, so an earlier survey does not take its place).  Flags
    whose columns were not pulled are left out.
    """
    flags = {
        "match_flag": ("own_rev_y2", lambda c: c.isNotNull().cast("int")),
        "own_rev_log": ("own_rev_y2", lambda c: guarded_log10(c, zero_to_zero=True)),
        "total_spend_log": ("total_spend_y2", lambda c: guarded_log10(c, zero_to_zero=False, parity=log_parity)),
        "own_rev_y2_cat": ("own_rev_y2", sign_category),
        "own_rev_y1_cat": ("own_rev_y1", sign_category),
    }
    return pop.where(F.col("category").isNotNull()).withColumns(
        {name: of(F.col(c)) for name, (c, of) in flags.items() if c in pop.columns})


def in_base() -> Column:
    """The analysis base: a first-year spend record and a customer value."""
    return F.col("own_rev_y1").isNotNull() & F.col("cust_value").isNotNull()


def fill_zero(df: DataFrame, cols=tuple(FILL_ZERO)) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(types[c])) for c in cols if c in types})


def analysis_base(people: DataFrame) -> DataFrame:
    """People of the base, filled, with churn label and year-on-year differences.

    Order matters: the zero flag and the raw copies precede the fill, the churn
    label follows it.  Shares are ratios of sums that skip nulls, so they are
    the same before and after the fill; reports compute them as measures.
    """
    base = people.where(in_base())
    raw = {f"{c}_raw": F.col(c) for c in ("flight_revenue_y1", "flight_revenue_y2") if c in base.columns}
    base = fill_zero(base.withColumns({"zero_flag": F.coalesce(F.col("own_rev_y2") == 0, F.lit(False)).cast("int"), **raw}))
    base = base.withColumn("own_rev_y2_cat2", sign_category(F.col("own_rev_y2")))
    return base.withColumns({
        "churned": R.churn_label(F.col("own_rev_y2_cat2")),
        "own_rev_diff": F.col("own_rev_y2") - F.col("own_rev_y1"),
        "total_spend_diff": F.col("total_spend_y2") - F.col("total_spend_y1"),
    })
