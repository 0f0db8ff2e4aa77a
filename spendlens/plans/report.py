"""Outcome report: ten rows x three categories, numeric; a string view last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.recodes import CHURNED, recode
from spendlens.operators.attach import attach
from spendlens.operators.balance import CATEGORIES
from spendlens.operators.cube import build_cube, cube_measures
from spendlens.operators.share import group_share
from spendlens.operators.summary import group_measures
from spendlens.plans.derive import SHARE_SPECS

# The summarised variables
MEANS = ["own_rev_y1", "own_rev_y2", "own_rev_diff", "total_spend_y1", "total_spend_y2", "total_spend_diff"]
CATEGORICAL = ["churned", "own_rev_y1_cat"]
#: what the stored cube can be sliced by
CUBE_DIMENSIONS = ["survey_dt", "stage", "category", *CATEGORICAL]

# Report rows (order, label, measure, display kind)
REPORT_ROWS = [
    (0, "Sample size", None, "n"),
    (1, "Own revenue (year 1, average)", "own_rev_y1", "money"),
    (2, "Own revenue (year 2, average)", "own_rev_y2", "money"),
    (3, "Own revenue YoY change (average)", "own_rev_diff", "money"),
    (4, "Share of spend (year 2)", "spend_share_y2", "percent"),
    (5, "Total spend (year 1, average)", "total_spend_y1", "money"),
    (6, "Total spend (year 2, average)", "total_spend_y2", "money"),
    (7, "Total spend YoY change (average)", "total_spend_diff", "money"),
    (8, "Share of spend (year 1)", "spend_share_y1", "percent"),
    (9, "Churn rate (%)", "churn", "percent"),
]


def outcome_report(df: DataFrame, keys: Sequence[str] = (), by: str = "category", groups: Sequence[str] = CATEGORIES,
                   share_mode="epsilon", shares: DataFrame | None = None) -> DataFrame:
    """(keys..., row_order, row_label, <group columns>) of doubles.

    Sample size: the overall count in the first group's column, the others
    null.  All measures come from one aggregate over ``df``; the rest works on
    its few rows.  ``shares``: shares by group of another set of rows, instead
    of the report's own.
    """
    keys = list(keys)
    churned = F.lit(100.0) * F.count(F.when(F.col("churned") == F.lit(CHURNED), 1)) / F.count("churned")
    agg = group_measures(df, MEANS, by, keys, SHARE_SPECS, share_mode,
                         extra=[F.when(F.count("churned") > 0, churned).alias("churn")])
    if shares is not None:
        agg = attach(agg.drop(*[s[2] for s in SHARE_SPECS]), shares, [by], how="left")
    return report_rows(agg, keys, by, groups)


def outcome_report_from_cube(cube: DataFrame, keys: Sequence[str] = (), by: str = "category", groups: Sequence[str] = CATEGORIES,
                             share_mode="epsilon") -> DataFrame:
    """The same from the cells of ``outcome_cube``, without the people."""
    known = F.sum(F.when(F.col("churned").isNotNull(), F.col("n_rows")))
    churned = F.lit(100.0) * F.coalesce(F.sum(F.when(F.col("churned") == F.lit(CHURNED), F.col("n_rows"))), F.lit(0)) / known
    agg = cube_measures(cube, MEANS, by, list(keys), SHARE_SPECS, share_mode, extra=[F.when(known > 0, churned).alias("churn")])
    return report_rows(agg, list(keys), by, groups)


def outcome_cube(base: DataFrame) -> DataFrame:
    """The base by day, stage, category and the levels of the categorical variables."""
    return build_cube(base, CUBE_DIMENSIONS, MEANS)


def report_rows(agg: DataFrame, keys: Sequence[str], by: str = "category", groups: Sequence[str] = CATEGORIES) -> DataFrame:
    """The ten rows from measures by (keys, by) and (keys)."""
    overall, known = F.col("_overall") == 1, F.col(by).isin(list(groups))
    rows = [F.when(overall, F.struct(F.lit(0).alias("row_order"), F.lit(groups[0]).alias("group"), F.col("n_rows").cast("double").alias("value")))]
    for order, _, measure, _ in REPORT_ROWS[1:]:
        value = F.col(f"mean_{measure}") if measure in MEANS else F.col(measure)
        rows.append(F.when(~overall & known, F.struct(F.lit(order).alias("row_order"), F.col(by).alias("group"), value.alias("value"))))
    long = agg.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(*keys, "r.*")
    wide = long.groupBy(*keys, "row_order").pivot("group", list(groups)).agg(F.first("value"))
    label = recode(F.col("row_order"), {r[0]: r[1] for r in REPORT_ROWS})
    # ordering only the final few dozen rows
    return (wide.select(*keys, "row_order", label.alias("row_label"), *[F.col(g).cast("double").alias(g) for g in groups])
            .orderBy(*keys, "row_order"))


def base_shares(base: DataFrame, by: str = "category") -> DataFrame:
    """The signed shares of the whole base by group, to report slices with."""
    return group_share(base, SHARE_SPECS, [by], "epsilon")


def format_report(report: DataFrame, groups: Sequence[str] = CATEGORIES) -> DataFrame:
    """String view: '$' amounts and '%' shares at one decimal (half-even on
    the exact binary value, as Python formats), sample size as an integer
    in the first group and blank in the others."""
    kind = recode(F.col("row_order"), {r[0]: r[3] for r in REPORT_ROWS})
    cols = []
    for g in groups:
        v = F.col(g)
        # SQL format_number with a pattern (no grouping separator)
        num = F.call_function("format_number", v, F.lit("0.0"))
        txt = (F.when(kind == "n", F.when(v.isNull(), F.lit("")).otherwise(v.cast("long").cast("string")))
               .when(kind == "money", F.concat(F.lit("$"), num))
               .otherwise(F.concat(num, F.lit(" %"))))
        cols.append(txt.alias(g))
    other = [c for c in report.columns if c not in groups]
    return report.select(*other, *cols)
