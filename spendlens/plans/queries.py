"""Named queries over the driver tables: (spark, sf_dir) -> DataFrame.

Every query pulls the columns it needs over the whole tables.  Decimal outputs
are cast to double at the end (exact totals convert to the same double in any
engine), float-derived ones are rounded here, so results compare bit for bit
with the SQL oracles.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators.attach import attach
from spendlens.operators.balance import REF_PAIR, balance, balance_diagnostics, balance_quota, mark_sample, stratum_shares
from spendlens.operators.compare import chi_square, standardised_differences, welch
from spendlens.operators.crosstab import crosstab_margins
from spendlens.operators.cube import cube_levels, cube_measures
from spendlens.operators.quantile_bands import band_bounds, band_intervals, quantile_edges, with_group_band, with_value_band
from spendlens.operators.share import group_share
from spendlens.operators.summary import continuous_rows, group_measures, level_counts, summarize_categorical, summarize_continuous, summarize_levels
from spendlens.plans.cohorts import BALANCED, RAW, REF_STRATA, balanced_cohorts, cohort_frames, explode_cohorts, variant_share
from spendlens.plans.incremental import LatestSurveys
from spendlens.plans.derive import SHARE_SPECS, analysis_base, in_base, profile
from spendlens.plans.ledger import observed_pull
from spendlens.plans.population import build_population, latest_survey
from spendlens.plans.report import CATEGORICAL, MEANS, base_shares, format_report, outcome_cube, outcome_report, outcome_report_from_cube
from spendlens.session import kept, reused, reused_or_kept, shared_folder
from spendlens.sources import contracts
from spendlens.sources.relation_store import RelationStore, buckets_for, write_store
from spendlens.sources.relations import CONTRACTS
from spendlens.sources.sinks import run_stamp
from spendlens.sources.tpch_binding import COHORTS, LABELS, Binding, BoundTables
from spendlens.sources.versions import VersionedTable

BINDING = Binding()
SEED = 88
#: rows of a frame with exact bands beyond which it is written
MOST_ROWS = 20_000
SEGMENTS = ["transactor_stage", "stage", "generation", "cust_type"]
COVERAGE = ["transactor_stage", "cust_type", "generation", "intent", "tier"]
SEGMENT_STRATA = ["value_band", "stage"]
SPEND = ["own_rev_y1", "own_rev_y2", "total_spend_y1", "total_spend_y2"]
REPORTED = [*MEANS, "churned", "own_rev_y1_cat"]


def out(df: DataFrame) -> DataFrame:
    """Decimals to double for output."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def tables(spark, sf_dir) -> BoundTables:
    return BoundTables(spark, sf_dir, BINDING)


def population(spark, sf_dir, columns: Sequence[str] | None = None) -> DataFrame:
    return build_population(tables(spark, sf_dir), BINDING.survey_start, BINDING.survey_end, LABELS, columns)


def people(spark, sf_dir, columns: Sequence[str]) -> DataFrame:
    return profile(population(spark, sf_dir, ["category", *columns]))


def base(spark, sf_dir, columns: Sequence[str] = ()) -> DataFrame:
    return analysis_base(people(spark, sf_dir, [*SPEND, "cust_value", *columns]))


def _narrow(spark, sf_dir, columns: Sequence[str]) -> DataFrame:
    return base(spark, sf_dir, columns).select("party_id", "category", "cust_value", *REPORTED, *columns)


def narrow_base(spark, sf_dir, columns: Sequence[str] = ()) -> DataFrame:
    """What the steps that read the base several times need of it."""
    return reused(_narrow(spark, sf_dir, columns))


def banded_base(spark, sf_dir, strata: Sequence[str] = REF_STRATA, columns: Sequence[str] = ()) -> DataFrame:
    pulled = dict.fromkeys([*[s for s in strata if s != "value_band"], *columns])
    rows = reused_or_kept(_narrow(spark, sf_dir, list(pulled)), "base", MOST_ROWS)
    return with_value_band(rows, "cust_value", "value_band")


def grid_frames(spark, sf_dir, strata: Sequence[str] = REF_STRATA) -> DataFrame:
    return cohort_frames(banded_base(spark, sf_dir, strata, ["survey_dt", "stage"]), COHORTS, strata)


# ---------------------------------------------------------------------------

def q_latest_survey(spark, sf_dir):
    s = latest_survey(tables(spark, sf_dir)["survey"], BINDING.survey_start, BINDING.survey_end)
    return s.select("party_id", "survey_id", "survey_dt", "category", "transactor_stage", "tenure")


def q_population_joined(spark, sf_dir):
    return rounded(out(population(spark, sf_dir)), "own_share_pct")


def q_revenue_rollups(spark, sf_dir):
    return out(population(spark, sf_dir, [
        "flight_rev_y1", "flight_rev_y2", "flight_revenue_y1", "flight_revenue_y2", "total_revenue_y1", "total_revenue_y2",
        "currency_rev_y1", "currency_rev_y2", "rpm", "flight_rev_displacement"]))


def q_recode_stage(spark, sf_dir):
    return population(spark, sf_dir, ["transactor_stage", "transactor_stage_label", "cust_type", "stage"])


def q_recode_location(spark, sf_dir):
    return population(spark, sf_dir, ["home_location"])


def q_recode_tier(spark, sf_dir):
    return population(spark, sf_dir, ["member_ind", "tier_code", "tier"])


def q_age_band(spark, sf_dir):
    return population(spark, sf_dir, ["age_band"])


def q_travel_frequency(spark, sf_dir):
    return population(spark, sf_dir, ["rpm", "no_of_trips", "travel_frequency"])


def q_match_flag(spark, sf_dir):
    return people(spark, sf_dir, ["own_rev_y2"]).select("party_id", "match_flag")


def q_log_spend(spark, sf_dir):
    logs = people(spark, sf_dir, ["own_rev_y2", "total_spend_y2"]).select("party_id", "own_rev_log", "total_spend_log")
    return rounded(logs, "own_rev_log", "total_spend_log", digits=9)


def q_sign_category(spark, sf_dir):
    return people(spark, sf_dir, ["own_rev_y2", "own_rev_y1"]).select("party_id", "own_rev_y2_cat", "own_rev_y1_cat")


def q_churn_and_yoy(spark, sf_dir):
    return out(base(spark, sf_dir, ["flight_revenue_y1"]).select(
        "party_id", "category", "zero_flag", "own_rev_y2", "own_rev_y2_cat2", "churned",
        "own_rev_diff", "total_spend_diff", "flight_revenue_y1_raw", "flight_revenue_y1"))


def q_filled_base(spark, sf_dir):
    """Every column that the fill touches, after it, with the copies taken before it."""
    filled = ["own_share_pct", "other_spend", "flight_rev_y1", "flight_rev_y2", "flight_revenue_y1", "flight_revenue_y2", "currency_rev_y1", "currency_rev_y2"]
    b = base(spark, sf_dir, filled).select("party_id", "own_rev_y2", "total_spend_y2", "own_rev_log", "total_spend_log", *filled,
                                           "flight_revenue_y1_raw", "flight_revenue_y2_raw")
    return rounded(out(b), "own_share_pct", "own_rev_log", "total_spend_log")


def _in_base(spark, sf_dir):
    return people(spark, sf_dir, [*SPEND, "cust_value"]).where(in_base())


def q_spend_share_signed(spark, sf_dir):
    return group_share(_in_base(spark, sf_dir), SHARE_SPECS, ["category"], "epsilon")


def q_spend_share_clamped(spark, sf_dir):
    return group_share(_in_base(spark, sf_dir), SHARE_SPECS, ["category"], "clamp")


def q_crosstab_margins(spark, sf_dir):
    who = people(spark, sf_dir, ["own_rev_y1", "own_rev_y2", "cust_value"])
    scopes = F.array_compact(F.array(F.lit("population"), F.when(in_base(), F.lit("base"))))
    return crosstab_margins(who.withColumn("scope", F.explode(scopes)), "own_rev_y1_cat", "own_rev_y2_cat", keys=["scope"])


def q_match_rate_by_segment(spark, sf_dir):
    who = people(spark, sf_dir, ["own_rev_y2", *SEGMENTS])
    counts = who.groupBy(*SEGMENTS).agg(F.count(F.lit(1)).alias("n"), F.sum("match_flag").alias("matched"))
    each = F.array(*[F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("level")) for c in SEGMENTS])
    long = counts.select("n", "matched", F.explode(each).alias("r")).groupBy("r.segment", "r.level").agg(
        F.sum("n").cast("long").alias("n"), F.sum("matched").cast("long").alias("matched"))
    return long.withColumn("match_rate", F.col("matched").cast("double") / F.col("n"))


def q_coverage_profile(spark, sf_dir):
    who = people(spark, sf_dir, ["own_rev_y2", *COVERAGE])
    counts = level_counts(who, COVERAGE, ["match_flag", "category"])
    parts = [summarize_levels(counts, COVERAGE, by).withColumn("by_var", F.lit(by)) for by in ("match_flag", "category")]
    return parts[0].unionByName(parts[1])


def q_value_band(spark, sf_dir):
    rows = base(spark, sf_dir).select("party_id", "cust_value")
    return with_value_band(reused_or_kept(rows, "base", MOST_ROWS), "cust_value")


def _cohort_bands(spark, sf_dir, columns: Sequence[str] = ()):
    """Members of the raw cohorts with the value band recut within each cohort, and the edges."""
    members = explode_cohorts(base(spark, sf_dir, ["survey_dt", "stage"]), COHORTS)
    members = reused_or_kept(members.select("cohort", "cust_value", *columns), "members", MOST_ROWS)
    edges = kept(quantile_edges(members, "cust_value", 10, by="cohort"), "edges")
    return with_group_band(members, "cust_value", "cohort", edges), edges


def q_value_band_edges(spark, sf_dir):
    members, edges = _cohort_bands(spark, sf_dir)
    counts = members.where("band IS NOT NULL").groupBy("cohort", "band").agg(F.count(F.lit(1)).alias("n"))
    return attach(counts, band_bounds(edges, "cohort"), ["cohort", "band"]).select("cohort", "band", "lo", "hi", "n")


def q_value_band_intervals(spark, sf_dir):
    """The bands recut per cohort as intervals of the interpolated cut points."""
    members, edges = _cohort_bands(spark, sf_dir)
    counts = members.groupBy("cohort", "band").agg(F.count(F.lit(1)).alias("n"))
    return attach(counts, band_intervals(edges, "cohort"), ["cohort", "band"], how="left").select("cohort", "band", "lo", "hi", "label", "n")


def q_cohort_band_profile(spark, sf_dir):
    """Raw cohorts: the value band recut within each cohort, as a categorical
    summary by category (the slice tables print this band; the balancing key
    keeps the base band)."""
    members, _ = _cohort_bands(spark, sf_dir, ["category"])
    return summarize_categorical(members.withColumnRenamed("band", "value_band_cohort"), ["value_band_cohort"], keys=["cohort"])


def q_stratum_shares(spark, sf_dir):
    return rounded(stratum_shares(banded_base(spark, sf_dir), REF_STRATA), "least_share_norm", digits=9)


def q_balance_quota(spark, sf_dir):
    return balance_quota(banded_base(spark, sf_dir), REF_STRATA)


def q_balance_quota_exact(spark, sf_dir):
    return balance_quota(banded_base(spark, sf_dir, SEGMENT_STRATA), SEGMENT_STRATA, quota="exact")


def q_balanced_sample(spark, sf_dir, strata=REF_STRATA):
    rows = banded_base(spark, sf_dir, strata).select("party_id", "category", *strata)
    return balance(rows, strata, seed=SEED)


def q_balance_diagnostics(spark, sf_dir, strata=REF_STRATA):
    rows = banded_base(spark, sf_dir, strata).select("party_id", "category", *strata)
    return balance_diagnostics(mark_sample(rows, strata, seed=SEED))


def q_spend_share_balanced(spark, sf_dir, strata=REF_STRATA):
    rows = banded_base(spark, sf_dir, strata)
    return group_share(balance(rows, strata, seed=SEED), SHARE_SPECS, ["category"], "clamp")


# Five strata columns leave near-singleton strata on small samples; band x
# stage is the coarser key the fixtures were measured on.
def q_balanced_sample_by_segment(spark, sf_dir):
    return q_balanced_sample(spark, sf_dir, SEGMENT_STRATA)


def q_balance_diagnostics_by_segment(spark, sf_dir):
    return q_balance_diagnostics(spark, sf_dir, SEGMENT_STRATA)


def q_spend_share_balanced_by_segment(spark, sf_dir):
    return q_spend_share_balanced(spark, sf_dir, SEGMENT_STRATA)


def q_group_summary_continuous(spark, sf_dir):
    return rounded(summarize_continuous(base(spark, sf_dir), MEANS, ratios=SHARE_SPECS), "sd")


def q_group_summary_parity(spark, sf_dir):
    """The same with the overall share as the mean of the groups' shares."""
    return rounded(summarize_continuous(base(spark, sf_dir), MEANS, ratios=SHARE_SPECS, overall_ratio="mean"), "mean", "sd")


def q_group_summary_categorical(spark, sf_dir):
    return summarize_categorical(base(spark, sf_dir), CATEGORICAL)


def q_cohort_summary(spark, sf_dir):
    """All eight frames: rows, missing, mean and SD by category and overall."""
    frames = grid_frames(spark, sf_dir, SEGMENT_STRATA)
    return rounded(summarize_continuous(frames, MEANS, keys=["cohort", "variant"], ratios=SHARE_SPECS, share_mode=variant_share), "sd")


def q_cohort_summary_categorical(spark, sf_dir):
    return summarize_categorical(grid_frames(spark, sf_dir, SEGMENT_STRATA), CATEGORICAL, keys=["cohort", "variant"])


def q_outcome_report(spark, sf_dir):
    return outcome_report(base(spark, sf_dir))


def q_outcome_report_text(spark, sf_dir):
    return format_report(outcome_report(base(spark, sf_dir)))


def _grid(spark, sf_dir, strata):
    """Raw cohorts from the cube of the base, balanced ones from their sample."""
    banded = banded_base(spark, sf_dir, strata, ["survey_dt", "stage"])
    raw = outcome_report_from_cube(explode_cohorts(outcome_cube(banded), COHORTS), keys=["cohort"])
    sample = balanced_cohorts(banded, COHORTS, strata)
    balanced = outcome_report(sample, keys=["cohort"], share_mode="clamp")
    both = [r.withColumn("variant", F.lit(v)) for r, v in ((raw, RAW), (balanced, BALANCED))]
    columns = ["cohort", "variant", *[c for c in raw.columns if c != "cohort"]]
    return both[0].unionByName(both[1]).select(*columns).orderBy("cohort", "variant", "row_order")


def q_cohort_grid(spark, sf_dir):
    return _grid(spark, sf_dir, REF_STRATA)


def q_cohort_grid_by_segment(spark, sf_dir):
    return _grid(spark, sf_dir, SEGMENT_STRATA)


def q_cohort_grid_base_share(spark, sf_dir):
    """Raw cohorts with the shares of the whole base, as slices of a finished base report them."""
    whole = narrow_base(spark, sf_dir, ["survey_dt", "stage"])
    return outcome_report(explode_cohorts(whole, COHORTS), keys=["cohort"], shares=base_shares(whole))


def q_outcome_report_from_cube(spark, sf_dir):
    """Every raw cohort from one stored cube, without the people."""
    cube = VersionedTable(spark, _scratch(spark, "cube"))
    cube.write(outcome_cube(base(spark, sf_dir, ["survey_dt", "stage"])))
    return outcome_report_from_cube(explode_cohorts(cube.read(), COHORTS), keys=["cohort"])


def q_cohort_summary_from_cube(spark, sf_dir):
    """Rows, missing, mean and SD of every raw cohort from the cube's moments."""
    cube = explode_cohorts(outcome_cube(base(spark, sf_dir, ["survey_dt", "stage"])), COHORTS)
    measures = cube_measures(cube, MEANS, "category", ["cohort"], SHARE_SPECS)
    return rounded(continuous_rows(measures, MEANS, keys=["cohort"], ratios=SHARE_SPECS), "sd")


#: a run late in the evening of 30 June in Chicago
RUN = dt.datetime(2000, 7, 1, 3, 30)


def q_stamped_report(spark, sf_dir):
    """The outcome report with the day of the run in the reporting time zone, as file names carry it."""
    return outcome_report(base(spark, sf_dir)).withColumn("run_day", run_stamp(RUN))


def q_population_head(spark, sf_dir, n: int = 5):
    """The first people by id (top-k: a few rows a task before one merges them)."""
    return out(population(spark, sf_dir, ["category", "tier", "age_band", "own_rev_y1", "own_rev_y2", "cust_value"]).orderBy("party_id").limit(n))


def q_group_comparison(spark, sf_dir):
    """Welch's F of the means and chi-square of the levels between the categories, for every raw cohort, from the cube."""
    cube = reused(explode_cohorts(outcome_cube(base(spark, sf_dir, ["survey_dt", "stage"])), COHORTS))
    means = welch(cube_measures(cube, MEANS, "category", ["cohort"]), MEANS, keys=["cohort"])
    levels = chi_square(cube_levels(cube, [*CATEGORICAL, "category"], ["cohort"]), CATEGORICAL, keys=["cohort"])
    return rounded(means.unionByName(levels), "statistic", "df2")


def q_balance_differences(spark, sf_dir, strata=SEGMENT_STRATA):
    """Standardised differences of the reference pair before and after balancing."""
    rows = banded_base(spark, sf_dir, strata)
    marked = mark_sample(rows, strata, seed=SEED, mark="_in")
    variants = F.array_compact(F.array(F.lit(RAW), F.when(F.col("_in"), F.lit(BALANCED))))
    agg = group_measures(marked.withColumn("variant", F.explode(variants)), MEANS, "category", ["variant"])
    return rounded(standardised_differences(agg, MEANS, REF_PAIR, keys=["variant"]), "difference")


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/core/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def q_latest_survey_incremental(spark, sf_dir):
    """The latest survey per person, merged batch by batch; the batches are no date order, so most bring late rows."""
    survey = tables(spark, sf_dir)["survey"].select("party_id", "survey_id", "survey_dt", "category", "transactor_stage", "tenure")
    state = LatestSurveys(VersionedTable(spark, _scratch(spark, "latest")), BINDING.survey_start, BINDING.survey_end)
    return state.advance_all((f"batch-{k}", survey.where(F.col("survey_id") % 3 == k)) for k in range(3))


def q_pull_ledger(spark, sf_dir):
    """Row counts of the pull's steps, observed in the job that pulls."""
    people, ledger = observed_pull(tables(spark, sf_dir), BINDING.survey_start, BINDING.survey_end, LABELS, ["category"])
    people.write.format("noop").mode("overwrite").save()
    return ledger.frame(spark)


def q_contract_report(spark, sf_dir):
    """Every expectation of the six relations, with what the scans found."""
    return contracts.report_all(tables(spark, sf_dir), list(CONTRACTS.values()))


def q_report_store(spark, sf_dir):
    """The outcome report written as a version of a store and read back through its manifest."""
    store = VersionedTable(spark, _scratch(spark, "reports"))
    store.write(outcome_report(base(spark, sf_dir)).repartition(1), notes={"report": "outcome"})
    return store.read()


def q_population_from_store(spark, sf_dir):
    """The whole pull from relations written bucketed by person and partitioned by month."""
    prefix = f"spendlens_{uuid.uuid4().hex}"
    relations = tables(spark, sf_dir)
    write_store(relations, prefix, buckets_for(relations))
    store = RelationStore(spark, prefix, BINDING.survey_start, BINDING.survey_end)
    return rounded(out(build_population(store, BINDING.survey_start, BINDING.survey_end, LABELS, on_duplicates="trust")), "own_share_pct")


QUERIES: dict[str, Callable] = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
