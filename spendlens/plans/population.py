"""Population pull: latest survey per person in a window, five left joins, recodes.

Each relation contributes a part: the columns it gives and what they are for a
person it does not know.  Recodes and roll-ups are computed in the relation,
before the join, and only the parts are joined that the asked columns need.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions import recodes as R
from spendlens.functions.numeric import zin, zin_sum
from spendlens.operators.latest import latest_per_key
from spendlens.sources.relations import one_per_key

KEY = "party_id"
#: output column -> (expression in the relation, value for people without a row; None is null)
Part = dict[str, tuple[Column, object]]


def _date(x):
    if isinstance(x, str):
        x = dt.date.fromisoformat(x)
    return F.lit(x.isoformat()).cast("date")


def _plain(*names: str) -> Part:
    return {n: (F.col(n), None) for n in names}


def survey_part(labels: R.Labels) -> Part:
    return {**_plain("survey_dt", "category", "delay_cat", "delay_mins", "disruption_ind", "transactor_stage", "tenure", "generation"),
            "transactor_stage_label": (R.transactor_stage_label(F.col("transactor_stage"), labels), None)}


def spend_part(labels: R.Labels) -> Part:
    """Spend panel of year 2."""
    return {"own_rev_y2": (F.col("own_rev"), None), "total_spend_y2": (F.col("total_spend"), None),
            **_plain("other_spend", "national_spend", "budget_spend", "foreign_spend", "own_share_pct", "customer_group", "match_ind", "own_rev_ind",
                     "other_spend_ind", "national_ind", "budget_ind", "foreign_ind", "national_merchants", "budget_merchants", "foreign_merchants",
                     "total_spend_band", "own_share_band", "total_spend_tier", "own_share_tier")}


def first_year_spend_part(labels: R.Labels) -> Part:
    return {"own_rev_y1": (F.col("own_rev"), None), "total_spend_y1": (F.col("total_spend"), None)}


def _revenue(year: int) -> Part:
    """Roll-ups: the non-award one counts missing parts as 0 and is never null, the others are null if a part is."""
    flights = F.col("ticket_rev") + F.col("ancillary_rev")
    return {
        f"flight_rev_y{year}": (zin_sum(F.col("ticket_rev_non_award"), F.col("ancillary_rev")), 0),
        f"flight_revenue_y{year}": (flights, None),
        f"total_revenue_y{year}": (flights + F.col("currency_value"), None),
        f"flight_value_y{year}": (F.col("flight_value"), None),
        f"currency_rev_y{year}": (F.col("currency_value"), None),
    }


def value_part(labels: R.Labels) -> Part:
    """Customer value of year 1, with its recodes."""
    kept = zin(F.col("ticket_rev")) + zin(F.col("ancillary_rev")) - zin(F.col("displacement"))
    return {
        **_revenue(1), **_plain("cust_type", "member_ind", "tier_code", "no_of_trips", "channel_type", "cust_tenure", "cust_value", "currency_value", "intent"),
        "rpm": (zin(F.col("rpm")), 0.0),
        "flight_rev_displacement": (kept, 0),
        "home_location": (R.home_location(F.col("home_airport"), F.col("home_country"), labels), R.LOC_UNKNOWN),
        "stage": (R.customer_stage(F.col("cust_type"), labels), labels.other_stage),
        "tier": (R.tier(F.col("member_ind"), F.col("tier_code"), labels), None),
        "travel_frequency": (R.travel_frequency(F.col("rpm"), F.col("no_of_trips")), R.FREQUENCY_ERROR),
    }


def second_year_value_part(labels: R.Labels) -> Part:
    return _revenue(2)


def person_part(labels: R.Labels) -> Part:
    return {"age_band": (R.age_band(F.col("birth_year")), R.AGE_BAND_NA)}


#: relation -> its part, in join order
PARTS: dict[str, Callable[[R.Labels], Part]] = {
    "spend_y2": spend_part,
    "spend_y1": first_year_spend_part,
    "cust_y1": value_part,
    "cust_y2": second_year_value_part,
    "individual": person_part,
}


def latest_survey(survey: DataFrame, start, end, keep_null_party: bool = False) -> DataFrame:
    """Respondents in [start, end] (null dates dropped), latest survey per person.

    Ties on the date are broken by the survey id, descending.
    """
    s = survey.where(F.col("survey_dt").between(_date(start), _date(end)))
    return latest_per_key(s, KEY, [F.col("survey_dt").desc(), F.col("survey_id").desc()],
                          keep_null_key=keep_null_party)


def build_population(tables: Mapping[str, DataFrame], start, end, labels: R.Labels, columns: Sequence[str] | None = None,
                     keep_null_party: bool = False, on_duplicates: str = "first", flags: bool = False) -> DataFrame:
    """One row per person of the window with ``columns`` (default: all).

    The survey is deduplicated *before* the joins, and each right side has one
    row per person (``on_duplicates``: see ``one_per_key``), so a join never
    multiplies people and later joins reuse the hash partitioning on the key.
    Relations that no column comes from are neither joined nor built.  ``flags``
    adds ``in_<relation>`` for each joined one: the person has a row in it.
    """
    wanted = None if columns is None else {KEY, *columns}
    pick = lambda part: {n: x for n, x in part.items() if wanted is None or n in wanted}
    own = pick(survey_part(labels))
    out = latest_survey(tables["survey"], start, end, keep_null_party).select(KEY, *[e.alias(n) for n, (e, _) in own.items()])
    names = list(own)
    for relation, of in PARTS.items():
        part = pick(of(labels))
        if not part:
            continue
        found = [F.lit(True).alias(f"in_{relation}")] if flags else []
        right = one_per_key(tables[relation], KEY, on_duplicates, relation).select(KEY, *[e.alias(n) for n, (e, _) in part.items()], *found)
        if flags:
            part = {**part, f"in_{relation}": (None, False)}
        out = out.join(right, KEY, "left").withColumns(
            {n: F.coalesce(F.col(n), F.lit(other).cast(right.schema[n].dataType)) for n, (_, other) in part.items() if other is not None})
        names += part
    unknown = (wanted or set()) - {KEY, *names}
    if unknown:
        raise ValueError(f"no relation gives {sorted(unknown)}")
    return out.select(KEY, *names)
