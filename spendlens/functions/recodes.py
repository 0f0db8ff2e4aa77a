"""Recodes as column expressions, driven by label tables that the caller supplies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the age bands (birth years, both ends inclusive)
AGE_BANDS = [
    (1928, 1945, "1_Silent_Generation"),
    (1946, 1964, "2_Baby_Boomers"),
    (1965, 1980, "3_Gen_X"),
    (1981, 1996, "4_Millennials"),
    (1997, 2012, "5_Gen_Z"),
    (2013, 2025, "6_Alpha"),
]
AGE_BAND_NA = "7_Age_band_Not_Available"
# Travel frequency labels
NON_FLYER = "Non-Flyers"
TRIP_LABELS = {1: "1 Trip", 2: "2 Trips", 3: "3 Trips"}
MANY_TRIPS = (4, "4+ Trips")
FREQUENCY_ERROR = "Error"
# Home-location buckets
LOC_PRIMARY = "1 - PRIMARY HUBS"
LOC_SECONDARY = "2 - SECONDARY HUBS + FOCUS CITIES"
LOC_DOMESTIC = "3 - DOMESTIC SPOKES"
LOC_INTERNATIONAL = "4 - INTERNATIONAL SPOKES"
LOC_UNKNOWN = "5 - UNK"
# Churn labels
CHURNED = "Churned"
NOT_CHURNED = "Not Churned"


@dataclass(frozen=True)
class Labels:
    """The vocabulary of a deployment: what its codes are called."""

    transactor_stages: Mapping[str, str]
    customer_stages: Mapping[str, str]
    other_stage: str
    tiers: Mapping[str, str]
    non_member_flag: str
    non_member: str
    hubs: Mapping[str, str]
    home_country: str
    normalize_codes: bool = False


def normalized(code: Column, labels: Labels) -> Column:
    """Codes of a warehouse that compares them ignoring case and trailing blanks."""
    return F.upper(F.rtrim(code)) if labels.normalize_codes else code


def recode(code: Column, table: Mapping, default: Column | None = None) -> Column:
    """Look a code up; codes that are not in the table (null too) give the default."""
    out = F.lit(None) if default is None else default
    for key, label in table.items():
        out = F.when(code == F.lit(key), F.lit(label)).otherwise(out)
    return out


def transactor_stage_label(stage: Column, labels: Labels) -> Column:
    """Known codes get a label, others pass through."""
    return recode(normalized(stage, labels), labels.transactor_stages, stage)


def customer_stage(cust_type: Column, labels: Labels) -> Column:
    return recode(normalized(cust_type, labels), labels.customer_stages, F.lit(labels.other_stage))


def tier(member_ind: Column, tier_code: Column, labels: Labels) -> Column:
    """The flag of non-members comes before the code; unknown codes have no tier."""
    code = recode(normalized(tier_code, labels), labels.tiers, F.lit(None).cast("string"))
    return F.when(normalized(member_ind, labels) == F.lit(labels.non_member_flag), F.lit(labels.non_member)).otherwise(code)


def age_band(birth_year: Column, bands: Sequence[tuple[int, int, str]] = tuple(AGE_BANDS)) -> Column:
    named = [F.when(birth_year.between(lo, hi), F.lit(label)) for lo, hi, label in bands]
    return F.coalesce(*named, F.lit(AGE_BAND_NA))


def travel_frequency(rpm_raw: Column, trips: Column) -> Column:
    """A raw rpm of 0 is a non-flyer whatever the trips say."""
    by_trips = recode(trips, TRIP_LABELS, F.when(trips >= MANY_TRIPS[0], F.lit(MANY_TRIPS[1])).otherwise(F.lit(FREQUENCY_ERROR)))
    return F.when(rpm_raw == 0, F.lit(NON_FLYER)).otherwise(by_trips)


def home_location(airport: Column, country: Column, labels: Labels) -> Column:
    """A hub by its own table; any other known airport by its country; the rest is unknown."""
    hub = recode(normalized(airport, labels), labels.hubs, F.lit(None).cast("string"))
    spoke = F.when(country == F.lit(labels.home_country), F.lit(LOC_DOMESTIC)).when(country.isNotNull(), F.lit(LOC_INTERNATIONAL))
    return F.coalesce(hub, F.when(airport.isNotNull(), spoke), F.lit(LOC_UNKNOWN))


def churn_label(own_rev_category: Column) -> Column:
    return F.when(own_rev_category == F.lit("0"), F.lit(CHURNED)).otherwise(F.lit(NOT_CHURNED))
