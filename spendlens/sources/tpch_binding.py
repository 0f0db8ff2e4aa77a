"""Bind the driver's TPC-H-like tables onto the six input relations.

survey      <- orders (one response per order; customer = person)
spend_yN    <- lineitem of year N with linestatus 'F'
cust_yN     <- lineitem of year N, plus customer / nation / region attributes
individual  <- customer

Relations are built when they are asked for, and no job runs for it.  All
amounts are summed as decimals, so totals are exact and identical in any
engine.  The four relations of the lines are cut from one frame with a row per
customer: lines are first aggregated per order, then per customer with one
column set per year.  That frame is narrow (no strings but three) and marked as
reused, so a session scans the lines once for it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.functions.recodes import LOC_PRIMARY, LOC_SECONDARY, Labels, recode
from spendlens.plans.cohorts import Cohort
from spendlens.session import reused
from spendlens.sources.relations import AMOUNT, SCHEMAS, conform

DEC = "decimal(18,2)"


@dataclass(frozen=True)
class Binding:
    """Dates of the binding (all bounds inclusive)."""

    survey_start: dt.date = dt.date(2000, 1, 1)
    survey_end: dt.date = dt.date(2000, 6, 30)
    year1_start: dt.date = dt.date(1999, 7, 1)
    year1_end: dt.date = dt.date(2000, 6, 30)
    year2_start: dt.date = dt.date(2000, 7, 1)
    year2_end: dt.date = dt.date(2001, 6, 30)


# Fixed values of the binding: order priority -> category; every NO_CATEGORY-th order has none
CATEGORY_OF = {"1-URGENT": "Detractor", "2-HIGH": "Detractor", "3-MEDIUM": "Passive"}
OTHER_CATEGORY = "Promoter"
NO_CATEGORY = 41
# market segment -> customer type code; the fifth segment -> 'U'
TYPE_OF = {"AUTOMOBILE": "solo", "BUILDING": "earner", "FURNITURE": "saver", "HOUSEHOLD": "holder"}
# nationkey % 7: 0 -> non-member, 1..6 -> these tier codes
TIER_CODES = ["c1", "c2", "c3", "c4", "c5", "c6"]
# supplier key % 3 -> class of the merchant
MERCHANT_CLASSES = ["national", "budget", "foreign"]

LABELS = Labels(
    transactor_stages={"1": "1 Guest", "2": "2 Registered", "3": "3 Card holder"},
    customer_stages={"solo": "Stage 1: no account", "earner": "Stage 2: earns on trips", "saver": "Stage 3: earns on trips and purchases",
                     "holder": "Stage 4: earns on purchases or not at all"},
    other_stage="U",
    tiers={"c1": "1 Platinum", "c2": "2 Gold", "c3": "3 Silver", "c4": "4 Bronze", "c5": "5 Blue", "c6": "6 Basic"},
    non_member_flag="N",
    non_member="0 None",
    hubs={**{f"NATION_{i}": LOC_PRIMARY for i in range(5)}, **{f"NATION_{i}": LOC_SECONDARY for i in range(5, 10)}},
    home_country="AMERICA",
)

COHORTS = [
    Cohort("6m", 88),
    Cohort("3m", 77, dt.date(2000, 4, 1), dt.date(2000, 6, 30)),
    Cohort("1m", 88, dt.date(2000, 6, 1), dt.date(2000, 6, 30)),
    Cohort("stage2", 88, stage=LABELS.customer_stages["earner"]),
]


def _d(x: dt.date) -> Column:
    return F.lit(x.isoformat()).cast("date")


def _steps(value: Column, bounds: list[tuple[float, str]], other: str) -> Column:
    """The label of the first bound that the value reaches; null stays null."""
    out = F.when(value.isNotNull(), F.lit(other))
    for bound, label in reversed(bounds):
        out = F.when(value >= bound, F.lit(label)).otherwise(out)
    return out


class BoundTables(Mapping):
    """The six relations by name, each built at its first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, dates: Binding = Binding()):
        self._spark, self._dir, self._dates = spark, sf_dir, dates
        self._built: dict[str, DataFrame] = {}

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        return self._once(name, lambda: conform(getattr(self, f"_{name}")(), name))

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def _read(self, table: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{table}.parquet")

    def _survey(self) -> DataFrame:
        order, cust = F.col("o_orderkey"), F.col("o_custkey")
        delay = F.when(order % 11 != 0, (order % 240).cast("double"))
        return self._read("orders").select(
            cust.alias("party_id"),
            order.alias("survey_id"),
            F.to_date("o_orderdate").alias("survey_dt"),
            F.when(order % NO_CATEGORY != 0, recode(F.col("o_orderpriority"), CATEGORY_OF, F.lit(OTHER_CATEGORY))).alias("category"),
            delay.alias("delay_mins"),
            _steps(delay, [(60, "long"), (1, "short")], "none").alias("delay_cat"),
            F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N").alias("disruption_ind"),
            (cust % 4).cast("string").alias("transactor_stage"),
            F.when(cust % 7 != 0, (cust % 3).cast("string")).alias("tenure"),
            F.when(cust % 13 != 0, F.concat(F.lit("G"), (cust % 5).cast("string"))).alias("generation"),
        )

    def _customer_years(self) -> DataFrame:
        """One row per customer with the line totals of both years (exact decimals)."""
        b = self._dates
        odate = F.to_date("o_orderdate")
        orders = (self._read("orders").where(odate.between(_d(b.year1_start), _d(b.year2_end)))
                  .select("o_orderkey", "o_custkey", F.when(odate <= _d(b.year1_end), 1).otherwise(2).alias("yr")))
        dec = lambda c: F.col(c).cast(DEC)
        lines = self._read("lineitem").select(
            "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity",
            (F.col("l_linestatus") == "F").alias("final"), (F.col("l_returnflag") == "A").alias("own"))
        # the slow conversion to decimals is for the lines of the two years only
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "o_orderkey", "o_custkey", "yr", "l_suppkey", dec("l_extendedprice").alias("price"), dec("l_discount").alias("disc"),
            dec("l_tax").alias("tax"), dec("l_quantity").alias("qty"), "final", "own")
        price, disc, tax, final = F.col("price"), F.col("disc"), F.col("tax"), F.col("final")
        sums = {
            "own_f": F.when(final, F.when(F.col("own"), price).otherwise(F.lit(0).cast(DEC))),
            "tot_f": F.when(final, price),
            "ticket": price,
            "non_award": F.when(disc == 0, price),
            "ancillary": (price * tax).cast(DEC),
            "displacement": (price * disc).cast(DEC),
            "flight_value": price * (F.lit(1) - disc),
            "currency": tax * F.col("qty"),
            "qty": F.col("qty"),
        }
        tops = {}
        for k, name in enumerate(MERCHANT_CLASSES):
            of_class = final & (F.col("l_suppkey") % len(MERCHANT_CLASSES) == k)
            sums[name] = F.when(of_class, price)
            tops[f"top_{name}"] = F.when(of_class, F.col("l_suppkey"))
        counts = {"lines": F.lit(1), "n_f": F.when(final, 1)}
        per_order = (lines.groupBy("o_orderkey", "o_custkey", "yr")
                     .agg(*[F.sum(e).alias(c) for c, e in sums.items()], *[F.max(e).alias(c) for c, e in tops.items()],
                          *[F.count(e).alias(c) for c, e in counts.items()]))
        aggs = []
        for y in (1, 2):
            of_year = lambda c: F.when(F.col("yr") == y, F.col(c))  # noqa: B023, E731
            aggs += [F.sum(of_year(c)).alias(f"{c}_{y}") for c in (*sums, *counts)]
            aggs += [F.max(of_year(c)).alias(f"{c}_{y}") for c in tops]
            aggs.append(F.count(of_year("o_orderkey")).alias(f"trips_{y}"))
        return reused(per_order.groupBy(F.col("o_custkey").alias("party_id")).agg(*aggs), shared=True)

    def customer_years(self) -> DataFrame:
        return self._once("customer_years", self._customer_years)

    def _spend_y1(self) -> DataFrame:
        return self.customer_years().where("n_f_1 > 0").select("party_id", F.col("own_f_1").alias("own_rev"), F.col("tot_f_1").alias("total_spend"))

    def _spend_y2(self) -> DataFrame:
        own, total = F.col("own_f_2").cast(AMOUNT), F.col("tot_f_2").cast(AMOUNT)
        share = F.when(total != 0, F.lit(100.0) * own.cast("double") / total.cast("double"))
        by_class = []
        for name in MERCHANT_CLASSES:
            spent = F.col(f"{name}_2")
            by_class += [spent.alias(f"{name}_spend"), F.when(spent > 0, "Y").otherwise("N").alias(f"{name}_ind"),
                         F.concat(F.lit("S"), F.col(f"top_{name}_2").cast("string")).alias(f"{name}_merchants")]
        return self.customer_years().where("n_f_2 > 0").select(
            "party_id", own.alias("own_rev"), total.alias("total_spend"), (total - own).alias("other_spend"), share.alias("own_share_pct"),
            F.when(F.col("n_f_2") >= 8, "frequent").otherwise("occasional").alias("customer_group"), F.lit("Y").alias("match_ind"),
            F.when(own > 0, "Y").otherwise("N").alias("own_rev_ind"), F.when(total > own, "Y").otherwise("N").alias("other_spend_ind"), *by_class,
            _steps(total, [(600000, "high"), (200000, "middle")], "low").alias("total_spend_band"),
            _steps(share, [(60, "main"), (25, "shared")], "minor").alias("own_share_band"),
            _steps(total, [(800000, "T1"), (400000, "T2")], "T3").alias("total_spend_tier"),
            _steps(share, [(75, "S1"), (40, "S2")], "S3").alias("own_share_tier"))

    def _values(self, y: int) -> list[Column]:
        named = {"ticket": "ticket_rev", "non_award": "ticket_rev_non_award", "ancillary": "ancillary_rev", "flight_value": "flight_value", "currency": "currency_value"}
        return [F.col(f"{c}_{y}").alias(n) for c, n in named.items()]

    def _cust_y2(self) -> DataFrame:
        return self.customer_years().where("lines_2 > 0").select("party_id", *self._values(2))

    def _latest_status(self) -> DataFrame:
        """Order status of each customer's latest order in the survey window."""
        odate = F.to_date("o_orderdate")
        latest = Window.partitionBy("o_custkey").orderBy(odate.desc(), F.col("o_orderkey").desc())
        return (self._read("orders").where(odate.between(_d(self._dates.survey_start), _d(self._dates.survey_end)))
                .select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
                .withColumn("n", F.row_number().over(latest)).where("n = 1")
                .select(F.col("o_custkey").alias("party_id"), F.col("o_orderstatus").alias("intent")))

    def _cust_y1(self) -> DataFrame:
        places = (self._read("nation").join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                  .select("n_nationkey", F.col("n_name").alias("home_airport"), F.col("r_name").alias("home_country")))
        nation7, key = F.col("c_nationkey") % 7, F.col("c_custkey")
        people = (self._read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                  .select(key.alias("party_id"), F.col("c_acctbal").alias("cust_value"),
                          recode(F.col("c_mktsegment"), TYPE_OF, F.lit("U")).alias("cust_type"),
                          F.when(nation7 == 0, "N").otherwise("Y").alias("member_ind"),
                          recode(nation7, dict(enumerate(TIER_CODES, 1)), F.lit(None).cast("string")).alias("tier_code"),
                          F.when(key % 3 == 0, "agency").otherwise("direct").alias("channel_type"),
                          F.concat(F.lit("Y"), (key % 6).cast("string")).alias("cust_tenure"), "home_airport", "home_country"))
        year = self.customer_years().where("lines_1 > 0").select(
            "party_id", *self._values(1), F.col("displacement_1").alias("displacement"), F.col("qty_1").alias("rpm"), F.col("trips_1").alias("no_of_trips"))
        return year.join(people, "party_id").join(self._latest_status(), "party_id", "left")

    def _individual(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._read("customer").select(key.alias("party_id"), (F.lit(1920) + key % 110).alias("birth_year"))
