"""DuckDB SQL oracles for the named queries.

Each oracle recomputes its query from the raw parquet views (orders, lineitem,
customer, nation, region) in plain SQL.  The recodes are joins with VALUES
tables, bands come from row numbers, samples from ROW_NUMBER() over the md5
order, reports from plain GROUP BYs.  Vocabulary and dates are the binding's.
"""

from __future__ import annotations

from spendlens.functions import recodes as R
from spendlens.operators.balance import CATEGORIES
from spendlens.plans.cohorts import REF_STRATA
from spendlens.plans.derive import FILL_ZERO
from spendlens.plans.queries import COVERAGE, SEED, SEGMENT_STRATA, SEGMENTS
from spendlens.plans.report import CATEGORICAL, MEANS, REPORT_ROWS
from spendlens.sources import tpch_binding as TB
from spendlens.sources.relations import SCHEMAS

B, LABELS = TB.Binding(), TB.LABELS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d(x) -> str:
    return f"DATE '{x.isoformat()}'"


def values(name: str, columns: str, rows) -> str:
    """A lookup table as a CTE."""
    lit = lambda x: q(x) if isinstance(x, str) else str(x)
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


LOOKUPS = ",\n".join([
    values("category_of", "priority, category", TB.CATEGORY_OF.items()),
    values("type_of", "segment, code", TB.TYPE_OF.items()),
    values("code_of_nation", "rest, code", list(enumerate(TB.TIER_CODES, 1))),
    values("stage_name", "code, label", LABELS.customer_stages.items()),
    values("transactor_name", "code, label", LABELS.transactor_stages.items()),
    values("tier_name", "code, label", LABELS.tiers.items()),
    values("hub", "airport, label", LABELS.hubs.items()),
    values("birth_band", "first_year, last_year, label", R.AGE_BANDS),
    values("trip_name", "trips, label", R.TRIP_LABELS.items()),
])

# per class of merchant: spend, flag and top merchant
_CLASS_SUMS = ", ".join(f"sum(price) FILTER (WHERE final AND l_suppkey % 3 = {k}) AS spent_{c}, max(l_suppkey) FILTER (WHERE final AND l_suppkey % 3 = {k}) AS top_{c}"
                        for k, c in enumerate(TB.MERCHANT_CLASSES))
_CLASS_COLS = ", ".join(f"CAST(spent_{c} AS DECIMAL(18,2)) AS {c}_spend, CASE WHEN spent_{c} > 0 THEN 'Y' ELSE 'N' END AS {c}_ind, 'S' || top_{c} AS {c}_merchants"
                        for c in TB.MERCHANT_CLASSES)


def _value_columns(year: int) -> str:
    return f"""SELECT o_custkey AS party_id, ticket + ancillary AS flight_revenue_y{year}, ticket + ancillary + currency_value AS total_revenue_y{year},
    COALESCE(non_award, 0) + COALESCE(ancillary, 0) AS flight_rev_y{year}, flight_value AS flight_value_y{year}, currency_value AS currency_rev_y{year}"""


SOURCES = f"""
{LOOKUPS},
responses AS (
  SELECT o_custkey AS party_id, o_orderkey AS survey_id, CAST(o_orderdate AS DATE) AS survey_dt, o_orderstatus,
         CASE WHEN o_orderkey % {TB.NO_CATEGORY} <> 0 THEN COALESCE(category_of.category, '{TB.OTHER_CATEGORY}') END AS category,
         CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 240 AS DOUBLE) END AS delay_mins
  FROM orders LEFT JOIN category_of ON priority = o_orderpriority),
in_window AS (SELECT * FROM responses WHERE party_id IS NOT NULL AND survey_dt BETWEEN {d(B.survey_start)} AND {d(B.survey_end)}),
latest AS (
  SELECT *, CAST(party_id % 4 AS VARCHAR) AS transactor_stage, CASE WHEN party_id % 7 <> 0 THEN CAST(party_id % 3 AS VARCHAR) END AS tenure,
         CASE WHEN party_id % 13 <> 0 THEN 'G' || (party_id % 5) END AS generation,
         CASE WHEN delay_mins >= 60 THEN 'long' WHEN delay_mins >= 1 THEN 'short' WHEN delay_mins IS NOT NULL THEN 'none' END AS delay_cat,
         CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS disruption_ind
  FROM in_window QUALIFY row_number() OVER (PARTITION BY party_id ORDER BY survey_dt DESC, survey_id DESC) = 1),
bought AS (
  SELECT o_custkey, o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= {d(B.year1_end)} THEN 1 ELSE 2 END AS yr, l_suppkey,
         l_linestatus = 'F' AS final, l_returnflag = 'A' AS own, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(l_discount AS DECIMAL(18,2)) AS disc, CAST(l_tax AS DECIMAL(18,2)) AS tax, CAST(l_quantity AS DECIMAL(18,2)) AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) BETWEEN {d(B.year1_start)} AND {d(B.year2_end)}),
years AS (
  SELECT o_custkey, yr, count(DISTINCT o_orderkey) AS trips, count(*) FILTER (WHERE final) AS n_final,
         CAST(sum(CASE WHEN own THEN price ELSE 0 END) FILTER (WHERE final) AS DECIMAL(18,2)) AS own_rev, CAST(sum(price) FILTER (WHERE final) AS DECIMAL(18,2)) AS total,
         CAST(sum(price) AS DECIMAL(18,2)) AS ticket, CAST(sum(price) FILTER (WHERE disc = 0) AS DECIMAL(18,2)) AS non_award,
         CAST(sum(CAST(price * tax AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS ancillary, CAST(sum(CAST(price * disc AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS displacement,
         CAST(sum(price * (1 - disc)) AS DOUBLE) AS flight_value, CAST(sum(tax * qty) AS DOUBLE) AS currency_value, CAST(sum(qty) AS DOUBLE) AS rpm, {_CLASS_SUMS}
  FROM bought GROUP BY o_custkey, yr),
first_spend AS (SELECT o_custkey AS party_id, own_rev AS own_rev_y1, total AS total_spend_y1 FROM years WHERE yr = 1 AND n_final > 0),
second_spend AS (
  SELECT *, CASE WHEN total_spend_y2 >= 600000 THEN 'high' WHEN total_spend_y2 >= 200000 THEN 'middle' ELSE 'low' END AS total_spend_band,
         CASE WHEN own_share_pct >= 60 THEN 'main' WHEN own_share_pct >= 25 THEN 'shared' WHEN own_share_pct IS NOT NULL THEN 'minor' END AS own_share_band,
         CASE WHEN total_spend_y2 >= 800000 THEN 'T1' WHEN total_spend_y2 >= 400000 THEN 'T2' ELSE 'T3' END AS total_spend_tier,
         CASE WHEN own_share_pct >= 75 THEN 'S1' WHEN own_share_pct >= 40 THEN 'S2' WHEN own_share_pct IS NOT NULL THEN 'S3' END AS own_share_tier
  FROM (SELECT o_custkey AS party_id, own_rev AS own_rev_y2, total AS total_spend_y2, CAST(total - own_rev AS DECIMAL(18,2)) AS other_spend,
               CASE WHEN total <> 0 THEN CAST(100 AS DOUBLE) * CAST(own_rev AS DOUBLE) / CAST(total AS DOUBLE) END AS own_share_pct,
               CASE WHEN n_final >= 8 THEN 'frequent' ELSE 'occasional' END AS customer_group, 'Y' AS match_ind,
               CASE WHEN own_rev > 0 THEN 'Y' ELSE 'N' END AS own_rev_ind, CASE WHEN total > own_rev THEN 'Y' ELSE 'N' END AS other_spend_ind, {_CLASS_COLS}
        FROM years WHERE yr = 2 AND n_final > 0)),
second_value AS ({_value_columns(2)} FROM years WHERE yr = 2),
home AS (SELECT n_nationkey, n_name AS airport, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey),
person AS (
  SELECT c_custkey AS party_id, c_acctbal AS cust_value, COALESCE(type_of.code, 'U') AS cust_type, CASE WHEN c_nationkey % 7 = 0 THEN 'N' ELSE 'Y' END AS member_ind,
         code_of_nation.code AS tier_code, CASE WHEN c_custkey % 3 = 0 THEN 'agency' ELSE 'direct' END AS channel_type, 'Y' || (c_custkey % 6) AS cust_tenure,
         CASE WHEN c_nationkey % 7 = 0 THEN {q(LABELS.non_member)} ELSE tier_name.label END AS tier, COALESCE(stage_name.label, {q(LABELS.other_stage)}) AS stage,
         CASE WHEN hub.label IS NOT NULL THEN hub.label WHEN home.airport IS NULL OR home.country IS NULL THEN {q(R.LOC_UNKNOWN)}
              WHEN home.country = {q(LABELS.home_country)} THEN {q(R.LOC_DOMESTIC)} ELSE {q(R.LOC_INTERNATIONAL)} END AS home_location
  FROM customer LEFT JOIN type_of ON segment = c_mktsegment LEFT JOIN code_of_nation ON rest = c_nationkey % 7 LEFT JOIN home ON n_nationkey = c_nationkey
  LEFT JOIN tier_name ON tier_name.code = code_of_nation.code LEFT JOIN stage_name ON stage_name.code = COALESCE(type_of.code, 'U') LEFT JOIN hub ON hub.airport = home.airport),
first_value AS (
  SELECT v.*, person.* EXCLUDE (party_id), y.trips, y.rpm AS miles, y.ticket + y.ancillary - y.displacement AS flight_rev_displacement,
         CASE WHEN y.rpm = 0 THEN {q(R.NON_FLYER)} WHEN y.trips >= {R.MANY_TRIPS[0]} THEN {q(R.MANY_TRIPS[1])} ELSE COALESCE(trip_name.label, {q(R.FREQUENCY_ERROR)}) END AS frequency
  FROM ({_value_columns(1)} FROM years WHERE yr = 1) v JOIN years y ON y.o_custkey = v.party_id AND y.yr = 1 JOIN person USING (party_id) LEFT JOIN trip_name USING (trips)),
ages AS (SELECT c_custkey AS party_id, label FROM customer LEFT JOIN birth_band ON 1920 + c_custkey % 110 BETWEEN first_year AND last_year),
population AS (
  SELECT latest.* EXCLUDE (survey_id, o_orderstatus), COALESCE(transactor_name.label, transactor_stage) AS transactor_stage_label,
         second_spend.* EXCLUDE (party_id), own_rev_y1, total_spend_y1,
         second_value.* EXCLUDE (party_id) REPLACE (COALESCE(flight_rev_y2, 0) AS flight_rev_y2),
         flight_revenue_y1, total_revenue_y1, COALESCE(flight_rev_y1, 0) AS flight_rev_y1, flight_value_y1, currency_rev_y1, currency_rev_y1 AS currency_value,
         cust_type, member_ind, tier_code, CAST(trips AS INTEGER) AS no_of_trips, channel_type, cust_tenure, cust_value,
         CASE WHEN first_value.party_id IS NOT NULL THEN latest.o_orderstatus END AS intent,
         COALESCE(miles, 0) AS rpm, COALESCE(flight_rev_displacement, 0) AS flight_rev_displacement, COALESCE(home_location, {q(R.LOC_UNKNOWN)}) AS home_location,
         COALESCE(stage, {q(LABELS.other_stage)}) AS stage, tier, COALESCE(frequency, {q(R.FREQUENCY_ERROR)}) AS travel_frequency, COALESCE(ages.label, {q(R.AGE_BAND_NA)}) AS age_band
  FROM latest LEFT JOIN second_spend USING (party_id) LEFT JOIN first_spend USING (party_id) LEFT JOIN first_value USING (party_id)
  LEFT JOIN second_value USING (party_id) LEFT JOIN ages USING (party_id) LEFT JOIN transactor_name ON transactor_name.code = transactor_stage)
"""


def sign_of(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'Missing' ELSE CASE sign({x}) WHEN 0 THEN '0' WHEN 1 THEN '>0' ELSE 'Checking' END END"


_FILLED = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in FILL_ZERO)

PEOPLE = f"""
people AS (
  SELECT *, CAST(own_rev_y2 IS NOT NULL AS INTEGER) AS match_flag, {sign_of('own_rev_y1')} AS own_rev_y1_cat, {sign_of('own_rev_y2')} AS own_rev_y2_cat,
         CASE WHEN own_rev_y2 = 0 THEN CAST(0 AS DOUBLE) WHEN own_rev_y2 > 0 THEN log10(CAST(own_rev_y2 AS DOUBLE)) END AS own_rev_log,
         CASE WHEN total_spend_y2 > 0 THEN log10(CAST(total_spend_y2 AS DOUBLE)) END AS total_spend_log
  FROM population WHERE category IS NOT NULL),
kept AS (SELECT * FROM people WHERE own_rev_y1 IS NOT NULL AND cust_value IS NOT NULL),
filled AS (
  SELECT * REPLACE ({_FILLED}), CASE WHEN own_rev_y2 = 0 THEN 1 ELSE 0 END AS zero_flag,
         flight_revenue_y1 AS flight_revenue_y1_raw, flight_revenue_y2 AS flight_revenue_y2_raw FROM kept),
base AS (
  SELECT *, {sign_of('own_rev_y2')} AS own_rev_y2_cat2, CASE WHEN own_rev_y2 = 0 THEN '{R.CHURNED}' ELSE '{R.NOT_CHURNED}' END AS churned,
         own_rev_y2 - own_rev_y1 AS own_rev_diff, total_spend_y2 - total_spend_y1 AS total_spend_diff FROM filled),
ranked AS (SELECT cust_value AS v, row_number() OVER (ORDER BY cust_value) - 1 AS r, count(*) OVER () AS n FROM base),
cuts AS (SELECT i, v FROM ranked JOIN range(1, 10) AS t(i) ON r = (n - 1) * i // 10),
banded AS (SELECT base.*, CAST(1 + (SELECT count(*) FROM cuts WHERE base.cust_value > cuts.v) AS INTEGER) AS value_band FROM base)
"""


def query(select: str, *more: str) -> str:
    return "WITH " + ",\n".join(x.strip() for x in (SOURCES, PEOPLE, *more)) + "\n" + select


def members(src: str) -> str:
    parts = []
    for c in TB.COHORTS:
        conditions = [f"survey_dt BETWEEN {d(c.start)} AND {d(c.end)}"] if c.start else []
        conditions += [f"stage = {q(c.stage)}"] if c.stage else []
        parts.append(f"SELECT {q(c.name)} AS cohort, {c.seed} AS seed, * FROM {src} WHERE {' AND '.join(conditions) or 'true'}")
    return "members AS (" + " UNION ALL ".join(parts) + ")"


# -- balancing ---------------------------------------------------------------

def shares_of(src: str, strata, by=()) -> str:
    """CTE ``strata_shares``: wide counts, totals and shares."""
    keys = ", ".join([*by, *strata])
    over = f"OVER (PARTITION BY {', '.join(by)})" if by else "OVER ()"
    n = ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS n_{c}" for c in CATEGORIES)
    total = ", ".join(f"CAST(sum(n_{c}) {over} AS BIGINT) AS total_{c}" for c in CATEGORIES)
    share = ", ".join(f"CASE WHEN total_{c} > 0 THEN CAST(n_{c} AS DOUBLE) / total_{c} ELSE CAST(0 AS DOUBLE) END AS share_{c}" for c in CATEGORIES)
    return f"""strata_n AS (SELECT {keys}, {n} FROM {src} GROUP BY {keys}),
strata_total AS (SELECT *, {total} FROM strata_n), strata_share AS (SELECT *, {share} FROM strata_total),
strata_shares AS (SELECT *, LEAST(share_Detractor, share_Promoter) AS least_share FROM strata_share)"""


def quotas_of(strata, by=(), exact: bool = False) -> str:
    """CTE ``quotas``: available and quota by (by, stratum, category)."""
    def amount(c: str) -> str:
        if not exact:
            return f"floor(CAST(total_{c} AS DOUBLE) * least_share)"
        part = lambda x: f"total_{c}::HUGEINT * n_{x} // total_{x}"
        return f"CASE WHEN total_Detractor = 0 OR total_Promoter = 0 THEN 0 ELSE LEAST({part('Detractor')}, {part('Promoter')}) END"

    keys = ", ".join([*by, *strata])
    return "quotas AS (" + " UNION ALL ".join(
        f"SELECT {keys}, '{c}' AS category, n_{c} AS available, CAST(LEAST(n_{c}, {amount(c)}) AS BIGINT) AS quota FROM strata_shares" for c in CATEGORIES) + ")"


def sample_of(src: str, strata, by=(), seed: str = str(SEED)) -> str:
    """CTE ``sample``: the rows of ``src`` within their quota."""
    keys = [*by, *strata, "category"]
    same = " AND ".join(f"o.{k} IS NOT DISTINCT FROM quotas.{k}" for k in keys)
    return f"""{shares_of(src, strata, by)}, {quotas_of(strata, by)},
in_order AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY md5({seed} || ':' || party_id), party_id) AS place FROM {src}),
sample AS (SELECT o.* EXCLUDE (place) FROM in_order o JOIN quotas ON {same} WHERE place <= quota)"""


# -- summaries and reports -----------------------------------------------------

SHARES = {"spend_share_y2": ("own_rev_y2", "total_spend_y2"), "spend_share_y1": ("own_rev_y1", "total_spend_y1")}


def share_sql(name: str, clamp: str = "false") -> str:
    """``clamp``: a condition; where it holds the denominator is clamped, else only zero is replaced."""
    num, den = (f"CAST(COALESCE(sum({c}), 0) AS DOUBLE)" for c in SHARES[name])
    return f"CAST(100 AS DOUBLE) * {num} / CASE WHEN {clamp} THEN GREATEST({den}, 1e-10::DOUBLE) WHEN {den} <> 0 THEN {den} ELSE 1e-10::DOUBLE END"


def mean_sql(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / nullif(count({c}), 0)"


def continuous(src: str, keys=(), clamp: str = "false") -> str:
    k = "".join(f"{x}, " for x in keys)
    parts = []
    for label, group in (("category", f"GROUP BY {k}category"), ("'Overall'", f"GROUP BY {', '.join(keys)}" if keys else "")):
        head = f"SELECT {k}{label} AS \"group\", count(*) AS n_rows"
        for c in MEANS:
            parts.append(f"{head}, '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS n_missing, {mean_sql(c)} AS mean, "
                         f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS sd FROM {src} {group}")
        for s in SHARES:
            sd = "CASE WHEN count(*) > 1 THEN CAST(0 AS DOUBLE) END" if label == "category" else "CAST(NULL AS DOUBLE)"
            parts.append(f"{head}, '{s}' AS variable, count(*) AS n, CAST(0 AS BIGINT) AS n_missing, {share_sql(s, clamp)} AS mean, {sd} AS sd FROM {src} {group}")
    return "\nUNION ALL ".join(parts)


def parity() -> str:
    """The plain summary, with overall shares as mean and SD of a share attached to every row."""
    each = ", ".join(f"{share_sql(s)} AS {s}" for s in SHARES)
    overall = " UNION ALL ".join(f"SELECT 'Overall' AS \"group\", '{s}' AS variable, avg({s}) AS m, stddev_samp({s}) AS s FROM attached" for s in SHARES)
    return query('SELECT p."group", n_rows, p.variable, n, n_missing, round(COALESCE(o.m, p.mean), 6) AS mean, round(COALESCE(o.s, p.sd), 6) AS sd '
                 'FROM plain p LEFT JOIN overall o ON o."group" = p."group" AND o.variable = p.variable',
                 f"plain AS ({continuous('base')})", f"by_group AS (SELECT category, {each} FROM base GROUP BY category)",
                 "attached AS (SELECT by_group.* FROM base JOIN by_group USING (category))", f"overall AS ({overall})")


def categorical(src: str, columns, keys=(), by: str = "category") -> str:
    k = "".join(f"{x}, " for x in keys)
    counts = " UNION ALL ".join(
        f"SELECT {k}'{c}' AS variable, CAST({c} AS VARCHAR) AS level, {label} AS \"group\", count(*) AS n FROM {src} GROUP BY ALL"
        for c in columns for label in (f"CAST({by} AS VARCHAR)", "'Overall'"))
    return f"""SELECT *, CASE WHEN level IS NOT NULL THEN CAST(100 AS DOUBLE) * n / sum(n) FILTER (WHERE level IS NOT NULL) OVER (PARTITION BY {k}variable, "group") END AS pct
FROM ({counts})"""


def report(src: str, keys=(), clamp: str = "false", shares: str | None = None) -> str:
    """The ten rows, one SELECT per row and category."""
    k = "".join(f"{x}, " for x in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    rows = []
    for order, label, measure, _ in REPORT_ROWS:
        head = f"SELECT {k}{order} AS row_order, {q(label)} AS row_label, "
        if measure is None:
            rows.append(f"{head}CAST(count(*) AS DOUBLE) AS Detractor, NULL::DOUBLE AS Passive, NULL::DOUBLE AS Promoter FROM {src} {by}")
            continue
        cells = []
        for c in CATEGORIES:
            if measure == "churn":
                of = f"CAST(100 AS DOUBLE) * count(*) FILTER (WHERE churned = '{R.CHURNED}' AND category = '{c}') / nullif(count(*) FILTER (WHERE category = '{c}'), 0)"
            elif measure in MEANS:
                of = f"CAST(sum({measure}) FILTER (WHERE category = '{c}') AS DOUBLE) / nullif(count({measure}) FILTER (WHERE category = '{c}'), 0)"
            elif shares:
                of = f"CASE WHEN count(*) FILTER (WHERE category = '{c}') > 0 THEN (SELECT {measure} FROM {shares} s WHERE s.category = '{c}') END"
            else:
                num, den = (f"CAST(COALESCE(sum({x}) FILTER (WHERE category = '{c}'), 0) AS DOUBLE)" for x in SHARES[measure])
                ratio = f"CAST(100 AS DOUBLE) * {num} / CASE WHEN {clamp} THEN GREATEST({den}, 1e-10::DOUBLE) WHEN {den} <> 0 THEN {den} ELSE 1e-10::DOUBLE END"
                of = f"CASE WHEN count(*) FILTER (WHERE category = '{c}') > 0 THEN {ratio} END"
            cells.append(f"{of} AS {c}")
        rows.append(head + ", ".join(cells) + f" FROM {src} {by}")
    return "\nUNION ALL ".join(rows)


def text_report() -> str:
    cells = []
    for c in CATEGORIES:
        number = f"printf('%.1f', {c})"
        cells.append(f"CASE kind WHEN 'n' THEN COALESCE(CAST(CAST({c} AS BIGINT) AS VARCHAR), '') WHEN 'money' THEN '$' || {number} ELSE {number} || ' %' END AS {c}")
    kinds = values("kinds", "row_order, kind", [(r[0], r[3]) for r in REPORT_ROWS])
    return query(f"SELECT row_order, row_label, {', '.join(cells)} FROM rep JOIN kinds USING (row_order)", kinds, f"rep AS ({report('base')})")


_DIAGNOSTICS = """SELECT b.category, count(*) AS available, count(s.party_id) AS sampled, CAST(100 AS DOUBLE) * count(s.party_id) / count(*) AS sampled_pct
FROM banded b LEFT JOIN sample s ON s.party_id = b.party_id GROUP BY b.category"""


def share_rows(src: str, clamp: str = "false") -> str:
    return f"SELECT category, {', '.join(f'{share_sql(s, clamp)} AS {s}' for s in SHARES)} FROM {src} GROUP BY category"


def frames(strata) -> tuple[str, ...]:
    return (members("banded"), sample_of("members", strata, by=["cohort"], seed="seed"),
            "frames AS (SELECT 'raw' AS variant, * FROM members UNION ALL SELECT 'balanced' AS variant, * FROM sample)")


_BALANCED = "variant = 'balanced'"
_COHORT_CUTS = """places AS (SELECT cohort, cust_value AS v, row_number() OVER (PARTITION BY cohort ORDER BY cust_value) - 1 AS r, count(*) OVER (PARTITION BY cohort) AS n FROM members),
cohort_cuts AS (SELECT cohort, i, v FROM places JOIN range(0, 11) AS t(i) ON r = (n - 1) * i // 10),
cohort_bands AS (SELECT m.*, CAST(1 + (SELECT count(*) FROM cohort_cuts c WHERE c.cohort = m.cohort AND i BETWEEN 1 AND 9 AND m.cust_value > c.v) AS INTEGER) AS band FROM members m)"""
# the interpolated cut points come from DuckDB's own continuous quantile
_CUT_POINTS = ("cut_points AS (SELECT cohort, i, round(quantile_cont(cust_value, [x / 10.0 for x in range(0, 11)])[i + 1], 3) - CASE WHEN i = 0 THEN 0.001 ELSE 0 END AS cut "
               "FROM members, range(0, 11) AS t(i) GROUP BY cohort, i)")


def crosstab(src: str, scope: str) -> str:
    """Levels of both sides with their totals, each pair counted."""
    side = lambda c, t: f"(SELECT DISTINCT {c} AS level, false AS total FROM {src} UNION ALL SELECT 'Total', true) {t}"
    return f"""SELECT '{scope}' AS scope, r.level AS own_rev_y1_cat, c.level AS own_rev_y2_cat, r.total AS row_total, c.total AS col_total,
  (SELECT count(*) FROM {src} x WHERE (r.total OR x.own_rev_y1_cat = r.level) AND (c.total OR x.own_rev_y2_cat = c.level)) AS n
FROM {side('own_rev_y1_cat', 'r')}, {side('own_rev_y2_cat', 'c')}"""


DECIMALS = {"own_rev_y2", "other_spend", "national_spend", "budget_spend", "foreign_spend", "total_spend_y2", "own_rev_y1", "total_spend_y1", "flight_rev_y2",
            "flight_revenue_y2", "flight_rev_y1", "flight_revenue_y1", "flight_rev_displacement", "own_rev_diff", "total_spend_diff",
            "flight_revenue_y1_raw", "flight_revenue_y2_raw"}


def pick(columns, src: str = "population", digits: dict | None = None) -> str:
    def one(c: str) -> str:
        if c in (digits or {}):
            return f"round({c}, {digits[c]}) AS {c}"
        return f"CAST({c} AS DOUBLE) AS {c}" if c in DECIMALS else c

    return query(f"SELECT {', '.join(map(one, columns.split()))} FROM {src}")


_ALL = " ".join(["party_id survey_dt category delay_cat delay_mins disruption_ind transactor_stage tenure generation transactor_stage_label",
                 "own_rev_y2 total_spend_y2 other_spend national_spend budget_spend foreign_spend own_share_pct customer_group match_ind own_rev_ind other_spend_ind",
                 "national_ind budget_ind foreign_ind national_merchants budget_merchants foreign_merchants total_spend_band own_share_band total_spend_tier",
                 "own_share_tier own_rev_y1 total_spend_y1 flight_rev_y1 flight_revenue_y1 total_revenue_y1 flight_value_y1 currency_rev_y1 cust_type member_ind",
                 "tier_code no_of_trips channel_type cust_tenure cust_value currency_value intent rpm flight_rev_displacement home_location stage tier",
                 "travel_frequency flight_rev_y2 flight_revenue_y2 total_revenue_y2 flight_value_y2 currency_rev_y2 age_band"])
_REF, _SEG = sample_of("banded", REF_STRATA), sample_of("banded", SEGMENT_STRATA)
_SIX = {"own_share_pct": 6, "own_rev_log": 6, "total_spend_log": 6}



def comparison() -> str:
    """Welch's F from averages and variances, chi-square from observed and expected counts of every cell."""
    moments = " UNION ALL ".join(f"SELECT cohort, '{m}' AS variable, category, count({m}) AS n, avg(CAST({m} AS DOUBLE)) AS mean, var_samp(CAST({m} AS DOUBLE)) AS v "
                                 f"FROM members GROUP BY cohort, category" for m in MEANS)
    cells = " UNION ALL ".join(f"SELECT cohort, '{c}' AS variable, {c} AS level, category, count(*) AS n FROM members GROUP BY ALL" for c in CATEGORICAL)
    return query("""SELECT cohort, variable, round(f, 6) AS statistic, k - 1 AS df1, round(CASE WHEN f IS NOT NULL THEN (k * k - 1) / (3 * part) END, 6) AS df2 FROM welch
UNION ALL SELECT cohort, variable, round(sum((n - e) * (n - e) / e), 6), (count(DISTINCT level) - 1) * (count(DISTINCT category) - 1), NULL FROM expected GROUP BY cohort, variable""",
                 members("base"), f"moments AS ({moments})", "weights AS (SELECT *, CASE WHEN v > 0 THEN n / v END AS w FROM moments)",
                 "centred AS (SELECT *, sum(w) OVER o AS sw, sum(w * mean) OVER o / sum(w) OVER o AS centre, count(*) OVER o AS k FROM weights WINDOW o AS (PARTITION BY cohort, variable))",
                 "parts AS (SELECT cohort, variable, max(k) AS k, sum(w * (mean - centre) ** 2) / (max(k) - 1) AS a, sum((1 - w / sw) ** 2 / (n - 1)) AS part FROM centred GROUP BY ALL)",
                 "welch AS (SELECT *, a / (1 + 2 * (k - 2) * part / (k * k - 1)) AS f FROM parts)", f"cells AS ({cells})",
                 "every AS (SELECT * FROM (SELECT DISTINCT cohort, variable, level FROM cells) JOIN (SELECT DISTINCT cohort, variable, category FROM cells) USING (cohort, variable))",
                 "full_cells AS (SELECT e.*, coalesce(c.n, 0) AS n FROM every e LEFT JOIN cells c USING (cohort, variable, level, category))",
                 "expected AS (SELECT *, CAST(sum(n) OVER (PARTITION BY cohort, variable, level) AS DOUBLE) * sum(n) OVER (PARTITION BY cohort, variable, category) "
                 "/ sum(n) OVER (PARTITION BY cohort, variable) AS e FROM full_cells)")


def differences() -> str:
    parts = []
    for variant, src in (("raw", "banded"), ("balanced", "sample")):
        for m in MEANS:
            of = lambda f, c, m=m: f"{f}(CAST({m} AS DOUBLE)) FILTER (WHERE category = '{c}')"
            parts.append(f"SELECT '{variant}' AS variant, '{m}' AS variable, round(({of('avg', 'Detractor')} - {of('avg', 'Promoter')}) "
                         f"/ nullif(sqrt(({of('var_samp', 'Detractor')} + {of('var_samp', 'Promoter')}) / 2), 0), 6) AS difference FROM {src}")
    return query("\nUNION ALL ".join(parts), _SEG)


def contract_rows() -> str:
    """Nulls of every declared column, rows outside bounds and allowed values, repeated keys: counted relation by relation."""
    sources = {"survey": ("relation_survey", "survey_id"), "spend_y2": ("relation_spend_y2", "party_id"), "spend_y1": ("relation_spend_y1", "party_id"),
               "cust_y1": ("relation_cust_y1", "party_id"), "cust_y2": ("relation_cust_y2", "party_id"), "individual": ("relation_individual", "party_id")}
    limits = {("survey", "category"): 0.05, ("cust_y1", "cust_value"): 0.1}
    never = {"survey": ["party_id", "survey_id", "survey_dt"], "spend_y2": ["party_id", "own_rev", "total_spend"], "spend_y1": ["party_id", "own_rev", "total_spend"],
             "cust_y1": ["party_id", "ticket_rev"], "cust_y2": ["party_id", "ticket_rev"], "individual": ["party_id", "birth_year"]}
    rules = [("spend_y2", "own_share_pct", "least", "own_share_pct < 0"), ("cust_y1", "no_of_trips", "least", "no_of_trips < 1"),
             ("individual", "birth_year", "least", "birth_year < 1900"), ("cust_y1", "member_ind", "allowed", "member_ind NOT IN ('Y', 'N')"),
             *[("spend_y2", c, "allowed", f"{c} NOT IN ('Y', 'N')") for c in ("match_ind", "own_rev_ind", "other_spend_ind")]]
    rows = []
    for name, (src, key) in sources.items():
        head = f"SELECT '{name}' AS relation, "
        for c, _ in SCHEMAS[name]:
            share = 0.0 if c in never[name] else limits.get((name, c), 1.0)
            rows.append(f"{head}'{c}' AS \"column\", 'nulls' AS rule, count(*) - count({c}) AS observed, count(*) AS n_rows, CAST(floor(CAST({share} AS DOUBLE) * count(*)) AS BIGINT) AS bound FROM {src}")
            rows.append(f"{head}'{c}', 'type', CAST(0 AS BIGINT), count(*), CAST(0 AS BIGINT) FROM {src}")
        rows += [f"{head}'{c}', '{rule}', count(*) FILTER (WHERE {bad}), count(*), CAST(0 AS BIGINT) FROM {src}" for r, c, rule, bad in rules if r == name]
        rows.append(f"{head}'{key}', 'unique', count({key}) - count(DISTINCT {key}), count({key}), CAST(0 AS BIGINT) FROM {src}")
    return "SELECT *, observed <= bound AS passed FROM (" + "\nUNION ALL ".join(rows) + ")"


def _yearly(year: int) -> str:
    return (f"SELECT o_custkey AS party_id, ticket AS ticket_rev, non_award AS ticket_rev_non_award, ancillary AS ancillary_rev, displacement, flight_value, "
            f"currency_value, rpm, trips AS no_of_trips FROM years WHERE yr = {year}")


_RELATIONS = (
    """relation_survey AS (SELECT *, CASE WHEN delay_mins >= 60 THEN 'long' WHEN delay_mins >= 1 THEN 'short' WHEN delay_mins IS NOT NULL THEN 'none' END AS delay_cat,
  CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS disruption_ind, CAST(party_id % 4 AS VARCHAR) AS transactor_stage,
  CASE WHEN party_id % 7 <> 0 THEN CAST(party_id % 3 AS VARCHAR) END AS tenure, CASE WHEN party_id % 13 <> 0 THEN 'G' || (party_id % 5) END AS generation FROM responses)""",
    "relation_spend_y2 AS (SELECT *, own_rev_y2 AS own_rev, total_spend_y2 AS total_spend FROM second_spend)",
    "relation_spend_y1 AS (SELECT party_id, own_rev_y1 AS own_rev, total_spend_y1 AS total_spend FROM first_spend)",
    f"""relation_cust_y1 AS (SELECT y.*, p.* EXCLUDE (party_id), h.airport AS home_airport, h.country AS home_country, latest.o_orderstatus AS intent
  FROM ({_yearly(1)}) y JOIN person p USING (party_id) JOIN customer c ON c.c_custkey = y.party_id LEFT JOIN home h ON h.n_nationkey = c.c_nationkey
  LEFT JOIN latest ON latest.party_id = y.party_id)""",
    f"relation_cust_y2 AS ({_yearly(2)})",
    "relation_individual AS (SELECT c_custkey AS party_id, 1920 + c_custkey % 110 AS birth_year FROM customer)",
)
_LEDGER_STEPS = [("in_window", f"SELECT count(*) FROM responses WHERE survey_dt BETWEEN {d(B.survey_start)} AND {d(B.survey_end)}"),
                 ("with_person", "SELECT count(*) FROM in_window"), ("people", "SELECT count(*) FROM latest"),
                 *[(f"in_{r}", f"SELECT count(*) FROM latest SEMI JOIN {src} USING (party_id)") for r, src in
                   (("spend_y2", "second_spend"), ("spend_y1", "first_spend"), ("cust_y1", "first_value"), ("cust_y2", "second_value"), ("individual", "ages"))],
                 ("with_category", "SELECT count(*) FROM people"), ("without_first_year", "SELECT count(*) FROM people WHERE own_rev_y1 IS NULL"),
                 ("without_customer_value", "SELECT count(*) FROM people WHERE own_rev_y1 IS NOT NULL AND cust_value IS NULL"), ("base", "SELECT count(*) FROM kept")]

ORACLE_SQL: dict[str, str] = {
    "latest_survey": query("SELECT party_id, survey_id, survey_dt, category, transactor_stage, tenure FROM latest"),
    "population_joined": pick(_ALL, digits={"own_share_pct": 6}),
    "revenue_rollups": pick("party_id flight_rev_y1 flight_rev_y2 flight_revenue_y1 flight_revenue_y2 total_revenue_y1 total_revenue_y2 currency_rev_y1 currency_rev_y2 "
                            "rpm flight_rev_displacement"),
    "recode_stage": pick("party_id transactor_stage transactor_stage_label cust_type stage"),
    "recode_location": pick("party_id home_location"),
    "recode_tier": pick("party_id member_ind tier_code tier"),
    "age_band": pick("party_id age_band"),
    "travel_frequency": pick("party_id rpm no_of_trips travel_frequency"),
    "match_flag": pick("party_id match_flag", "people"),
    "log_spend": pick("party_id own_rev_log total_spend_log", "people", {"own_rev_log": 9, "total_spend_log": 9}),
    "sign_category": pick("party_id own_rev_y2_cat own_rev_y1_cat", "people"),
    "churn_and_yoy": pick("party_id category zero_flag own_rev_y2 own_rev_y2_cat2 churned own_rev_diff total_spend_diff flight_revenue_y1_raw flight_revenue_y1", "base"),
    "filled_base": pick(" ".join(["party_id", *FILL_ZERO, "flight_revenue_y1_raw flight_revenue_y2_raw"]), "base", _SIX),
    "spend_share_signed": query(share_rows("kept")),
    "spend_share_clamped": query(share_rows("kept", "true")),
    "crosstab_margins": query(crosstab("people", "population") + "\nUNION ALL " + crosstab("kept", "base")),
    "match_rate_by_segment": query(" UNION ALL ".join(
        f"SELECT '{c}' AS segment, CAST({c} AS VARCHAR) AS level, count(*) AS n, CAST(sum(match_flag) AS BIGINT) AS matched, CAST(sum(match_flag) AS DOUBLE) / count(*) AS match_rate "
        f"FROM people GROUP BY {c}" for c in SEGMENTS)),
    "coverage_profile": query(" UNION ALL ".join(f"SELECT *, '{by}' AS by_var FROM ({categorical('people', COVERAGE, by=by)})" for by in ("match_flag", "category"))),
    "value_band": query("SELECT party_id, cust_value, value_band FROM banded"),
    "value_band_edges": query("SELECT b.cohort, b.band, lo.v AS lo, hi.v AS hi, count(*) AS n FROM cohort_bands b JOIN cohort_cuts lo ON lo.cohort = b.cohort AND lo.i = b.band - 1 "
                              "JOIN cohort_cuts hi ON hi.cohort = b.cohort AND hi.i = b.band GROUP BY ALL", members("base"), _COHORT_CUTS),
    "value_band_intervals": query("SELECT b.cohort, b.band, round(lo.cut, 3) AS lo, hi.cut AS hi, '(' || round(lo.cut, 3) || ', ' || hi.cut || ']' AS label, count(*) AS n "
                                  "FROM cohort_bands b JOIN cut_points lo ON lo.cohort = b.cohort AND lo.i = b.band - 1 "
                                  "JOIN cut_points hi ON hi.cohort = b.cohort AND hi.i = b.band GROUP BY ALL", members("base"), _COHORT_CUTS, _CUT_POINTS),
    "cohort_band_profile": query(f"SELECT * FROM ({categorical('renamed', ['value_band_cohort'], keys=['cohort'])})", members("base"), _COHORT_CUTS,
                                 "renamed AS (SELECT *, band AS value_band_cohort FROM cohort_bands)"),
    "stratum_shares": query("SELECT *, round(CASE WHEN sum(least_share) OVER () > 0 THEN least_share / sum(least_share) OVER () END, 9) AS least_share_norm FROM strata_shares",
                            shares_of("banded", REF_STRATA)),
    "balance_quota": query("SELECT * FROM quotas", shares_of("banded", REF_STRATA), quotas_of(REF_STRATA)),
    "balance_quota_exact": query("SELECT * FROM quotas", shares_of("banded", SEGMENT_STRATA), quotas_of(SEGMENT_STRATA, exact=True)),
    "balanced_sample": query(f"SELECT party_id, category, {', '.join(REF_STRATA)} FROM sample", _REF),
    "balanced_sample_by_segment": query(f"SELECT party_id, category, {', '.join(SEGMENT_STRATA)} FROM sample", _SEG),
    "balance_diagnostics": query(_DIAGNOSTICS, _REF),
    "balance_diagnostics_by_segment": query(_DIAGNOSTICS, _SEG),
    "spend_share_balanced": query(share_rows("sample", "true"), _REF),
    "spend_share_balanced_by_segment": query(share_rows("sample", "true"), _SEG),
    "group_summary_continuous": query(continuous("base")),
    "group_summary_parity": parity(),
    "group_summary_categorical": query(categorical("base", CATEGORICAL)),
    "cohort_summary": query(continuous("frames", ["cohort", "variant"], _BALANCED), *frames(SEGMENT_STRATA)),
    "cohort_summary_categorical": query(categorical("frames", CATEGORICAL, ["cohort", "variant"]), *frames(SEGMENT_STRATA)),
    "outcome_report": query(report("base")),
    "outcome_report_text": text_report(),
    "cohort_grid": query(report("frames", ["cohort", "variant"], _BALANCED), *frames(REF_STRATA)),
    "cohort_grid_by_segment": query(report("frames", ["cohort", "variant"], _BALANCED), *frames(SEGMENT_STRATA)),
    "outcome_report_from_cube": query(report("members", ["cohort"]), members("base")),
    "cohort_summary_from_cube": query(continuous("members", ["cohort"]), members("base")),
    "latest_survey_incremental": query("SELECT party_id, survey_id, survey_dt, category, transactor_stage, tenure FROM latest"),
    "stamped_report": query(f"SELECT *, strftime(TIMESTAMP '2000-07-01 03:30:00' - INTERVAL 5 HOUR, '%Y_%m_%d') AS run_day FROM ({report('base')})"),
    "population_head": query("SELECT party_id, category, tier, age_band, CAST(own_rev_y1 AS DOUBLE) AS own_rev_y1, CAST(own_rev_y2 AS DOUBLE) AS own_rev_y2, "
                             "cust_value FROM population ORDER BY party_id LIMIT 5"),
    "group_comparison": comparison(),
    "balance_differences": differences(),
    "pull_ledger": query("\nUNION ALL ".join(f"SELECT {i} AS step_no, '{step}' AS step, ({sql}) AS n_rows" for i, (step, sql) in enumerate(_LEDGER_STEPS))),
    "contract_report": query(contract_rows(), *_RELATIONS),
    "report_store": query(report("base")),
    "population_from_store": pick(_ALL, digits={"own_share_pct": 6}),
    "cohort_grid_base_share": query(report("members", ["cohort"], shares="whole"), members("base"), f"whole AS ({share_rows('base')})"),
}
