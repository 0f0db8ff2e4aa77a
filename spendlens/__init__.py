"""spendlens — cohort spend analytics on Spark.

Compares survey groups (Detractor / Passive / Promoter) by what they spend:
keep each person's latest survey, join yearly spend and customer-value
tables, derive churn, year-on-year change and share of spend, and report
them by category, raw and after exact-size stratified balancing.

Layout:
  sources/    bind input tables to the six relations; sinks
  functions/  column expressions (recodes, sign category, guarded maths)
  operators/  latest-per-key, ratio of sums, crosstab, quantile bands,
              balancing, long-form summaries
  plans/      population pull, derivations, cohort grid, outcome report,
              the named query registry
"""

__version__ = "0.1.0"
