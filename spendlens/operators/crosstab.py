"""Crosstab with margins, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators.attach import attach

TOTAL = "Total"


def crosstab_margins(df: DataFrame, row: str, col: str, keys: Sequence[str] = (), total: str = TOTAL) -> DataFrame:
    """Counts of (row, col) per ``keys``, with totals of rows, columns and all.

    Rows with a null level are left out.  Every row level meets every column
    level, with 0 where no row has both.  ``row_total`` and ``col_total`` tell the
    margins from a level that happens to be called ``total``.  The data is
    aggregated once; the grid is made from the few counts.
    """
    keys = list(keys)
    cells = (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
             .groupBy(*keys, F.col(row).cast("string").alias("r"), F.col(col).cast("string").alias("c"))
             .agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0)))
    place = [*keys, "_all"]
    # the levels are a handful: a list per key is bounded by their number
    levels = cells.groupBy(*place).agg(F.collect_set("r").alias("rs"), F.collect_set("c").alias("cs"))
    side = lambda xs: F.concat(F.transform(xs, lambda x: F.struct(x.alias("level"), F.lit(False).alias("total"))),
                               F.array(F.struct(F.lit(total).alias("level"), F.lit(True).alias("total"))))
    grid = (levels.withColumn("x", F.explode(side(F.col("rs")))).withColumn("y", F.explode(side(F.col("cs"))))
            .select(*place, F.col("x.level").alias("r"), F.col("x.total").alias("row_total"),
                    F.col("y.level").alias("c"), F.col("y.total").alias("col_total")))
    sums = cells.groupingSets([[*place, "r", "c"], [*place, "r"], [*place, "c"], place], *place, "r", "c").agg(
        F.sum("n").alias("n"), F.grouping("r").alias("gr"), F.grouping("c").alias("gc"))
    sums = sums.select(*place, F.when(F.col("gr") == 1, total).otherwise(F.col("r")).alias("r"), (F.col("gr") == 1).alias("row_total"),
                       F.when(F.col("gc") == 1, total).otherwise(F.col("c")).alias("c"), (F.col("gc") == 1).alias("col_total"), "n")
    out = attach(grid, sums, [*place, "r", "row_total", "c", "col_total"], how="left")
    return out.select(*keys, F.col("r").alias(row), F.col("c").alias(col), "row_total", "col_total",
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"))
