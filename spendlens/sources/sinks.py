"""Report sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Write a pivoted report (a few dozen rows per cohort) as one file per partition value.

    The report's rows are moved to one task after they have been computed;
    the stages before keep their parallelism.
    """
    writer = report.repartition(1).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def run_stamp(run: dt.datetime | None = None, tz: str = "America/Chicago") -> Column:
    """The day in a time zone as 'yyyy_MM_dd', for report file names.

    ``run``: a UTC time given by the caller; else the current one.  The day does
    not depend on the session's time zone.
    """
    if run is not None:
        utc = F.lit(run.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
        return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc), "yyyy_MM_dd")
    now = F.current_timestamp().cast("timestamp_ntz")
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(tz), now), "yyyy_MM_dd")
