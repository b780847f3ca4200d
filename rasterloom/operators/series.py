"""Time series as tables: (keys, date, value) with one row for a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly(rows: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """The mean of each month, dated on its first day; nulls are skipped."""
    return rows.groupBy(*keys, F.trunc(date, "month").alias("date")).agg(F.avg(value).alias(value))


def with_gaps(series: DataFrame, keys: list[str], value: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A monthly series with a row for every month, null where there was none: between two dates, or else between each
    series' own first and last month. Each series is joined with its own calendar only."""
    first, last = (F.lit(d).cast("date") if d else f("date") for d, f in ((start, F.min), (end, F.max)))
    ends = series.groupBy(*keys).agg(first.alias("_first"), last.alias("_last"))
    months = F.sequence(F.trunc("_first", "month"), F.trunc(F.greatest("_first", "_last"), "month"), F.expr("interval 1 month"))
    spine = ends.select(*keys, "_last", F.explode(months).alias("date")).filter(F.col("date") <= F.col("_last")).drop("_last")
    return spine.join(series.select(*keys, "date", value), [*keys, "date"], "left")


def rolling_mean(series: DataFrame, keys: list[str], value: str, days: int, name: str = "rolling") -> DataFrame:
    """The mean of the last so many days up to each date, that included: a frame by date, not by rows, so gaps don't widen it."""
    day = F.unix_date("date")
    frame = Window.partitionBy(*keys).orderBy(day).rangeBetween(1 - days, 0)
    return series.withColumn(name, F.avg(value).over(frame))


def anomaly(series: DataFrame, keys: list[str], value: str, name: str = "anomaly") -> DataFrame:
    """How far each value is from the mean of the same month in all other years; null where there is no other."""
    month = F.month("date").alias("_month")
    sums = series.groupBy(*keys, month).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))  # twelve rows a series
    wide = series.withColumn("_month", F.month("date")).join(sums, [*keys, "_month"], "left")
    others = F.try_divide(F.col("_sum") - F.col(value), F.col("_n") - 1)
    return wide.withColumn(name, F.col(value) - others).drop("_month", "_sum", "_n")
