"""Date columns: dates are ISO strings in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def year_of(date: Column) -> Column:
    """Year of an ISO string, null unless it starts with four digits."""
    return F.when(date.rlike("^[0-9]{4}"), F.substring(date, 1, 4).cast("int"))


def month_of(date: Column) -> Column:
    """YYYY-MM, null for what is no date."""
    return F.date_format(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")), "yyyy-MM")


def month_index(month: Column) -> Column:
    """Months since year 0, so that neighbours differ by one."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def calendar(rows: DataFrame, date: str = "date") -> DataFrame:
    """(month) for every month from the first to the last dated row, without holes."""
    d = F.to_date(F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd")))
    ends = rows.agg(F.trunc(F.min(d), "month").alias("a"), F.trunc(F.max(d), "month").alias("b"))
    months = ends.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return months.select(F.date_format("m", "yyyy-MM").alias("month"))


def long_date(date: Column) -> Column:
    return F.date_format(F.to_date(date), "d MMMM yyyy")


def empty_calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "month string")
