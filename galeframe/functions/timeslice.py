"""Calendar expressions: years, months and the slices of a year that corrections are learned for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESOLUTIONS = ("fixed", "season", "bimonth", "month")


def slice_of(month: Column, resolution: str) -> Column:
    """The label of a month's slice: 1/1, a season, 1/6 to 6/6, or the month itself.

    Winter is December, January and February of the same calendar year.
    """
    if resolution == "fixed":
        return F.when(month.isNotNull(), F.lit("1/1"))
    if resolution == "season":
        return (
            F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
            .when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "autumn")
        )
    if resolution == "bimonth":
        return F.concat(F.ceil(month / 2).cast("string"), F.lit("/6"))
    if resolution == "month":
        return month.cast("string")
    raise ValueError(f"unknown time resolution: {resolution}")


def with_times(df: DataFrame, time: str = "time") -> DataFrame:
    """df with year and month of its time column."""
    return df.withColumns({"year": F.year(time), "month": F.month(time)})


def with_slices(df: DataFrame) -> DataFrame:
    """df, which has month, with a column for each resolution."""
    return df.withColumns({r: slice_of(F.col("month"), r) for r in ("bimonth", "season", "fixed")})


def dimension(spark: SparkSession) -> DataFrame:
    """(time_res, month, time_slice): the slices of all resolutions, 48 rows."""
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    parts = [months.select(F.lit(r).alias("time_res"), "month", slice_of(F.col("month"), r).alias("time_slice")) for r in RESOLUTIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hours_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1)))) * 24


def months_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(month_start) of every month from first to last, both dates in ISO form."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("month_start"))
