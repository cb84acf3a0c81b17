"""Projections, filters and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions.scalars import number

#: (lon_min, lon_max, lat_min, lat_max) of each country.
BOXES = {
    line.split()[0]: tuple(map(float, line.split()[1:]))
    for line in ("BE 2.2 6.6 49.3 51.8", "DE 5 16 47 55.2", "DK 7.5 13.5 54 58.2", "FR -6 10.5 41 51.5", "NL 2.5 7.5 50.5 53.8", "NO 4 31.5 57.5 71.5", "UK -11 3 49 61")
}


def require(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has these columns; ValueError if not."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def numeric(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns as doubles, null where they hold no finite number."""
    return df.withColumns({n: number(F.col(n)) for n in names if n in df.columns})


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapping's columns alone, under their new names."""
    return require(df, *mapping).select(*(F.col(f"`{a}`").alias(b) for a, b in mapping.items()))


def pick(df: DataFrame, *candidates: str, default: str | None = None) -> Column:
    """The first candidate that df has, or a null of the default type's string."""
    for c in candidates:
        if c in df.columns:
            return F.col(f"`{c}`")
    return F.lit(default).cast("string")


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """df with the schema's columns alone, in its order; those that df lacks are null."""
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in schema.items()))


def in_box(df: DataFrame, box: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows in (lon_min, lon_max, lat_min, lat_max), bounds included; the filter reaches the scan."""
    return df.where(F.col(lon).between(box[0], box[1]) & F.col(lat).between(box[2], box[3]))


def finite_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return numeric(require(df, lon, lat), lon, lat).where(F.col(lon).isNotNull() & F.col(lat).isNotNull())


def complete_years(df: DataFrame, entity: str = "ID", year: str = "year") -> DataFrame:
    """Rows of the entities with one row for each year between the least and the greatest of the table."""
    span = df.agg((F.max(year) - F.min(year) + 1).alias("_span"))
    counted = df.withColumn("_rows", F.count("*").over(Window.partitionBy(entity)))
    return counted.crossJoin(F.broadcast(span)).where(F.col("_rows") == F.col("_span")).drop("_rows", "_span")


def month_names(prefix: str = "obs_") -> list[str]:
    return [f"{prefix}{m}" for m in range(1, 13)]


def row_mean(names: list[str]) -> Column:
    """The mean of the columns that are not null; null if all are."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(n), F.lit(0.0)) for n in names))
    count = reduce(lambda a, b: a + b, (F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names))
    return F.when(count > 0, total / count)


def clean_observations(df: DataFrame, train: bool = False, country: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Turbine-years of monthly capacity factors, in this order: without those that exceed 1 in a month; for DK when training,
    without those at 0.01 or less in a month; zeros as nulls; without those whose mean is at most 0.01. A null mean stays.
    """
    cols = names or month_names()
    out = df.where(F.coalesce(F.greatest(*cols) <= 1, F.lit(True)))
    if train and country == "DK":
        out = out.where(F.coalesce(F.least(*cols) > 0.01, F.lit(True)))
    out = out.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in cols})
    return out.where(F.coalesce(row_mean(cols) > 0.01, F.lit(True)))


def melt_months(df: DataFrame, value: str = "obs", prefix: str = "obs_") -> DataFrame:
    """Long rows (ID, year, month, value) of a table with a column for each month; nulls stay."""
    cols = month_names(prefix)
    long = df.unpivot(["ID", "year"], cols, "_m", value)
    return long.select("ID", "year", F.replace("_m", F.lit(prefix), F.lit("")).cast("int").alias("month"), value)


def pivot_months(df: DataFrame, value: str = "obs", prefix: str = "obs_") -> DataFrame:
    """A column for each month, by (ID, year)."""
    wide = df.groupBy("ID", "year").pivot("month", list(range(1, 13))).agg(F.first(value, ignorenulls=True))
    return wide.select("ID", "year", *(F.col(str(m)).alias(f"{prefix}{m}") for m in range(1, 13)))


def remove_share(df: DataFrame, share: float, keys: list[str], value: str = "obs", seed: int = 42) -> DataFrame:
    """df with that share of its rows' values set to null, chosen by a hash of the keys, so the same rows each time.

    A row is chosen where its hash is under the share of the hash's range: no sort over the whole table is needed, and the share holds up to chance.
    """
    place = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.withColumn(value, F.when(place >= share, F.col(value)))


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must break ties."""
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", spot).where("_nth = 1").drop("_nth")


def rows_between(df: DataFrame, order: list[Column], first: int, last: int) -> DataFrame:
    """The rows from first up to, not including, last, counted from 0 in the given order, which must break ties."""
    return df.orderBy(*order).offset(first).limit(max(0, last - first))


def transposed(df: DataFrame, key: str, names: list[str], out: str = "name") -> DataFrame:
    """A row for each other column of df and a column for each of the names, which are values of the key; all values are doubles."""
    others = [c for c in df.columns if c != key]
    long = df.select(key, *(F.col(f"`{c}`").cast("double").alias(c) for c in others)).unpivot([key], others, out, "_value")
    return long.groupBy(out).pivot(key, names).agg(F.first("_value", ignorenulls=True))


def overlay(base: Column, top: Column, default: float | None = None) -> Column:
    """top where it has a value, else base, else the default."""
    return F.coalesce(top, base, F.lit(default).cast("double"))
