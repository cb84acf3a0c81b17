"""Error metrics of simulated against observed capacity factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions.scalars import haversine_km

MODES = ("temporal-focus", "spatial-focus", "total", "monthly-error", "regional-error", "turbine-error", "cluster-error")


def merged(sim: DataFrame, obs: DataFrame, turbines: DataFrame, *attributes: str) -> DataFrame:
    """(ID, month, year, cf_sim, cf_obs, capacity, ...) of the months that have both values and a capacity.

    sim: (time, ID, cf) or monthly (ID, year, month, cf); obs: (ID, year, month, obs).
    """
    if "time" in sim.columns:
        sim = sim.groupBy("ID", F.year("time").alias("year"), F.month("time").alias("month")).agg(F.avg("cf").alias("cf"))
    both = sim.select("ID", "year", "month", F.col("cf").alias("cf_sim")).join(obs.select("ID", "year", "month", F.col("obs").alias("cf_obs")), ["ID", "year", "month"])
    return both.join(turbines.select("ID", "capacity", *attributes), "ID").dropna(subset=["cf_sim", "cf_obs", "capacity"])


def _mean(value: str):
    return F.sum(F.col(value) * F.col("capacity")) / F.sum("capacity")


def error(mode: str, table: DataFrame, flag: str = "in_training", region: str = "region", cluster: str = "cluster", by: tuple[str, ...] = ()) -> DataFrame:
    """The errors of a merged() table in one of the MODES; by: columns of runs that are scored side by side.

    temporal-focus, spatial-focus and total give (rmse, mae, mbe). monthly-error and regional-error give rows by flag and, as Both, over the
    flags; regional-error's rows by flag are absolute percentages, its Both rows signed differences.
    """
    k = list(by)
    diff = F.col("cf_sim") - F.col("cf_obs")
    if mode == "temporal-focus":
        months = table.groupBy(*k, "month").agg(_mean("cf_sim").alias("cf_sim"), _mean("cf_obs").alias("cf_obs")).withColumn("d", diff)
        return months.groupBy(*k).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg(F.abs("d")).alias("mae"), F.avg("d").alias("mbe"))
    if mode in ("spatial-focus", "total"):
        if mode == "total":
            rows = table.withColumn("d", diff).withColumns({"s": F.col("d") * F.col("d"), "a": F.abs("d")})
            each = rows.groupBy(*k, "ID").agg(F.avg("d").alias("d"), F.avg("s").alias("s"), F.avg("a").alias("a"), F.avg("capacity").alias("capacity"))
        else:
            each = table.groupBy(*k, "ID").agg(F.avg("cf_sim").alias("cf_sim"), F.avg("cf_obs").alias("cf_obs"), F.avg("capacity").alias("capacity")).withColumn("d", diff)
            each = each.withColumns({"s": F.col("d") * F.col("d"), "a": F.abs("d")})
        return each.groupBy(*k).agg(F.sqrt(_mean("s")).alias("rmse"), _mean("a").alias("mae"), _mean("d").alias("mbe"))
    if mode == "monthly-error":
        sets = table.groupingSets([[*map(F.col, k), F.col("month"), F.col(flag)], [*map(F.col, k), F.col("month")]], *k, "month", flag)
        out = sets.agg(_mean("cf_sim").alias("cf_sim"), _mean("cf_obs").alias("cf_obs"), F.count("ID").alias("n"), F.grouping(flag).alias("g"))
        return out.select(*k, "month", F.when(F.col("g") == 1, "Both").otherwise(F.col(flag).cast("string")).alias(flag), diff.alias("diff"), "n")
    first = {c: F.min(c).alias(c) for c in (flag, region, cluster) if c in table.columns}
    each = table.groupBy(*k, "ID").agg(F.avg("cf_sim").alias("cf_sim"), F.avg("cf_obs").alias("cf_obs"), F.avg("capacity").alias("capacity"), *first.values())
    if mode == "turbine-error":
        return each.withColumn("diff", diff)
    if mode == "cluster-error":
        out = each.groupBy(*k, cluster).agg(_mean("cf_sim").alias("cf_sim"), _mean("cf_obs").alias("cf_obs"), F.count("ID").alias("n"))
        return out.select(*k, cluster, diff.alias("diff"), "n")
    if mode == "regional-error":
        sets = each.groupingSets([[*map(F.col, k), F.col(region), F.col(flag)], [*map(F.col, k), F.col(region)]], *k, region, flag)
        out = sets.agg(_mean("cf_sim").alias("cf_sim"), _mean("cf_obs").alias("cf_obs"), F.count("ID").alias("n"), F.grouping(flag).alias("g"))
        value = F.when(F.col("g") == 1, diff).otherwise(F.abs(diff) / F.col("cf_obs") * 100)
        return out.select(*k, region, F.when(F.col("g") == 1, "Both").otherwise(F.col(flag).cast("string")).alias(flag), value.alias("diff"), "n", "cf_obs", "cf_sim")
    raise ValueError(f"unknown mode: {mode}")


def with_distance(each: DataFrame, places: DataFrame, trained: DataFrame, flag: str = "in_training") -> DataFrame:
    """each (ID, ...) with distance_km, that to the nearest place trained on; rows whose flag says yes are such places themselves, at 0.

    places: (ID, lon, lat); trained: (lon, lat), a training set's turbines, which go along as one array.
    """
    packed = trained.where("lon is not null and lat is not null").distinct().agg(F.collect_list(F.struct("lon", "lat")).alias("_t"))
    own = each.join(places.select("ID", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")), "ID", "left").crossJoin(F.broadcast(packed))
    near = F.array_min(F.transform("_t", lambda t: haversine_km(F.col("_lon"), F.col("_lat"), t["lon"], t["lat"])))
    return own.withColumn("distance_km", F.when(F.col(flag).cast("string").isin("yes", "true"), 0.0).otherwise(near)).drop("_t", "_lon", "_lat")


def sweep(mode: str, runs: DataFrame, obs: DataFrame, turbines: DataFrame) -> DataFrame:
    """(num_clu, time_res, rmse, mae, mbe) of all runs at once; runs: (num_clu, time_res, ID, year, month, cf).

    The uncorrected run is num_clu 1 with time_res uncorrected.
    """
    both = runs.withColumnRenamed("cf", "cf_sim").join(obs.select("ID", "year", "month", F.col("obs").alias("cf_obs")), ["ID", "year", "month"])
    table = both.join(turbines.select("ID", "capacity"), "ID").dropna(subset=["cf_sim", "cf_obs", "capacity"])
    return error(mode, table, by=("num_clu", "time_res"))


def error_lines(scores: DataFrame) -> DataFrame:
    """What a plot of errors over cluster counts shows: all scores but the uncorrected one's, in long form."""
    long = scores.where(F.col("time_res") != "uncorrected").unpivot(["num_clu", "time_res"], ["rmse", "mae", "mbe"], "metric", "value")
    return long.orderBy("metric", "time_res", "num_clu")
