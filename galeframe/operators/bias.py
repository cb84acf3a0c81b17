"""Bias correction: scalars, offsets, clusters and the training sets they are learned from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions.aggregates import mean_over_all_weights, mean_over_present_weights
from galeframe.functions.timeslice import hours_in_month, slice_of
from galeframe.operators.columns import clean_observations, complete_years, melt_months, month_names, remove_share, require
from galeframe.operators.series import interpolate
from galeframe.storage import small

SLICE = ("year", "time_slice", "cluster")
VALUES = ("sim", "obs", "scalar")


def generation_to_cf(obs: DataFrame, turbines: DataFrame) -> DataFrame:
    """Monthly kWh of turbines (ID, year, month, obs) as capacity factors of their kW; unknown turbines get null."""
    known = turbines.select("ID", F.col("capacity").alias("_kw"))
    return obs.join(known, "ID", "left").withColumn("obs", F.col("obs") / (hours_in_month(F.col("year"), F.col("month")) * F.nullif(F.col("_kw"), F.lit(0.0)))).drop("_kw")


def country_generation_to_cf(obs: DataFrame, turbines: DataFrame, output: str = "output_kwh", unit: str = "kW") -> DataFrame:
    """(year, month, obs): a country's monthly kWh over what all its turbines could give.

    A total under 10 MW, or none, is an error: it means that the units are wrong.
    """
    if unit not in ("kW", "MW"):
        raise ValueError(f"unknown unit: {unit}")
    total = turbines.agg(F.sum(F.col("capacity").cast("double"))).first()[0]
    total = total * 1000 if total is not None and unit == "MW" else total
    if total is None or not np.isfinite(total) or total < 10_000:
        raise ValueError(f"implausible total capacity: {total} kW")
    return obs.select("year", "month", (F.col(output) / (F.lit(total) * hours_in_month(F.col("year"), F.col("month")))).alias("obs"))


def prorata(shares: DataFrame, totals: DataFrame, weight: str, total: str) -> DataFrame:
    """Every total split over the rows of shares by their weight's share of all weights: totals' columns with the part in place of the total, shares' other columns, and share.

    totals are few (months of a country, say) and are broadcast while they are; shares may be many.
    """
    whole = shares.agg(F.sum(weight).alias("_all"))
    own = shares.crossJoin(F.broadcast(whole)).withColumn("share", F.col(weight) / F.nullif(F.col("_all"), F.lit(0))).drop("_all", weight)
    return own.crossJoin(small(totals)).withColumn(total, F.col(total) * F.col("share"))


def scalars(gen_cf: DataFrame, resolution: str) -> DataFrame:
    """(year, time_slice, cluster, obs, sim, scalar): capacity-weighted means and their ratio.

    Missing values count as zeros in the means; a slice without any observation so gets scalar 0, which factors() takes as missing.
    """
    df = gen_cf.where("cluster is not null").withColumn("time_slice", slice_of(F.col("month"), resolution))
    w = F.col("capacity")
    means = df.groupBy("year", "time_slice", "cluster").agg(mean_over_all_weights(F.col("obs"), w).alias("obs"), mean_over_all_weights(F.col("sim"), w).alias("sim"))
    return means.withColumn("scalar", F.col("obs") / F.nullif(F.col("sim"), F.lit(0.0)))


def factors(trained: DataFrame) -> DataFrame:
    """(cluster, time_slice, scalar, offset): means over the years; scalar 0 is missing, and without any the factor is 1 and 0."""
    means = trained.groupBy("cluster", "time_slice").agg(F.avg(F.nullif(F.col("scalar"), F.lit(0.0))).alias("s"), F.avg("offset").alias("o"))
    return means.select("cluster", "time_slice", F.coalesce("s", F.lit(1.0)).alias("scalar"), F.when(F.col("s").isNull(), 0.0).otherwise(F.col("o")).alias("offset"))


def solve_offset(mean_cf, obs: float, sim: float, tolerance: float = 0.002, evaluations: int = 30) -> float:
    """The wind speed to add so that mean_cf(offset) comes to obs.

    Steps are cube roots of the error, halved where they would grow. NaN after 30 evaluations; 0 where there is nothing to find.
    """
    gap = obs - sim
    step = 0.0 if not np.isfinite(gap) else float(np.sign(gap)) * 10.0
    before, offset, left = step, 0.0, evaluations
    while abs(step) > tolerance:
        if not left:
            return float("nan")
        left -= 1
        step = float(np.cbrt(obs - mean_cf(offset)))
        if not np.isfinite(step):
            return float("nan")
        if abs(step) > abs(before):
            step = before / 2 if np.sign(step) == np.sign(before) else -before / 2
        before = step
        offset += step
    return offset


def evaluate_segments(x: np.ndarray, segments: pd.DataFrame) -> np.ndarray:
    """Cubic pieces at x; NaN off the curve."""
    s = segments.sort_values("x0")
    if s.empty:
        return np.full(len(x), np.nan)
    i = np.clip(np.searchsorted(s["x0"].to_numpy(), x, side="right") - 1, 0, len(s) - 1)
    d = x - s["x0"].to_numpy()[i]
    c = [s[f"c{k}"].to_numpy()[i] for k in range(4)]
    inside = (x >= s["x0"].iloc[0]) & (x <= s["x1"].iloc[-1])
    return np.where(inside, c[0] + d * (c[1] + d * (c[2] + d * c[3])), np.nan)


def offsets(trained: DataFrame, wind: DataFrame, segments: DataFrame) -> DataFrame:
    """trained (year, time_slice, cluster, obs, sim, scalar) with the offset of each row.

    wind: (year, time_slice, cluster, model, capacity, ws), the uncorrected wind, made once. One (year, slice, cluster) is solved in one task;
    the curves' segments (a catalogue) are broadcast. Speeds that the offset takes off the curve don't count in the mean.
    """
    curves = wind.sparkSession.sparkContext.broadcast({m: g for m, g in segments.toPandas().groupby("model")})

    def solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left.copy()
        right = right.dropna(subset=["ws", "capacity"])
        parts = [(g["ws"].to_numpy(float), g["capacity"].to_numpy(float), curves.value.get(m)) for m, g in right.groupby("model")]

        def mean_cf(scalar: float):
            def at(offset: float) -> float:
                total = weight = 0.0
                for ws, kw, segs in parts:
                    cf = np.full(len(ws), np.nan) if segs is None else evaluate_segments(ws * scalar + offset, segs)
                    ok = np.isfinite(cf)
                    total, weight = total + float((cf * kw)[ok].sum()), weight + float(kw[ok].sum())
                return total / weight if weight else float("nan")

            return at

        out["offset"] = [solve_offset(mean_cf(s), o, m) for s, o, m in zip(out["scalar"].astype(float), out["obs"].astype(float), out["sim"].astype(float))]
        return out[[*SLICE, *VALUES, "offset"]]

    types = dict(trained.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*SLICE, *VALUES)) + ", offset double"
    # Fresh names keep the two sides apart where they come from one table.
    own = trained.select(*SLICE, *VALUES).toDF(*SLICE, *VALUES)
    speeds = wind.select(*SLICE, "model", "capacity", "ws").toDF("w_year", "w_slice", "w_cluster", "model", "capacity", "ws")
    solved = own.groupBy(*SLICE).cogroup(speeds.groupBy("w_year", "w_slice", "w_cluster")).applyInPandas(solve, schema)
    return solved.withColumn("offset", F.when(~F.isnan("offset"), F.col("offset")))


def fit_clusters(turbines: DataFrame, clusters: int, restarts: int = 10, iterations: int = 300, seed: int = 42):
    """A k-means model on (lat, lon): random starts, the cheapest of all restarts. None for one cluster, which needs no model.

    The distinct places, weighted by their turbines, are kept for all restarts and iterations, so the turbines are read once.
    """
    if clusters < 1:
        raise ValueError(f"no such number of clusters: {clusters}")
    if clusters == 1:
        return None
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    places = turbines.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.count("*").cast("double").alias("weight"))
    points = VectorAssembler(inputCols=["lat", "lon"], outputCol="features").transform(places).select("features", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Few places make few tasks: each iteration is a job.
        fewer = points.coalesce(1 + points.count() // 50_000)
        models = [KMeans(k=clusters, initMode="random", maxIter=iterations, seed=seed + i, weightCol="weight").fit(fewer) for i in range(restarts)]
        return min(models, key=lambda m: m.summary.trainingCost)
    finally:
        points.unpersist()


def assign_clusters(model, turbines: DataFrame) -> DataFrame:
    """turbines with the number of the nearest centre; 0 without a model. Turbines without coordinates fall out."""
    if model is None:
        return turbines.where("lat is not null and lon is not null").withColumn("cluster", F.lit(0))
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["lat", "lon"], outputCol="_f", handleInvalid="skip").transform(turbines)
    return model.setFeaturesCol("_f").setPredictionCol("cluster").transform(points).drop("_f")


def monthly_simulated(cf: DataFrame) -> DataFrame:
    """(ID, year, month, sim): monthly means of (time, ID, cf)."""
    return cf.groupBy("ID", F.year("time").alias("year"), F.month("time").alias("month")).agg(F.avg("cf").alias("sim"))


def training_set(cf: DataFrame, observed: DataFrame, turbines: DataFrame, country: str, add_nan: float | None = None, interp_nan: int | None = None) -> DataFrame:
    """(ID, year, month, sim, obs): simulated and observed capacity factors of the turbines observed in all years.

    observed: wide (ID, year, obs_1..obs_12) of capacity factors. add_nan removes a share of the observations, interp_nan fills
    gaps of up to that many months.
    """
    require(observed, "ID", "year", *month_names())
    wide = complete_years(clean_observations(observed, train=True, country=country))
    long = melt_months(wide)
    if add_nan is not None:
        long = remove_share(long, add_nan, ["ID", "year", "month"])
    if interp_nan is not None:
        long = interpolate(long, ["ID"], ["year", "month"], "obs", interp_nan)
    sim = monthly_simulated(cf).join(long.select("ID").distinct(), "ID", "left_semi")
    return sim.join(long, ["ID", "year", "month"], "left")


def clustered(gen_cf: DataFrame, turbines: DataFrame, resolution: str) -> DataFrame:
    """gen_cf's means by (ID, year, slice) with their turbine's cluster and capacity; those without a cluster fall out."""
    df = gen_cf.withColumn("time_slice", slice_of(F.col("month"), resolution))
    means = df.groupBy("ID", "year", "time_slice").agg(F.avg("obs").alias("obs"), F.avg("sim").alias("sim"))
    joined = means.join(turbines.select("ID", "cluster", "capacity"), "ID", "left").where("cluster is not null")
    w = F.col("capacity")
    out = joined.groupBy("year", "time_slice", "cluster").agg(mean_over_all_weights(F.col("obs"), w).alias("obs"), mean_over_all_weights(F.col("sim"), w).alias("sim"))
    return out.withColumn("scalar", F.col("obs") / F.nullif(F.col("sim"), F.lit(0.0)))


def country_training_set(sim: DataFrame, obs: DataFrame, resolution: str) -> DataFrame:
    """(year, time_slice, cluster 0, obs, sim, scalar, offset 0) of a country's monthly series; both (year, month, ...)."""
    joined = sim.select("year", "month", "sim").join(obs.select("year", "month", "obs"), ["year", "month"])
    means = joined.withColumn("time_slice", slice_of(F.col("month"), resolution)).groupBy("year", "time_slice").agg(F.avg("obs").alias("obs"), F.avg("sim").alias("sim"))
    return means.select("year", "time_slice", F.lit(0).alias("cluster"), "obs", "sim", (F.col("obs") / F.nullif(F.col("sim"), F.lit(0.0))).alias("scalar"), F.lit(0.0).alias("offset"))


def validation_set(observed: DataFrame, turbines: DataFrame, year: int, country: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned long observations of a year, and the turbines that have some."""
    long = melt_months(clean_observations(observed.where(F.col("year") == year), country=country))
    long = long.join(turbines.select("ID"), "ID", "left_semi")
    return long, turbines.join(long.select("ID").distinct(), "ID", "left_semi")


def turbines_to_country(cf: DataFrame, turbines: DataFrame) -> DataFrame:
    """(year, month, cf): the capacity-weighted mean over turbines with a capacity."""
    joined = cf.join(turbines.select("ID", "capacity"), "ID").where("capacity is not null and cf is not null")
    return joined.groupBy("year", "month").agg(mean_over_present_weights(F.col("cf"), F.col("capacity")).alias("cf"))
