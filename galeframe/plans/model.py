"""Train, simulate and score: the run of a country from tables to errors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions.timeslice import RESOLUTIONS, slice_of
from galeframe.operators import bias, errors, wind
from galeframe.sources.tables import missing_runs, run_name, write
from galeframe.storage import stored


@dataclass
class WindModel:
    """A country's bias-corrected wind model over (reanalysis, turbines with models, curves); each run is kept below path.

    cluster_mode: all, onshore or offshore turbines are clustered and corrected.
    """

    country: str
    path: str
    cluster_mode: str = "onshore"
    level: str = "turbine"
    clusters: tuple[int, ...] = (1,)
    resolutions: tuple[str, ...] = RESOLUTIONS
    add_nan: float | None = None
    interp_nan: int | None = None

    def __post_init__(self):
        if self.level not in ("turbine", "country"):
            raise ValueError(f"unknown level: {self.level}")
        if self.cluster_mode not in ("all", "onshore", "offshore"):
            raise ValueError(f"unknown cluster mode: {self.cluster_mode}")
        if bad := set(self.resolutions) - set(RESOLUTIONS):
            raise ValueError(f"unknown time resolutions: {sorted(bad)}")

    @property
    def folder(self) -> str:
        return f"{self.path}/{run_name(self.country, self.cluster_mode, self.level, add_nan=self.add_nan, interp_nan=self.interp_nan)}"

    def _own(self, turbines: DataFrame) -> DataFrame:
        return turbines if self.cluster_mode == "all" or "type" not in turbines.columns else turbines.where(F.col("type") == self.cluster_mode)

    def _runs(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, r) for k in self.clusters for r in self.resolutions], "num_clu int, time_res string")

    def train(self, reanalysis: DataFrame, turbines: DataFrame, curves: DataFrame, observed: DataFrame) -> DataFrame:
        """The factors (num_clu, time_res, cluster, time_slice, scalar, offset) of all runs; those that were trained before are read.

        observed: wide capacity factors, or for a country (year, month, obs). The uncorrected wind is made once and serves all runs.
        """
        spark = reanalysis.sparkSession
        at = f"{self.folder}/factors"
        try:
            done = spark.read.parquet(at)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        todo = self._runs(spark) if done is None else missing_runs(self._runs(spark), done)
        todo = [(r["num_clu"], r["time_res"]) for r in todo.collect()]
        if todo:
            write(reduce(DataFrame.unionByName, self._trained(todo, reanalysis, self._own(turbines), curves, observed)), at, mode="append")
        return spark.read.parquet(at)

    def _trained(self, todo, reanalysis, turbines, curves, observed):
        def named(df: DataFrame, k: int, r: str) -> DataFrame:
            return df.select(F.lit(k).alias("num_clu"), F.lit(r).alias("time_res"), "cluster", "time_slice", "scalar", "offset")

        if self.level == "country":
            series = stored(wind.simulate_country(reanalysis, turbines, curves), "country")
            sim = series.select(F.year("time").alias("year"), F.month("time").alias("month"), F.col("cf").alias("sim"))
            return [named(bias.factors(bias.country_training_set(sim, observed, r)), k, r) for k, r in todo]
        cf = stored(wind.simulate(reanalysis, turbines, curves), "cf")
        gen = stored(bias.training_set(cf, observed, turbines, self.country, self.add_nan, self.interp_nan), "training")
        segments = stored(wind.akima_segments(curves), "segments")
        known = turbines.join(gen.select("ID").distinct(), "ID", "left_semi")
        out, fitted = [], {}
        for k, r in todo:
            if k not in fitted:
                fitted[k] = stored(bias.assign_clusters(bias.fit_clusters(known, k), known).select("ID", "lat", "lon", "cluster", "capacity", "model"), "clusters")
                write(fitted[k].groupBy("cluster").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).withColumn("num_clu", F.lit(k)), f"{self.folder}/centres", "num_clu")
            t = bias.clustered(gen, fitted[k], r)
            ws = cf.select("ID", "ws", F.year("time").alias("year"), slice_of(F.month("time"), r).alias("time_slice")).join(fitted[k].select("ID", "cluster", "capacity", "model"), "ID")
            out.append(named(bias.factors(bias.offsets(t, ws, segments)), k, r))
        return out

    def _clustered(self, turbines: DataFrame, k: int) -> DataFrame:
        """turbines with the nearest of the trained centres, as k-means would give it."""
        if self.level == "country":
            return turbines.withColumn("cluster", F.lit(0))
        centres = turbines.sparkSession.read.parquet(f"{self.folder}/centres").where(F.col("num_clu") == k)
        packed = centres.agg(F.collect_list(F.struct("lat", "lon", "cluster")).alias("_c"))
        far = F.transform("_c", lambda c: F.struct((F.pow(c["lat"] - F.col("lat"), 2) + F.pow(c["lon"] - F.col("lon"), 2)).alias("d"), c["cluster"].alias("cluster")))
        return turbines.crossJoin(F.broadcast(packed)).withColumn("cluster", F.array_min(far)["cluster"]).drop("_c")

    def simulate(self, reanalysis: DataFrame, turbines: DataFrame, curves: DataFrame, year: int) -> DataFrame:
        """(num_clu, time_res, time, ID, cf) of a year, corrected by every run's factors, and uncorrected as run 1."""
        spark = reanalysis.sparkSession
        own, at = self._own(turbines), f"{self.folder}/cf/year={year}"
        days = reanalysis.where(F.year("time") == year)
        plain = stored(wind.wind_at(days, own).join(own.select("ID", "model"), "ID"), "wind")
        factors = spark.read.parquet(f"{self.folder}/factors")
        segments = wind.akima_segments(curves)

        def named(df: DataFrame, k: int, r: str) -> DataFrame:
            return df.select(F.lit(k).alias("num_clu"), F.lit(r).alias("time_res"), "time", "ID", "cf")

        parts = [named(wind.to_capacity_factor(plain, segments), 1, "uncorrected")]
        for k in self.clusters:
            clusters = self._clustered(own, k).select("ID", "cluster")
            for r in self.resolutions:
                mine = factors.where((F.col("num_clu") == k) & (F.col("time_res") == r))
                parts.append(named(wind.to_capacity_factor(wind.correct(plain.join(clusters, "ID"), mine, r), segments), k, r))
        write(reduce(DataFrame.unionByName, parts), at, "num_clu", "time_res")
        return spark.read.parquet(at)

    def score(self, observed: DataFrame, turbines: DataFrame, year: int, modes: tuple[str, ...] = ("temporal-focus", "spatial-focus", "total")) -> DataFrame:
        """(mode, num_clu, time_res, rmse, mae, mbe) of a simulated year."""
        obs, known = bias.validation_set(observed, turbines, year, self.country)
        cf = turbines.sparkSession.read.parquet(f"{self.folder}/cf/year={year}")
        runs = cf.groupBy("num_clu", "time_res", "ID", F.year("time").alias("year"), F.month("time").alias("month")).agg(F.avg("cf").alias("cf"))
        runs = stored(runs, "monthly")
        return reduce(DataFrame.unionByName, [errors.sweep(m, runs, obs, known).select(F.lit(m).alias("mode"), "num_clu", "time_res", "rmse", "mae", "mbe") for m in modes])
