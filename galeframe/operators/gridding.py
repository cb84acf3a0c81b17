"""Scattered control points to surfaces: nearest, inverse distance, kriging and radial basis functions, and their cross-validation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions.aggregates import log_ratio, mae, rmse
from galeframe.functions.scalars import domain
from galeframe.operators.columns import finite_points, overlay, require
from galeframe.operators.geo import in_batches, inside, near_places, spatial_bins, tiles
from galeframe.storage import stored

METHODS = ("nearest", "idw", "ok", "rbf")
#: Control points up to which a surface is fitted whole on each executor; kriging thins out more than that first.
MOST_CONTROLS = 15_000


def target_grid(spark: SparkSession, lons: list[float], lats: list[float]) -> DataFrame:
    """(ID, lon, lat) of all nodes; ID counts them row by row."""
    x = spark.createDataFrame([(i, float(v)) for i, v in enumerate(lons)], "_x int, lon double")
    y = spark.createDataFrame([(i, float(v)) for i, v in enumerate(lats)], "_y int, lat double")
    return y.crossJoin(F.broadcast(x)).select((F.col("_y").cast("long") * len(lons) + F.col("_x")).alias("ID"), "lon", "lat")


def _at_places(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(ID, prediction) of all queries by that of their place (lon, lat, prediction)."""
    q = queries.select("ID", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    return q.join(found, ["lon", "lat"], "left").select("ID", "prediction")


def nearest(queries: DataFrame, controls: DataFrame, value: str, max_km: float = 300.0) -> DataFrame:
    """(ID, prediction): the nearest control's value; null if none is within max_km. Each place of the queries is looked up once."""
    near = near_places(queries, controls, 1, max_km, value)
    return _at_places(queries, near.select("lon", "lat", F.get("_n", F.lit(0))[value].alias("prediction")))


def idw(queries: DataFrame, controls: DataFrame, value: str, k: int = 8, power: float = 2.0, max_km: float = 300.0) -> DataFrame:
    """(ID, prediction): the mean of the k nearest controls within max_km, weighted by distance**-power; a control's own value at its place.

    Each place of the queries is looked up once.
    """
    near = near_places(queries, controls, k, max_km, value).select("lon", "lat", F.explode("_n").alias("_x"))
    d, v = F.col("_x.distance_km"), F.col(f"_x.{value}")
    w = F.pow(F.greatest(d, F.lit(1e-12)), F.lit(-power))
    exact = F.max(F.when(d == 0, v))
    return _at_places(queries, near.groupBy("lon", "lat").agg(F.coalesce(exact, F.sum(w * v) / F.sum(w)).alias("prediction")))


def _controls(controls: DataFrame, value: str) -> np.ndarray:
    """(lon, lat, value) of the distinct places on the driver. More than MOST_CONTROLS raise ValueError: thin them out first."""
    means = controls.where(F.col(value).isNotNull()).groupBy("lon", "lat").agg(F.avg(value).alias("v")).orderBy("lon", "lat").limit(MOST_CONTROLS + 1).toPandas()
    if len(means) > MOST_CONTROLS:
        raise ValueError(f"more than {MOST_CONTROLS} control points; use spatial_bins first")
    return means[["lon", "lat", "v"]].to_numpy(float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def semivariogram(xy: np.ndarray, z: np.ndarray, lags: int = 6, block: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The mean distance and semivariance of all pairs, in as many equal bins of distance as lags; empty bins are left out."""
    far = 0.0
    for at in range(0, len(xy), block):
        far = max(far, float(_distances(xy[at : at + block], xy).max()))
    n, d_sum, g_sum = np.zeros(lags), np.zeros(lags), np.zeros(lags)
    for at in range(0, len(xy), block):
        d = _distances(xy[at : at + block], xy)
        upper = np.arange(len(xy))[None, :] > np.arange(at, at + len(d))[:, None]
        dist, g = d[upper], (0.5 * (z[at : at + block, None] - z[None, :]) ** 2)[upper]
        bin_ = np.minimum((dist / (far or 1) * lags).astype(int), lags - 1)
        n += np.bincount(bin_, minlength=lags)
        d_sum += np.bincount(bin_, weights=dist, minlength=lags)
        g_sum += np.bincount(bin_, weights=g, minlength=lags)
    ok = n > 0
    return d_sum[ok] / n[ok], g_sum[ok] / n[ok]


def variogram_value(h: np.ndarray, model: str, sill: float, reach: float, nugget: float) -> np.ndarray:
    """Semivariance at distance h; sill is the partial one."""
    x = h / reach
    if model == "spherical":
        return nugget + sill * np.where(x <= 1, 1.5 * x - 0.5 * x**3, 1.0)
    if model == "exponential":
        return nugget + sill * (1 - np.exp(-3 * x))
    if model == "gaussian":
        return nugget + sill * (1 - np.exp(-((x / (4 / 7)) ** 2)))
    if model == "linear":
        return nugget + sill * np.minimum(x, 1.0)
    raise ValueError(f"unknown variogram: {model}")


def fit_variogram(h: np.ndarray, g: np.ndarray, model: str) -> tuple[float, float, float]:
    """(partial sill, range, nugget) by least squares, none negative; the range is searched on a fine grid, the rest is linear in it."""
    best, out = np.inf, (float(g.max(initial=0.0)), float(h.max(initial=1.0)) or 1.0, 0.0)
    for reach in np.linspace(0.02, 1.5, 150) * (h.max(initial=0.0) or 1.0):
        shape = variogram_value(h, model, 1.0, reach, 0.0)
        for free in ((0, 1), (0,), (1,)):
            a = np.stack([shape, np.ones_like(h)], axis=1)[:, free]
            coef = np.linalg.lstsq(a, g, rcond=None)[0]
            if (coef < 0).any():
                continue
            err = float(((a @ coef - g) ** 2).sum())
            if err < best - 1e-15:
                full = np.zeros(2)
                full[list(free)] = coef
                best, out = err, (float(full[0]), float(reach), float(full[1]))
    return out


def kriging(queries: DataFrame, controls: DataFrame, value: str, model: str = "spherical", lags: int = 6, closest: int | None = 30) -> DataFrame:
    """(ID, prediction) by ordinary kriging in degrees; fewer than 5 places give nulls.

    The variogram is fitted once on the driver (control points are bounded, see MOST_CONTROLS); grid points are solved where they are, each with
    its closest controls, or with all of them if closest is None or not positive.
    """
    c = _controls(controls, value)
    if len(c) < 5:
        return queries.select("ID", F.lit(None).cast("double").alias("prediction"))
    xy, z = c[:, :2], c[:, 2]
    sill, reach, nugget = fit_variogram(*semivariogram(xy, z, lags), model)
    many = len(c) if not closest or closest <= 0 else min(closest, len(c))
    shared = queries.sparkSession.sparkContext.broadcast((xy, z))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        pts, val = shared.value
        q = frame[["lon", "lat"]].to_numpy(float)
        d = _distances(q, pts)
        pick = np.argpartition(d, many - 1, axis=1)[:, :many] if many < len(pts) else np.tile(np.arange(len(pts)), (len(q), 1))
        out = np.empty(len(q))
        for i, p in enumerate(pick):
            a = np.ones((many + 1, many + 1))
            a[:many, :many] = variogram_value(_distances(pts[p], pts[p]), model, sill, reach, nugget)
            np.fill_diagonal(a, 0.0)
            b = np.ones(many + 1)
            b[:many] = variogram_value(d[i, p], model, sill, reach, nugget)
            b[:many][d[i, p] <= 1e-10] = 0.0
            try:
                w = np.linalg.solve(a, b)
            except np.linalg.LinAlgError:
                w = np.linalg.pinv(a) @ b
            out[i] = w[:many] @ val[p]
        return pd.DataFrame({"ID": frame["ID"], "prediction": out})

    kind = queries.schema["ID"].dataType.simpleString()
    return in_batches(queries.select("ID", "lon", "lat"), f"ID {kind}, prediction double", solve, 512)


_KERNELS = {
    "thin_plate_spline": lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0.0),
    "linear": lambda r: -r, "cubic": lambda r: r**3, "gaussian": lambda r: np.exp(-(r**2)), "multiquadric": lambda r: -np.sqrt(1 + r * r),
}


def rbf(queries: DataFrame, controls: DataFrame, value: str, kernel: str = "thin_plate_spline", closest: int = 50) -> DataFrame:
    """(ID, prediction) by radial basis functions with a linear polynomial over the closest controls; longitudes are scaled by the mean latitude's cosine.

    Fewer than 5 places give nulls; where the local system is singular the nearest control's value is taken.
    """
    if kernel not in _KERNELS:
        raise ValueError(f"unknown kernel: {kernel}")
    c = _controls(controls, value)
    if len(c) < 5:
        return queries.select("ID", F.lit(None).cast("double").alias("prediction"))
    scale = float(np.cos(np.radians(c[:, 1].mean())))
    many = min(closest, len(c))
    shared = queries.sparkSession.sparkContext.broadcast((c[:, :2] * [scale, 1.0], c[:, 2]))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        pts, val = shared.value
        f = _KERNELS[kernel]
        q = frame[["lon", "lat"]].to_numpy(float) * [scale, 1.0]
        d = _distances(q, pts)
        pick = np.argsort(d, axis=1, kind="stable")[:, :many]
        out = np.empty(len(q))
        for i, p in enumerate(pick):
            centre = pts[p].mean(axis=0)
            spread = np.abs(pts[p] - centre).max() or 1.0
            poly = np.c_[np.ones(many), (pts[p] - centre) / spread]
            a = np.zeros((many + 3, many + 3))
            a[:many, :many] = f(_distances(pts[p], pts[p]))
            a[:many, many:], a[many:, :many] = poly, poly.T
            try:
                w = np.linalg.solve(a, np.r_[val[p], 0, 0, 0])
                out[i] = np.r_[f(d[i, p]), 1.0, (q[i] - centre) / spread] @ w
            except np.linalg.LinAlgError:
                out[i] = val[p[0]]
        return pd.DataFrame({"ID": frame["ID"], "prediction": out})

    kind = queries.schema["ID"].dataType.simpleString()
    return in_batches(queries.select("ID", "lon", "lat"), f"ID {kind}, prediction double", solve, 512)


def predict(method: str, queries: DataFrame, controls: DataFrame, value: str, **options) -> DataFrame:
    """(ID, prediction) by one of METHODS."""
    found = {"nearest": nearest, "idw": idw, "ok": kriging, "rbf": rbf}.get(method)
    if found is None:
        raise ValueError(f"unknown method: {method}")
    return found(queries, finite_points(controls), value, **options)


def folds(df: DataFrame, degrees: float = 2.0, count: int = 5, seed: int = 42) -> DataFrame:
    """df with tile and fold; the tiles (a few thousand at most on the globe) are shuffled on the driver and dealt out."""
    placed = tiles(df, degrees)
    names = [r["tile"] for r in placed.select("tile").distinct().orderBy("tile").collect()]
    order = np.random.default_rng(seed).permutation(len(names))
    dealt = df.sparkSession.createDataFrame([(names[t], i % count) for i, t in enumerate(order.tolist())], "tile string, fold int")
    return placed.join(F.broadcast(dealt), "tile")


def _error(value: str) -> Column:
    t, p = F.col("truth"), F.col("prediction")
    if value == "scalar":
        return log_ratio(t, p)
    return F.when(F.abs(t) < float("inf"), F.when(F.abs(p) < float("inf"), p - t))


def cross_validate(controls: DataFrame, mode: str, value: str, methods: list[str], least: int = 20, **tiling) -> DataFrame:
    """(mode, value, method, fold, n_test, mae, rmse): each fold of tiles predicted from the others.

    Errors are log ratios for scalar and differences otherwise.
    """
    require(controls, "mode", "lon", "lat", value)
    own = finite_points(controls.where(F.lower(F.col("mode").cast("string")) == mode))
    if (n := own.count()) < least:
        raise ValueError(f"too few control points for {mode}: {n}")
    # Repeated points count once, and all folds and methods read the one table of them.
    own = own.select("lon", "lat", value, F.xxhash64("lon", "lat", value).alias("ID")).dropDuplicates(["ID"])
    placed = stored(folds(stored(own, "points"), **tiling).select("ID", "lon", "lat", "fold", value), "folds")
    parts = []
    for fold in range(tiling.get("count", 5)):
        train, test = placed.where(F.col("fold") != fold), placed.where(F.col("fold") == fold)
        for m in methods:
            joined = test.select("ID", F.col(value).alias("truth")).join(predict(m, test, train, value), "ID", "left")
            n_test = F.count(F.when(F.abs("truth") < float("inf"), 1))
            scores = joined.agg(n_test.alias("n_test"), mae(_error(value)).alias("mae"), rmse(_error(value)).alias("rmse"))
            parts.append(scores.select(F.lit(mode).alias("mode"), F.lit(value).alias("value"), F.lit(m).alias("method"), F.lit(fold).alias("fold"), "n_test", "mae", "rmse"))
    return reduce(DataFrame.unionByName, parts)


def summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("mode", "value", "method").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse")).orderBy("mode", "value", "method")


def merge_surfaces(grid: DataFrame, onshore: DataFrame, offshore: DataFrame, first: str = "offshore", on: str = "onshore", off: str = "offshore") -> DataFrame:
    """grid (ID, lon, lat and the two flags) with prediction: each surface within its own area, the first wins where both are."""
    joined = grid.join(onshore.select("ID", F.col("prediction").alias("_on")), "ID", "left").join(offshore.select("ID", F.col("prediction").alias("_off")), "ID", "left")
    a, b = F.when(F.col(on), F.col("_on")), F.when(F.col(off), F.col("_off"))
    if first not in ("onshore", "offshore"):
        raise ValueError(f"unknown priority: {first}")
    return joined.withColumn("prediction", overlay(b, a) if first == "onshore" else overlay(a, b)).drop("_on", "_off")


def control_domain(controls: DataFrame, onshore: DataFrame, offshore: DataFrame) -> DataFrame:
    """controls with mode from its column mode, type or domain; without one, by the area that holds each; those in none go."""
    for c in ("mode", "type", "domain"):
        if c in controls.columns:
            return controls.withColumn("mode", domain(F.col(c))).where(F.col("mode").isin("onshore", "offshore"))
    flagged = inside(inside(controls, onshore, out="_on"), offshore, out="_off")
    return flagged.withColumn("mode", F.when(F.col("_on"), "onshore").when(F.col("_off"), "offshore")).where("mode is not null").drop("_on", "_off")


def compare(grid: DataFrame, controls: DataFrame, onshore: DataFrame, offshore: DataFrame, methods: list[str] = ("nearest", "idw"), values: list[str] = ("scalar", "offset"), first: str = "offshore") -> DataFrame:
    """(value, method, ID, lon, lat, prediction) of every method and value, over both areas."""
    flagged = inside(inside(grid, onshore, out="onshore"), offshore, out="offshore")
    own = control_domain(controls, onshore, offshore)
    parts = []
    for v in values:
        for m in methods:
            on = predict(m, flagged.where("onshore"), own.where("mode = 'onshore'"), v)
            off = predict(m, flagged.where("offshore"), own.where("mode = 'offshore'"), v)
            merged = merge_surfaces(flagged, on, off, first)
            parts.append(merged.select(F.lit(v).alias("value"), F.lit(m).alias("method"), "ID", "lon", "lat", "prediction"))
    return reduce(DataFrame.unionByName, parts)


def export_grid(grid: DataFrame, controls: DataFrame, onshore: DataFrame, offshore: DataFrame, on_closest: int = 50, off_closest: int = 80, bin_degrees: float = 0.05) -> DataFrame:
    """(y, x, scalar, offset, onshore, offshore): kriged factors, onshore first; 1 and 0 outside both areas."""
    flagged = inside(inside(grid, onshore, out="onshore"), offshore, out="_sea").withColumn("offshore", F.col("_sea") & ~F.col("onshore")).drop("_sea")
    own = finite_points(control_domain(controls, onshore, offshore))
    out = flagged
    for v, identity in (("scalar", 1.0), ("offset", 0.0)):
        parts = []
        for mode, closest in (("onshore", on_closest), ("offshore", off_closest)):
            c = own.where(F.col("mode") == mode)
            if c.count() > MOST_CONTROLS:
                c = spatial_bins(c, bin_degrees, [v])
            parts.append(kriging(flagged.where(mode), c, v, closest=closest))
        joined = merge_surfaces(flagged, *parts, first="onshore").select("ID", F.col("prediction").alias(v))
        out = out.join(joined, "ID", "left").withColumn(v, F.when(F.col("onshore") | F.col("offshore"), F.col(v)).otherwise(identity))
    return out.select(F.col("lat").alias("y"), F.col("lon").alias("x"), "scalar", "offset", "onshore", "offshore").orderBy("y", "x")
