"""Reanalysis preparation, wind at turbines, and capacity factors from power curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions.aggregates import mean_over_present_weights
from galeframe.functions.scalars import clip, log_profile, log_roughness, roughness, speed
from galeframe.functions.timeslice import slice_of
from galeframe.operators.columns import BOXES, in_box, require
from galeframe.operators.series import backfill, resample
from galeframe.storage import small

#: Curves, of some tens of pieces each, that are broadcast; a larger catalogue is joined by a shuffle.
MODELS = 10_000


def unify_time(df: DataFrame) -> DataFrame:
    """df with one column time; valid_time wins where both are there."""
    if "valid_time" not in df.columns:
        return require(df, "time")
    time = F.coalesce("valid_time", "time") if "time" in df.columns else F.col("valid_time")
    return df.withColumn("time", time).drop("valid_time")


def prepare_reanalysis(raw: DataFrame, country: str | None = None, box: tuple | None = None, from_two_heights: bool = True) -> DataFrame:
    """(time, lat, lon, wnd100m, roughness): daily means of hourly winds.

    raw: (time or valid_time, lat, lon, u100, v100) with u10 and v10, from which the roughness length is found hour by hour
    (back-filled over hours without shear), or with fsr, which is taken as it is if from_two_heights is false. Coordinates are
    rounded half-even to 5 places.
    """
    df = unify_time(raw)
    if box or country:
        df = in_box(df, box or BOXES[country])
    df = df.withColumn("wnd100m", speed(F.col("u100"), F.col("v100")))
    if from_two_heights:
        df = df.withColumn("_log", log_roughness(speed(F.col("u10"), F.col("v10")), F.col("wnd100m")))
        df = backfill(df, ["lat", "lon"], ["time"], "_log").withColumn("roughness", roughness(F.col("_log")))
    else:
        df = df.withColumn("roughness", clip(F.col("fsr"), 1e-6))
    df = df.select("time", F.bround("lat", 5).alias("lat"), F.bround("lon", 5).alias("lon"), "wnd100m", "roughness")
    return resample(df, "day", ["lat", "lon"], ["wnd100m", "roughness"]).select("time", "lat", "lon", "wnd100m", "roughness")


def _cells(points: DataFrame, axis: DataFrame, column: str, key: str) -> DataFrame:
    """(key, lo, hi, t) on one axis: the cell that holds each point, or the edge cell nearest to it, and the place in it.

    The axis (the grid's distinct coordinates, some hundreds) is one sorted array; t is not held to [0, 1], so values beyond the
    grid are extrapolated.
    """
    a = axis.agg(F.sort_array(F.collect_set(column)).alias("_axis"))
    below = F.size(F.filter("_axis", lambda x: x <= F.col(column)))
    i = F.greatest(F.lit(1), F.least(below, F.size("_axis") - 1))
    lo, hi = F.element_at("_axis", i), F.element_at("_axis", i + 1)
    cells = points.select(key, column).crossJoin(F.broadcast(a)).where(F.size("_axis") > 1).select(key, column, lo.alias("lo"), hi.alias("hi"))
    return cells.select(key, "lo", "hi", ((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("t"))


def stencil(points: DataFrame, grid: DataFrame, key: str = "ID") -> DataFrame:
    """(key, lat, lon, weight): the four nodes about each point with their bilinear weights."""
    nodes = grid.select("lat", "lon").distinct()
    y, x = _cells(points, nodes, "lat", key), _cells(points, nodes, "lon", key)
    both = y.select(key, F.array(F.struct(F.col("lo").alias("lat"), (1 - F.col("t")).alias("w")), F.struct(F.col("hi").alias("lat"), F.col("t").alias("w"))).alias("_y")).join(
        x.select(key, F.array(F.struct(F.col("lo").alias("lon"), (1 - F.col("t")).alias("w")), F.struct(F.col("hi").alias("lon"), F.col("t").alias("w"))).alias("_x")), key
    )
    flat = both.select(key, "_x", F.explode("_y").alias("_b")).select(key, "_b", F.explode("_x").alias("_a"))
    return flat.select(key, F.col("_b.lat").alias("lat"), F.col("_a.lon").alias("lon"), (F.col("_b.w") * F.col("_a.w")).alias("weight"))


def wind_at(reanalysis: DataFrame, turbines: DataFrame) -> DataFrame:
    """(time, ID, ws) at each turbine's place and height: the log profile at the four nodes, then their bilinear mean.

    A null at any of the nodes gives null. The stencil is joined by an equi-join on the node, so the
    grid is never crossed with the turbines.
    """
    spots = stencil(turbines, reanalysis).join(turbines.select("ID", "height"), "ID")
    at = reanalysis.join(spots, ["lat", "lon"]).withColumn("_ws", log_profile(F.col("wnd100m"), F.col("height"), F.col("roughness")))
    per = at.groupBy("time", "ID").agg(F.sum(F.col("weight") * F.col("_ws")).alias("ws"), F.count("_ws").alias("_n"))
    return per.select("time", "ID", F.when(F.col("_n") == 4, F.col("ws")).alias("ws"))


def melt_curves(wide: DataFrame, speed_column: str = "data$speed") -> DataFrame:
    """(model, ordinal, speed, cf) of a table with one column for each model; ordinal is the catalogue's order."""
    models = [c for c in wide.columns if c != speed_column]
    plain = wide.toDF(*(f"c{i}" for i in range(len(wide.columns))))
    names = {f"c{i}": c for i, c in enumerate(wide.columns)}
    at = next(k for k, v in names.items() if v == speed_column)
    long = plain.unpivot([at], [k for k in names if k != at], "_c", "cf")
    lookup = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    order = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))])
    out = long.select(F.element_at(lookup, F.col("_c")).alias("model"), F.col(at).cast("double").alias("speed"), F.col("cf").cast("double").alias("cf"))
    return out.withColumn("ordinal", F.element_at(order, F.col("model"))).select("model", "ordinal", "speed", "cf")


def linear_segments(curves: DataFrame) -> DataFrame:
    """(model, x0, x1, c0, c1) of each piece of each curve: cf = c0 + c1 (speed - x0)."""
    w = Window.partitionBy("model").orderBy("speed")
    nxt = curves.where("cf is not null and speed is not null").withColumns({"x1": F.lead("speed").over(w), "y1": F.lead("cf").over(w)})
    return nxt.where("x1 is not null").select("model", F.col("speed").alias("x0"), "x1", F.col("cf").alias("c0"), ((F.col("y1") - F.col("cf")) / (F.col("x1") - F.col("speed"))).alias("c1"))


def akima_segments(curves: DataFrame) -> DataFrame:
    """(model, x0, x1, c0, c1, c2, c3): Akima's 1970 spline of each curve, as cubics in speed - x0.

    Two slopes are added at each end by reflection. Where both weights vanish (their sum is at most 1e-9 of the
    curve's largest) the slope is the mean of the two beside the node. A curve needs two nodes.
    """
    w = Window.partitionBy("model").orderBy("speed")
    p = curves.where("cf is not null and speed is not null").select("model", F.col("speed").alias("x0"), F.col("cf").alias("y0"))
    p = p.withColumns({"x1": F.lead("x0").over(w.orderBy("x0")), "y1": F.lead("y0").over(w.orderBy("x0")), "i": F.row_number().over(w.orderBy("x0"))})
    by = Window.partitionBy("model").orderBy("x0")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = p.withColumn("m", (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    p = p.withColumns({
        "n": F.count("*").over(whole),
        "ms": F.collect_list("m").over(whole),  # a curve's slopes: some tens
    })
    first, second = F.element_at("ms", 1), F.coalesce(F.get("ms", F.lit(1)), F.element_at("ms", 1))
    last, before = F.element_at("ms", -1), F.coalesce(F.get("ms", F.size("ms") - 2), F.element_at("ms", -1))
    ext = F.concat(F.array(3 * first - 2 * second, 2 * first - second), F.col("ms"), F.array(2 * last - before, 3 * last - 2 * before))
    p = p.where("n > 1").withColumn("e", ext)
    # Node i has slopes e[i-1], e[i] before and e[i+1], e[i+2] after, counting nodes and the array from 1.
    e = [F.element_at("e", F.col("i") + k) for k in range(4)]
    p = p.withColumns({"a": F.abs(e[3] - e[2]), "b": F.abs(e[1] - e[0]), "left": e[1], "right": e[2]})
    p = p.withColumn("most", F.max(F.col("a") + F.col("b")).over(whole))
    flat = F.col("a") + F.col("b") <= 1e-9 * F.col("most")
    t = F.when(flat, (F.col("left") + F.col("right")) / 2).otherwise((F.col("a") * F.col("left") + F.col("b") * F.col("right")) / F.nullif(F.col("a") + F.col("b"), F.lit(0.0)))
    p = p.withColumn("t0", t).withColumn("t1", F.lead("t0").over(by)).where("x1 is not null").withColumn("h", F.col("x1") - F.col("x0"))
    return p.select(
        "model", "x0", "x1", F.col("y0").alias("c0"), F.col("t0").alias("c1"),
        ((3 * F.col("m") - 2 * F.col("t0") - F.col("t1")) / F.col("h")).alias("c2"),
        ((F.col("t0") + F.col("t1") - 2 * F.col("m")) / (F.col("h") * F.col("h"))).alias("c3"),
    )


def to_capacity_factor(wind: DataFrame, segments: DataFrame, outside: str = "null") -> DataFrame:
    """wind (with model and ws) and its cf by the curve's segments.

    outside: null leaves speeds off the curve without a cf; clamp gives 0.0 below it and 1.0 above it. Each model's
    segments go along as one sorted array (a catalogue has some hundreds of curves of some tens of pieces), so the
    join is an equi-join on the model.
    """
    pieces = [c for c in ("x0", "x1", "c0", "c1", "c2", "c3") if c in segments.columns]
    packed = segments.groupBy("model").agg(F.sort_array(F.collect_list(F.struct(*pieces))).alias("_s"))
    df = wind.join(small(packed, MODELS), "model", "left")
    ws, low, high = F.col("ws"), F.element_at("_s", 1)["x0"], F.element_at("_s", -1)["x1"]
    piece = F.element_at(F.filter("_s", lambda s: (s["x0"] <= ws) & (ws <= s["x1"])), 1)
    df = df.withColumn("_p", F.when((ws >= low) & (ws <= high), piece))
    d = ws - F.col("_p.x0")
    cf = F.col("_p.c0") + d * F.col("_p.c1") if "c3" not in pieces else F.col("_p.c0") + d * (F.col("_p.c1") + d * (F.col("_p.c2") + d * F.col("_p.c3")))
    if outside == "clamp":
        cf = F.when(ws < low, F.lit(0.0)).when(ws > high, F.lit(1.0)).otherwise(cf)
    elif outside != "null":
        raise ValueError(f"unknown policy: {outside}")
    return df.withColumn("cf", cf).drop("_s", "_p")


def correct(wind: DataFrame, factors: DataFrame, resolution: str) -> DataFrame:
    """wind (time, cluster, ws, ...) with ws * scalar + offset of its cluster and slice; a missing factor gives null.

    Without a column cluster all is cluster 0. factors: (cluster, time_slice, scalar, offset); some thousand rows at most.
    """
    if "cluster" not in wind.columns:
        wind = wind.withColumn("cluster", F.lit(0))
    df = wind.withColumn("time_slice", slice_of(F.month("time"), resolution))
    joined = df.join(small(factors.select("cluster", "time_slice", "scalar", "offset")), ["cluster", "time_slice"], "left")
    return joined.withColumn("ws", F.col("ws") * F.col("scalar") + F.col("offset")).drop("scalar", "offset")


def simulate(reanalysis: DataFrame, turbines: DataFrame, curves: DataFrame, factors: DataFrame | None = None, resolution: str | None = None) -> DataFrame:
    """(time, ID, ws, cf) of each turbine, with bias correction if factors and their resolution are given."""
    if (factors is None) != (resolution is None):
        raise ValueError("factors and resolution go together")
    extra = [c for c in ("model", "capacity", "cluster") if c in turbines.columns]
    wind = wind_at(reanalysis, turbines).join(turbines.select("ID", *extra), "ID")
    if factors is not None:
        wind = correct(wind, factors, resolution)
    return to_capacity_factor(wind, akima_segments(curves)).select("time", "ID", "ws", "cf")


def aggregate_to_grid(turbines: DataFrame, reanalysis: DataFrame) -> DataFrame:
    """Turbines of one model, height (to 10 m, half-even) and nearest node as one, with their capacities' sum; null models stay.

    Of two equally near nodes the greater latitude and the smaller longitude count.
    """
    nodes = reanalysis.select("lat", "lon").distinct()
    axes = nodes.agg(F.sort_array(F.collect_set("lat"), asc=False).alias("_lats"), F.sort_array(F.collect_set("lon")).alias("_lons"))

    def near(axis: str, column: str):
        pairs = F.transform(axis, lambda x, i: F.struct(F.abs(x - F.col(column)).alias("d"), i.alias("i"), x.alias("x")))
        return F.array_min(pairs)["x"]

    placed = turbines.crossJoin(F.broadcast(axes)).withColumns({
        "_lat": near("_lats", "lat"), "_lon": near("_lons", "lon"), "_h": (F.bround(F.col("height") / 10, 0) * 10),
    })
    out = placed.groupBy("_lat", "_lon", "_h", "model").agg(F.sum("capacity").alias("capacity"))
    key = F.concat_ws("_", F.col("_lat").cast("string"), F.col("_lon").cast("string"), F.col("_h").cast("string"), F.coalesce("model", F.lit("none")))
    return out.select(key.alias("ID"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col("_h").alias("height"), "model", "capacity")


def country_series(cf: DataFrame, capacities: DataFrame, monthly: bool = True) -> DataFrame:
    """(time, cf): the capacity-weighted mean of turbines with a value, by day or as monthly means of the days."""
    daily = cf.join(capacities.select("ID", "capacity"), "ID").groupBy("time").agg(mean_over_present_weights(F.col("cf"), F.col("capacity")).alias("cf"))
    return daily if not monthly else daily.groupBy(F.last_day("time").alias("time")).agg(F.avg("cf").alias("cf"))


def default_model(curves: DataFrame) -> str | None:
    """The catalogue's first model."""
    row = curves.orderBy("ordinal", "model").select("model").first()
    return row["model"] if row else None


def simulate_country(reanalysis, turbines, curves, factors=None, resolution=None, monthly: bool = True) -> DataFrame:
    """(time, cf) of a country: turbines are put together by node first, and curves are linear, 0 below and 1 above."""
    cells = aggregate_to_grid(turbines, reanalysis)
    if (name := default_model(curves)) is not None:
        cells = cells.withColumn("model", F.coalesce("model", F.lit(name)))
    wind = wind_at(reanalysis, cells).join(cells.select("ID", "model"), "ID")
    if factors is not None:
        if resolution is None:
            raise ValueError("factors need a resolution")
        wind = correct(wind, factors, resolution)
    return country_series(to_capacity_factor(wind, linear_segments(curves), outside="clamp"), cells, monthly)
