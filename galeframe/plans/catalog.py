"""Queries that apply the library's operators to the driver's tables, with DuckDB SQL that states their results.

The tables stand in for wind data: customers and suppliers are turbines and control points (coordinates from their keys),
orders are observations, events are hourly measurements. Floats are rounded alike on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import scalars, timeslice
from galeframe.functions.aggregates import mean_over_present_weights, symmetric_range
from galeframe.operators import bias, columns, errors, geo, gridding, metadata, series, wind
from galeframe.sources import tables as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Doubles rounded half up; -0.0 becomes 0.0."""
    return df.withColumns({n: F.round(F.col(n), places) + 0.0 for n in names})


def points(spark, sf_dir, name: str, key: str, *more) -> DataFrame:
    """(ID, lon, lat): coordinates from the key by whole numbers, so that all engines agree."""
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("ID"), (5 + (k * 37 % 101) / 10.0).alias("lon"), (50 + (k * 53 % 71) / 10.0).alias("lat"), *more)


def gen_cf(spark, sf_dir) -> DataFrame:
    """(year, month, cluster, capacity, obs, sim) of order lines; an obs is missing for every tenth order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    l = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    price = F.col("l_extendedprice")
    obs = F.when(F.col("l_orderkey") % 10 != 0, price * (1 - F.col("l_discount")))
    return l.select("year", "month", (F.col("l_suppkey") % 4).cast("int").alias("cluster"), F.col("l_quantity").alias("capacity"), obs.alias("obs"), price.alias("sim"))


_GEN = """select year(o_orderdate) as year, month(o_orderdate) as month, cast(l_suppkey % 4 as integer) as cluster, l_quantity as capacity,
    case when l_orderkey % 10 <> 0 then l_extendedprice * (1 - l_discount) end as obs, l_extendedprice as sim
  from lineitem join orders on l_orderkey = o_orderkey"""
_SEASON = "case when month in (12, 1, 2) then 'winter' when month in (3, 4, 5) then 'spring' when month in (6, 7, 8) then 'summer' else 'autumn' end"
_SCALARS = f"""select year, {_SEASON} as time_slice, cluster, coalesce(sum(obs * capacity), 0) / sum(capacity) as obs, sum(sim * capacity) / sum(capacity) as sim
  from ({_GEN}) group by all"""


@query(f"select cast(year as integer) as year, time_slice, cluster, round(obs, 4) as obs, round(sim, 4) as sim, round(obs / sim, 6) as scalar from ({_SCALARS})")
def weighted_bias_by_season(spark, sf_dir):
    return rounded(rounded(bias.scalars(gen_cf(spark, sf_dir), "season"), "obs", "sim", places=4), "scalar")


@query(f"""with t as (select *, case when cluster = 3 and time_slice = 'winter' then 0 else obs / sim end as scalar, 0.25 * cluster as o from ({_SCALARS}))
select cluster, time_slice, round(coalesce(avg(nullif(scalar, 0)), 1), 6) as scalar, round(case when avg(nullif(scalar, 0)) is null then 0 else avg(o) end, 6) as "offset" from t group by 1, 2""")
def factors_mean_over_years(spark, sf_dir):
    t = bias.scalars(gen_cf(spark, sf_dir), "season")
    t = t.withColumn("scalar", F.when((F.col("cluster") == 3) & (F.col("time_slice") == "winter"), 0.0).otherwise(F.col("scalar")))
    return rounded(bias.factors(t.withColumn("offset", 0.25 * F.col("cluster"))), "scalar", "offset")


@query("select o_custkey as ID, cast(year(o_orderdate) as integer) as year, cast(ceil(month(o_orderdate) / 2.0) as integer) || '/6' as time_slice, round(avg(o_totalprice), 4) as obs, count(*) as n from orders group by all")
def period_mean_by_entity(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ID"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    g = o.groupBy("ID", "year", timeslice.slice_of(F.col("month"), "bimonth").alias("time_slice")).agg(F.avg("o_totalprice").alias("obs"), F.count("*").alias("n"))
    return rounded(g, "obs", places=4)


@query("""with m as (select month(o_orderdate) as m, o_totalprice as p from orders), s as (
  select 'fixed' as time_res, '1/1' as time_slice, p from m union all select 'bimonth', cast(ceil(m / 2.0) as integer) || '/6', p from m union all select 'month', cast(m as varchar), p from m
  union all select 'season', case when m in (12, 1, 2) then 'winter' when m < 6 then 'spring' when m < 9 then 'summer' else 'autumn' end, p from m)
select time_res, time_slice, count(*) as n, round(avg(p), 4) as mean from s group by 1, 2""")
def time_slices_all(spark, sf_dir):
    # Months are averaged first; the twelve rows then meet the slices of all resolutions.
    per = table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("c"))
    joined = per.join(F.broadcast(timeslice.dimension(spark)), "month")
    return rounded(joined.groupBy("time_res", "time_slice").agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("mean")), "mean", places=4)


@query("""with g as (select year(o_orderdate) as y, month(o_orderdate) as m, sum(o_totalprice) as kwh from orders group by 1, 2), t as (select sum((c_custkey % 40 + 10) * 100.0) as kw from customer)
select cast(y as integer) as year, cast(m as integer) as month, round(kwh / ((select kw from t) * 24 * day(last_day(make_date(y, m, 1)))), 9) as obs from g""")
def cf_from_generation(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("output_kwh"))
    kw = table(spark, sf_dir, "customer").select(((F.col("c_custkey") % 40 + 10) * 100.0).alias("capacity"))
    return rounded(bias.country_generation_to_cf(g, kw), "obs", places=9)


@query("""select o_custkey as ID, cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month,
  o_totalprice / (24 * day(last_day(o_orderdate)) * ((o_custkey % 40 + 10) * 100e0)) as obs from orders""")
def turbine_cf_from_generation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ID"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("obs"))
    kw = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"), ((F.col("c_custkey") % 40 + 10) * 100.0).alias("capacity"))
    return bias.generation_to_cf(o, kw)


def _resampled(unit: str):
    def f(spark, sf_dir):
        r = series.resample(table(spark, sf_dir, "events"), unit, ["user_id"], ["value"], "ts")
        return rounded(r.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "value")

    f.__name__ = {"day": "daily_mean", "hour": "hourly_mean", "month": "monthly_mean"}[unit]
    return query(f"select user_id, strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M:%S') as ts, round(avg(value), 6) as value from events group by 1, 2")(f)


for _unit in ("day", "hour", "month"):
    _resampled(_unit)


def _gappy(spark, sf_dir, expr: str):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(f"case when {expr} then value end").alias("value"))


@query("""select event_id, user_id, first_value(case when event_id % 3 <> 0 then value end ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as value from events""")
def backfill_value(spark, sf_dir):
    return series.backfill(_gappy(spark, sf_dir, "event_id % 3 <> 0"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "value")


@query("""with a as (select event_id, user_id, ts, case when event_id % 7 in (0, 1) then value end as v, row_number() over (partition by user_id order by ts, event_id) as i from events),
b as (select *, last_value(v ignore nulls) over back as p, first_value(v ignore nulls) over ahead as n, last_value(case when v is not null then i end ignore nulls) over back as pi,
  first_value(case when v is not null then i end ignore nulls) over ahead as ni from a
  window back as (partition by user_id order by i rows between unbounded preceding and current row), ahead as (partition by user_id order by i rows between current row and unbounded following))
select event_id, user_id, round(case when v is not null then v when least(coalesce(i - pi, 1000000000), coalesce(ni - i, 1000000000)) > 2 then null when p is null then n when n is null then p
  else p + (n - p) * (i - pi) / (ni - pi) end, 6) as value from b""")
def interpolate_limit(spark, sf_dir):
    g = _gappy(spark, sf_dir, "event_id % 7 in (0, 1)")
    return rounded(series.interpolate(g, ["user_id"], ["ts", "event_id"], "value", 2).select("event_id", "user_id", "value"), "value")


@query("""with y as (select o_custkey as ID, year(o_orderdate) as year, round(sum(o_totalprice), 2) as total from orders group by 1, 2)
select ID, cast(year as integer) as year, total from (select *, count(*) over (partition by ID) as c from y) where c = (select max(year) - min(year) + 1 from y)""")
def complete_periods(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ID"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return columns.complete_years(o)


def _monthly_cf(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cf = F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice") / 300000.0)
    return o.groupBy(F.col("o_custkey").alias("ID"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.max(cf).alias("obs"))


_MONTHLY = "select o_custkey as ID, year(o_orderdate) as year, month(o_orderdate) as month, max(case when o_orderkey % 11 = 0 then 0.0 else o_totalprice / 300000.0 end) as obs from orders group by all"


@query(f"""with m as ({_MONTHLY}), ok as (select ID, year from m group by 1, 2 having max(obs) <= 1 and min(obs) > 0.01 and coalesce(avg(nullif(obs, 0)), 1) > 0.01)
select m.ID, cast(m.year as integer) as year, cast(m.month as integer) as month, round(nullif(obs, 0), 9) as obs from m join ok using (ID, year)""")
def clean_observations(spark, sf_dir):
    wide = columns.clean_observations(columns.pivot_months(_monthly_cf(spark, sf_dir)), train=True, country="DK")
    return rounded(columns.melt_months(wide).where("obs is not null"), "obs", places=9)


@query(f"select ID, cast(year as integer) as year, {', '.join(f'round(max(case when month = {m} then obs end), 9) as obs_{m}' for m in range(1, 13))} from ({_MONTHLY}) group by 1, 2")
def long_to_wide(spark, sf_dir):
    return rounded(columns.pivot_months(_monthly_cf(spark, sf_dir)), *columns.month_names(), places=9)


@query(f"""with y as (select distinct ID, year from ({_MONTHLY})), m as ({_MONTHLY})
select y.ID, cast(y.year as integer) as year, cast(k as integer) as month, round(obs, 9) as obs from y cross join range(1, 13) t(k) left join m on m.ID = y.ID and m.year = y.year and m.month = k""")
def wide_to_long(spark, sf_dir):
    return rounded(columns.melt_months(columns.pivot_months(_monthly_cf(spark, sf_dir))), "obs", places=9)


@query("""with r as (select s_suppkey * 7 % 997 as k, min(s_suppkey) as s_suppkey from supplier group by 1), d as (
  select p_partkey, r.k, s_suppkey, abs(p_partkey * 3 % 1013 - r.k) as dist from part, r), b as (select *, row_number() over (partition by p_partkey order by dist, k) as n from d)
select p_partkey, cast(p_partkey * 3 % 1013 as double) as key, case when dist <= 5 then s_suppkey end as s_suppkey from b where n = 1""")
def nearest_asof_tolerance(spark, sf_dir):
    left = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 3 % 1013).cast("double").alias("key"))
    right = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7 % 997).alias("k"), "s_suppkey")
    return series.nearest_match(left, right, "key", "k", 5).select("p_partkey", "key", "s_suppkey")


@query()
def fuzzy_manufacturer(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return rounded(metadata.similar(p.select(F.lower("p_name")), p.select(F.lower("p_type"))), "ratio")


@query()
def model_assignment(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    models = p.select(F.col("p_brand").alias("manufacturer"), F.concat(F.lit("M"), F.col("p_partkey")).alias("model"), (200 + F.col("p_size") * 6.0).alias("p_density"))
    models = models.groupBy("manufacturer", "p_density").agg(F.min("model").alias("model"))
    t = points(spark, sf_dir, "part", "p_partkey", F.col("p_brand").alias("manufacturer"), (500 + F.col("p_size") * 60.0).alias("capacity"), F.lit(80.0).alias("diameter"), F.lit(100.0).alias("height"))
    return rounded(metadata.assign_models(t, models), "p_density")


def _reanalysis(spark, days: int = 3) -> DataFrame:
    """A daily grid of 0.5 degrees with winds and roughness from whole numbers."""
    i, j, t = (spark.range(n).select(F.col("id").alias(a)) for n, a in ((28, "i"), (18, "j"), (days, "t")))
    g = i.crossJoin(j).crossJoin(t)
    w = 6 + (F.col("i") * 7 + F.col("j") * 11 + F.col("t") * 5) % 23 / 4.0
    z = 0.01 * (1 + (F.col("i") + F.col("j") * 3) % 9)
    return g.select(F.expr("timestamp_ntz'2020-01-31 00:00:00' + make_dt_interval(cast(t as int))").alias("time"), (49.5 + F.col("j") * 0.5).alias("lat"), (4.0 + F.col("i") * 0.5).alias("lon"), w.alias("wnd100m"), z.alias("roughness"))


_GRID = """select timestamp '2020-01-31' + to_days(cast(t as integer)) as time, 49.5 + j * 0.5e0 as lat, 4.0 + i * 0.5e0 as lon, 6 + (i * 7 + j * 11 + t * 5) % 23 / 4e0 as wnd100m, 0.01e0 * (1 + (i + j * 3) % 9) as roughness
  from range(28) a(i), range(18) b(j), range(3) c(t)"""
_TURB = """select c_custkey as ID, 5 + (c_custkey * 37 % 101) / 10e0 as lon, 50 + (c_custkey * 53 % 71) / 10e0 as lat, 60e0 + c_custkey % 7 * 13 as height, 'M' || (c_nationkey % 3) as model,
  (c_custkey % 40 + 10) * 100e0 as capacity from customer"""
_STENCIL = f"""select ID, lat0 + dj * 0.5e0 as lat, lon0 + di * 0.5e0 as lon, (case when di = 1 then tx else 1 - tx end) * (case when dj = 1 then ty else 1 - ty end) as weight, height, model from (
  select *, (lon - lon0) / 0.5e0 as tx, (lat - lat0) / 0.5e0 as ty from (select *, 4 + floor((lon - 4) / 0.5e0) * 0.5e0 as lon0, 49.5 + floor((lat - 49.5) / 0.5e0) * 0.5e0 as lat0 from ({_TURB}))), range(2) a(di), range(2) b(dj)"""
_WIND = f"""select g.time, s.ID, s.model, sum(weight * (wnd100m * ln(height / roughness) / ln(100 / roughness))) as ws from ({_STENCIL}) s join ({_GRID}) g on g.lat = s.lat and g.lon = s.lon group by all"""


def _turbines(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return points(spark, sf_dir, "customer", "c_custkey", (60.0 + k % 7 * 13).alias("height"), F.concat(F.lit("M"), F.col("c_nationkey") % 3).alias("model"), ((k % 40 + 10) * 100.0).alias("capacity"))


@query(f"select strftime(time, '%Y-%m-%d') as day, ID, round(ws, 6) as ws from ({_WIND})")
def bilinear_stencil(spark, sf_dir):
    w = wind.wind_at(_reanalysis(spark), _turbines(spark, sf_dir))
    return rounded(w.select(F.date_format("time", "yyyy-MM-dd").alias("day"), "ID", "ws"), "ws")


@query("""select l_orderkey, l_linenumber, round((l_quantity / 4) * ln((40 + l_linenumber * 10e0) / greatest(l_discount, 1e-6)) / ln(100 / greatest(l_discount, 1e-6)), 6) as ws from lineitem""")
def log_profile(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    ws = scalars.log_profile(F.col("l_quantity") / 4, 40 + F.col("l_linenumber") * 10.0, F.col("l_discount"))
    return rounded(l.select("l_orderkey", "l_linenumber", ws.alias("ws")), "ws")


@query("""with w as (select l_orderkey, l_linenumber, l_quantity / 5 as w10, l_quantity / 5 * (1 + l_tax * 5) as w100 from lineitem), z as (
  select *, case when abs(w100 - w10) > 1e-4 then (w100 * ln(10) - w10 * ln(100)) / (w100 - w10) end as l from w)
select l_orderkey, l_linenumber, round(case when l < 0 then greatest(exp(least(greatest(l, ln(1e-6)), ln(2))), 1e-6) end, 9) as z0 from z""")
def roughness_from_two_heights(spark, sf_dir):
    w10 = F.col("l_quantity") / 5
    z = scalars.roughness(scalars.log_roughness(w10, w10 * (1 + F.col("l_tax") * 5)))
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", z.alias("z0")), "z0", places=9)


def _curves(spark) -> DataFrame:
    """Three curves with nodes at 0, 1, ..., 25 m/s: a cubic rise to rated power."""
    m, s = spark.range(3).select(F.col("id").alias("m")), spark.range(26).select(F.col("id").alias("s"))
    cf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow((F.col("s") - 3) / (8.0 + F.col("m")), F.lit(3.0))))
    return m.crossJoin(s).select(F.concat(F.lit("M"), "m").alias("model"), F.col("m").cast("int").alias("ordinal"), F.col("s").cast("double").alias("speed"), cf.alias("cf"))


_CURVE = "select 'M' || m as model, m, s, least(1e0, greatest(0e0, pow((s - 3) / (8e0 + m), 3))) as cf from range(3) a(m), range(26) b(s)"


@query(f"""with c as ({_CURVE}), w as (select l_orderkey, l_linenumber, 'M' || (l_suppkey % 3) as model, l_quantity / 1.7e0 - 1 as ws from lineitem)
select l_orderkey, l_linenumber, round(case when ws < 0 then 0 when ws > 25 then 1 else a.cf + (b.cf - a.cf) * (ws - a.s) end, 6) as cf from w
left join c a on a.model = w.model and a.s = least(24, floor(greatest(ws, 0))) left join c b on b.model = w.model and b.s = a.s + 1""")
def powercurve_linear(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    w = l.select("l_orderkey", "l_linenumber", F.concat(F.lit("M"), F.col("l_suppkey") % 3).alias("model"), (F.col("l_quantity") / 1.7 - 1).alias("ws"))
    return rounded(wind.to_capacity_factor(w, wind.linear_segments(_curves(spark)), "clamp").select("l_orderkey", "l_linenumber", "cf"), "cf")


_AKIMA = f"""c as ({_CURVE}), d as (select a.model, a.s as i, b.cf - a.cf as m, a.cf as y from c a join c b on a.model = b.model and b.s = a.s + 1),
e as (select model, i, m from d union all select model, -1, 2 * max(case when i = 0 then m end) - max(case when i = 1 then m end) from d group by 1
  union all select model, -2, 3 * max(case when i = 0 then m end) - 2 * max(case when i = 1 then m end) from d group by 1
  union all select model, 25, 2 * max(case when i = 24 then m end) - max(case when i = 23 then m end) from d group by 1
  union all select model, 26, 3 * max(case when i = 24 then m end) - 2 * max(case when i = 23 then m end) from d group by 1),
f as (select model, i, m as r, lag(m) over w as l, abs(lead(m) over w - m) as a, abs(lag(m) over w - lag(m, 2) over w) as b from e window w as (partition by model order by i)),
g as (select *, max(a + b) over (partition by model) as most from f where i between 0 and 25),
t as (select model, i, case when a + b <= 1e-9 * most then (l + r) / 2 else (a * l + b * r) / (a + b) end as t from g),
seg as (select d.model, d.i, y as c0, p.t as c1, 3 * m - 2 * p.t - q.t as c2, p.t + q.t - 2 * m as c3 from d join t p on p.model = d.model and p.i = d.i join t q on q.model = d.model and q.i = d.i + 1)"""


@query(f"""with {_AKIMA}, w as (select l_orderkey, l_linenumber, 'M' || (l_suppkey % 3) as model, l_quantity / 1.7e0 - 1 as ws from lineitem)
select l_orderkey, l_linenumber, round(case when ws between 0 and 25 then c0 + (ws - i) * (c1 + (ws - i) * (c2 + (ws - i) * c3)) end, 6) as cf from w left join seg on seg.model = w.model and i = least(24, floor(ws))""")
def powercurve_akima(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    w = l.select("l_orderkey", "l_linenumber", F.concat(F.lit("M"), F.col("l_suppkey") % 3).alias("model"), (F.col("l_quantity") / 1.7 - 1).alias("ws"))
    return rounded(wind.to_capacity_factor(w, wind.akima_segments(_curves(spark))).select("l_orderkey", "l_linenumber", "cf"), "cf")


def _factors(spark) -> DataFrame:
    """Factors of clusters 0 to 2 for each season; the fourth cluster has none."""
    f = timeslice.dimension(spark).where("time_res = 'season'").select("time_slice").distinct().crossJoin(spark.range(3).select(F.col("id").cast("int").alias("cluster")))
    return f.select("cluster", "time_slice", (0.9 + 0.1 * F.col("cluster")).alias("scalar"), (F.length("time_slice") / 10.0 - 0.5).alias("offset"))


@query(f"""with w as (select l_orderkey, l_linenumber, month(o_orderdate) as month, cast(l_suppkey % 4 as integer) as cluster, l_quantity / 2 as ws from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, cluster, {_SEASON} as time_slice, round(case when cluster < 3 then ws * (0.9 + 0.1 * cluster) + length({_SEASON}) / 10e0 - 0.5 end, 6) as ws from w""")
def apply_correction(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("time")), F.col("l_orderkey") == F.col("o_orderkey"))
    w = l.select("l_orderkey", "l_linenumber", "time", (F.col("l_suppkey") % 4).cast("int").alias("cluster"), (F.col("l_quantity") / 2).alias("ws"))
    return rounded(wind.correct(w, _factors(spark), "season").select("l_orderkey", "l_linenumber", "cluster", "time_slice", "ws"), "ws")


@query(f"""with {_AKIMA}, w as ({_WIND}) select strftime(time, '%Y-%m-%d') as day, ID, round(case when ws between 0 and 25 then c0 + (ws - i) * (c1 + (ws - i) * (c2 + (ws - i) * c3)) end, 6) as cf
from w left join seg on seg.model = w.model and i = least(24, floor(ws))""")
def simulate_turbines(spark, sf_dir):
    cf = wind.simulate(_reanalysis(spark), _turbines(spark, sf_dir), _curves(spark))
    return rounded(cf.select(F.date_format("time", "yyyy-MM-dd").alias("day"), "ID", "cf"), "cf")


@query(f"""with {_AKIMA}, w as ({_WIND}), sim as (select w.*, case when ws between 0 and 25 then c0 + (ws - i) * (c1 + (ws - i) * (c2 + (ws - i) * c3)) end as cf from w left join seg on seg.model = w.model and i = least(24, floor(ws)))
select strftime(time, '%Y-%m-%d') as day, round(sum(cf * capacity) / sum(case when cf is not null then capacity end), 6) as cf from sim join ({_TURB}) t on t.ID = sim.ID group by 1""")
def country_series(spark, sf_dir):
    t = _turbines(spark, sf_dir)
    cf = wind.country_series(wind.simulate(_reanalysis(spark), t, _curves(spark)), t, monthly=False)
    return rounded(cf.select(F.date_format("time", "yyyy-MM-dd").alias("day"), "cf"), "cf")


_CELLS = f"""select 4 + round_even((lon - 4) / 0.5e0, 0) * 0.5e0 as lon, 49.5 + round_even((lat - 49.5) / 0.5e0, 0) * 0.5e0 as lat, round_even(height / 10, 0) * 10 as height, model, capacity
  from (select * replace (round(lon + 0.001, 3) as lon, round(lat + 0.001, 3) as lat) from ({_TURB}))"""


@query(f"select round(lon, 1) as lon, round(lat, 1) as lat, height, model, sum(capacity) as capacity from ({_CELLS}) group by 1, 2, 3, 4")
def aggregate_to_grid(spark, sf_dir):
    t = _turbines(spark, sf_dir).withColumns({"lon": F.round(F.col("lon") + 0.001, 3), "lat": F.round(F.col("lat") + 0.001, 3)})
    return rounded(wind.aggregate_to_grid(t, _reanalysis(spark, 1)).select("lon", "lat", "height", "model", "capacity"), "lon", "lat", places=1)


@query(f"""with n as (select 4 + round_even((lon - 4) / 0.5e0, 0) * 0.5e0 as lon, 49.5 + round_even((lat - 49.5) / 0.5e0, 0) * 0.5e0 as lat, round_even(height / 10, 0) * 10 as height, model, sum(capacity) as capacity
  from ({_TURB}) group by all), c as ({_CURVE}),
w as (select g.time, n.model, n.capacity, wnd100m * ln(height / roughness) / ln(100 / roughness) as ws from n join ({_GRID}) g on g.lat = n.lat and g.lon = n.lon),
p as (select w.time, capacity, case when ws < 0 then 0 when ws > 25 then 1 else a.cf + (b.cf - a.cf) * (ws - a.s) end as cf from w left join c a on a.model = w.model and a.s = least(24, floor(greatest(ws, 0)))
  left join c b on b.model = w.model and b.s = a.s + 1)
select strftime(last_day(time), '%Y-%m-%d') as month_end, round(avg(cf), 6) as cf from (select time, sum(cf * capacity) / sum(case when cf is not null then capacity end) as cf from p group by 1) group by 1""")
def simulate_country(spark, sf_dir):
    s = wind.simulate_country(_reanalysis(spark), _turbines(spark, sf_dir), _curves(spark))
    return rounded(s.select(F.date_format("time", "yyyy-MM-dd").alias("month_end"), "cf"), "cf")


@query("""with h as (select user_id, ts, sqrt(value * value * 1.25e0) as w100, sqrt(pow(value * (0.5e0 + event_id % 6 / 10e0), 2) * 1.25e0) as w10 from events),
l as (select *, case when abs(w100 - w10) > 1e-4 then (w100 * ln(10) - w10 * ln(100)) / (w100 - w10) end as l from h),
f as (select *, first_value(case when l < 0 then l end ignore nulls) over (partition by user_id order by ts rows between current row and unbounded following) as k from l)
select user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, round(avg(w100), 6) as wnd100m, round(avg(case when k is not null then greatest(exp(least(greatest(k, ln(1e-6)), ln(2))), 1e-6) end), 4) as roughness from f group by 1, 2""")
def reanalysis_daily(spark, sf_dir):
    # Users stand for grid nodes; the 10 m wind is some share of that at 100 m, which tells the roughness.
    e, share = table(spark, sf_dir, "events"), 0.5 + F.col("event_id") % 6 / 10.0
    v = F.col("value")
    h = e.select(F.col("ts").alias("valid_time"), F.lit(55.0).alias("lat"), F.col("user_id").cast("double").alias("lon"), v.alias("u100"), (v / 2).alias("v100"), (v * share).alias("u10"), (v * share / 2).alias("v10"))
    r = wind.prepare_reanalysis(h)
    return rounded(r.select(F.col("lon").cast("long").alias("user_id"), F.date_format("time", "yyyy-MM-dd").alias("day"), "wnd100m", "roughness").withColumn("roughness", F.round("roughness", 4)), "wnd100m")


@query("""select user_id, strftime(date_trunc('day', timestamp '2020-01-01' + to_hours(cast(event_id as integer) % 8760)), '%Y-%m-%d') as day, round(avg(value), 6) as wnd from events where user_id between 7 and 16 group by 1, 2""")
def merra2_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 8760).alias("step"), F.col("user_id").cast("double").alias("longitude"), F.lit(55.0).alias("latitude"), F.col("value").alias("wnd"))
    r = sources.merra2_daily(e, 2020)
    return rounded(r.select(F.col("lon").cast("long").alias("user_id"), F.date_format("time", "yyyy-MM-dd").alias("day"), "wnd"), "wnd")


@query()
def kmeans_partition(spark, sf_dir):
    t = points(spark, sf_dir, "customer", "c_custkey")
    return bias.assign_clusters(bias.fit_clusters(t, 5, restarts=10), t).select("ID", "cluster")


@query()
def offset_solver(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    l = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    w = l.select("year", timeslice.slice_of(F.col("month"), "season").alias("time_slice"), (F.col("l_suppkey") % 4).cast("int").alias("cluster"), F.concat(F.lit("M"), F.col("l_suppkey") % 3).alias("model"), F.col("l_quantity").alias("capacity"), (4 + F.col("l_discount") * 80).alias("ws"))
    segments = wind.akima_segments(_curves(spark))
    sim = wind.to_capacity_factor(w, segments).groupBy("year", "time_slice", "cluster").agg(mean_over_present_weights(F.col("cf"), F.col("capacity")).alias("sim"))
    trained = sim.withColumn("obs", F.col("sim") * (0.8 + 0.1 * F.col("cluster"))).withColumn("scalar", F.col("obs") / F.col("sim"))
    return rounded(bias.offsets(trained, w, segments), "obs", "sim", "scalar", "offset", places=4)


def _merged(spark, sf_dir) -> DataFrame:
    """Customers as turbines: their mean order against a value from their key, by month."""
    m = _monthly_cf(spark, sf_dir).where("obs > 0")
    sim = m.select("ID", "year", "month", (F.col("obs") * (0.8 + F.col("ID") % 5 / 10.0)).alias("cf"))
    c = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(c.alias("ID"), ((c % 40 + 10) * 100.0).alias("capacity"), F.col("c_nationkey").alias("region"), F.when(c % 3 == 0, "yes").otherwise("no").alias("in_training"), (c % 4).cast("int").alias("cluster"))
    return errors.merged(sim, m, t, "region", "in_training", "cluster")


_MERGED = f"""select ID, year, month, obs as cf_obs, obs * (0.8e0 + ID % 5 / 10e0) as cf_sim, (ID % 40 + 10) * 100e0 as capacity, c_nationkey as region, case when ID % 3 = 0 then 'yes' else 'no' end as in_training,
  cast(ID % 4 as integer) as cluster from ({_MONTHLY}) join customer on c_custkey = ID where obs > 0"""


@query(f"""select round(sqrt(avg(d * d)), 6) as rmse, round(avg(abs(d)), 6) as mae, round(avg(d), 6) as mbe from (select sum(cf_sim * capacity) / sum(capacity) - sum(cf_obs * capacity) / sum(capacity) as d from ({_MERGED}) group by month)""")
def error_temporal(spark, sf_dir):
    return rounded(errors.error("temporal-focus", _merged(spark, sf_dir)), "rmse", "mae", "mbe")


_SPACE = "round(sqrt(sum(s * w) / sum(w)), 6) as rmse, round(sum(a * w) / sum(w), 6) as mae, round(sum(d * w) / sum(w), 6) as mbe"


@query(f"select {_SPACE} from (select d * d as s, abs(d) as a, d, w from (select avg(cf_sim) - avg(cf_obs) as d, avg(capacity) as w from ({_MERGED}) group by ID))")
def error_spatial(spark, sf_dir):
    return rounded(errors.error("spatial-focus", _merged(spark, sf_dir)), "rmse", "mae", "mbe")


@query(f"select {_SPACE} from (select avg((cf_sim - cf_obs) * (cf_sim - cf_obs)) as s, avg(abs(cf_sim - cf_obs)) as a, avg(cf_sim - cf_obs) as d, avg(capacity) as w from ({_MERGED}) group by ID)")
def error_total(spark, sf_dir):
    return rounded(errors.error("total", _merged(spark, sf_dir)), "rmse", "mae", "mbe")


@query(f"""select cast(month as integer) as month, case when grouping(in_training) = 1 then 'Both' else in_training end as in_training, round(sum(cf_sim * capacity) / sum(capacity) - sum(cf_obs * capacity) / sum(capacity), 6) as diff, count(*) as n
from ({_MERGED}) group by grouping sets ((month, in_training), (month))""")
def error_grouping_sets(spark, sf_dir):
    return rounded(errors.error("monthly-error", _merged(spark, sf_dir)), "diff")


@query(f"""with e as (select ID, region, in_training, avg(cf_sim) as s, avg(cf_obs) as o, avg(capacity) as w from ({_MERGED}) group by 1, 2, 3), g as (
  select region, in_training, grouping(in_training) as b, sum(s * w) / sum(w) as s, sum(o * w) / sum(w) as o, count(*) as n from e group by grouping sets ((region, in_training), (region)))
select region, case when b = 1 then 'Both' else in_training end as in_training, round(case when b = 1 then s - o else abs(s - o) / o * 100 end, 6) as diff, n, round(o, 6) as cf_obs, round(s, 6) as cf_sim from g""")
def error_regional(spark, sf_dir):
    return rounded(errors.error("regional-error", _merged(spark, sf_dir)), "diff", "cf_obs", "cf_sim")


@query(f"""select cluster, round(sum(s * w) / sum(w) - sum(o * w) / sum(w), 6) as diff, count(*) as n from (select ID, cluster, avg(cf_sim) as s, avg(cf_obs) as o, avg(capacity) as w from ({_MERGED}) group by 1, 2) group by 1""")
def error_cluster(spark, sf_dir):
    return rounded(errors.error("cluster-error", _merged(spark, sf_dir)), "diff")


@query("""select n_name, s_suppkey, round(t * share, 4) as output, round(share, 9) as share from (select n_name, count(*) as t from nation join customer on c_nationkey = n_nationkey group by 1)
cross join (select s_suppkey, (s_acctbal + 1000) / sum(s_acctbal + 1000) over () as share from supplier)""")
def prorata_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").count()
    n = table(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.col("count").alias("t"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") + 1000).alias("w"))
    return rounded(rounded(bias.prorata(s, n, "w", "t").select("n_name", "s_suppkey", F.col("t").alias("output"), "share"), "output", places=4), "share", places=9)


@query("""select lang, source, doc_id, n_chars from (select *, row_number() over (partition by lang, source order by case lang when 'de' then 0 when 'en' then 1 else 2 end, n_chars desc, doc_id) as n from documents) where n = 1""")
def dedup_priority(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    order = [F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).otherwise(2), F.desc("n_chars"), F.asc("doc_id")]
    return columns.latest_wins(d, ["lang", "source"], order)


@query("""with recursive c as (select c_custkey as ID, 5 + (c_custkey * 7919 % 10007) / 9000e0 as lon, 50 + (c_custkey * 104729 % 10009) / 9000e0 as lat, cast(c_custkey % 3 as integer) as priority from customer),
o as (select *, row_number() over (order by priority, ID) as i, radians(lon) * cos(radians(avg(lat) over ())) * 6371e0 as x, radians(lat) * 6371e0 as y from c),
g as (select 0 as i, [{'x': null::double, 'y': null::double, 'id': null::bigint}] as kept union all select g.i + 1,
  case when len([k for k in g.kept if pow(k.x - o.x, 2) + pow(k.y - o.y, 2) <= 0.0625e0]) > 0 then g.kept else list_append(g.kept, {'x': o.x, 'y': o.y, 'id': o.ID}) end from g join o on o.i = g.i + 1)
select c.* from c where ID in (select unnest([k.id for k in kept]) from (select kept from g order by i desc limit 1))""")
def greedy_spatial_dedup(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("ID"), (5 + (k * 7919 % 10007) / 9000.0).alias("lon"), (50 + (k * 104729 % 10009) / 9000.0).alias("lat"), (k % 3).cast("int").alias("priority"))
    return geo.thin_by_distance(p, 0.25)


@query("""with t as (select p_partkey as ID, case when p_size % 5 <> 0 then p_size / 10e0 end as mw, case when p_partkey % 4 <> 0 then p_size * 3e0 end as dia, case when p_partkey % 3 <> 0 then 50e0 + p_size end as h, case when p_partkey % 2 = 0 then 'onshore' else 'offshore' end as type from part),
c as (select ID, type, coalesce(mw, median(mw) over (partition by type)) as mw, dia, h from t), d as (select *, least(greatest(coalesce(dia, 35 * sqrt(mw)), 40), 260) as dd from c)
select ID, type, round(mw * 1000, 4) as capacity, round(dd, 6) as diameter, round(coalesce(h, dd * case type when 'onshore' then 1.1e0 else 0.9e0 end), 6) as height from d""")
def impute_metadata(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    t = table(spark, sf_dir, "part").select(
        k.alias("ID"), F.when(k % 2 == 0, "onshore").otherwise("offshore").alias("type"), F.when(s % 5 != 0, s / 10.0).alias("capacity"), F.when(k % 4 != 0, s * 3.0).alias("diameter"), F.when(k % 3 != 0, 50.0 + s).alias("height")
    )
    return rounded(rounded(metadata.impute(t), "capacity", places=4), "diameter", "height")


@query("""select o_orderkey, case substr(o_orderpriority, 1, 1) when '1' then 'offshore' when '2' then 'onshore' else lower(trim(o_orderpriority)) end as domain, cast(substr(o_orderpriority, 1, 1) as double) as num,
  o_totalprice / 1000 as mw, regexp_extract(trim(o_orderpriority), '^\\S+') as head, trim(o_orderpriority, '12345-') as bare from orders""")
def recode_and_parse(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    first = F.substring(p, 1, 1)
    return o.select(
        "o_orderkey", scalars.domain(F.when(first == "1", "sea").when(first == "2", "land").otherwise(p)).alias("domain"), scalars.extracted_number(first).alias("num"),
        scalars.capacity_mw(F.concat(F.col("o_totalprice").cast("decimal(18,6)").cast("string"), F.lit(" kW"))).alias("mw"), scalars.first_word(p).alias("head"), scalars.stripped(p, "12345-").alias("bare"),
    )


@query("""with p as (select p_partkey as k, p_size as s, 'B' || (p_partkey % 3) as maker from part), b as (select k, s, maker, unnest(range(k % 3)) as block from p),
r as (select k, block, t, s, case when block = 0 then maker end as maker from (select *, unnest(range(greatest(s % 4, 1))) as t from b))
select 'NO_' || k || '_blk_' || block || '_t_' || t as ID, round((s + block) / 10e0, 6) as capacity, 40e0 + k % 7 as diameter, 60 + k % 5 / 10e0 as lat, maker as manufacturer from r
union all select 'NO_' || k || '_plant', round(s * 1e0, 6), 40e0 + k % 7, 60 + k % 5 / 10e0, null from p where k % 3 = 0""")
def nested_expand(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    block = lambda i: F.struct((s % 4).cast("int").alias("AntallTurbiner"), ((s + i) * 100.0).alias("TurbinStorrelse_kW"), (F.concat(F.lit("B"), k % 3) if i == 0 else F.lit("")).alias("TurbinProdusent"))
    blocks = F.slice(F.array(block(0), block(1)), 1, (k % 3).cast("int"))
    p = table(spark, sf_dir, "part")
    plants = p.select(k.cast("string").alias("VindkraftAnleggId"), (s * 1.0).alias("InstallertEffekt_MW"), blocks.alias("Turbiner"))
    more = metadata.enrichment(p.select(k.alias("plant_id"), (60 + k % 5 / 10.0).alias("latitude"), F.lit(10.0).alias("longitude"), F.lit(90.0).alias("hub_height"), (40.0 + k % 7).alias("rotor_diameter")))
    return rounded(metadata.norwegian_turbines(plants, more).select("ID", "capacity", "diameter", "lat", "manufacturer"), "capacity")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority like '1%')")
def semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority like '1%')")
def anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


_C = "select c_custkey as ID, 5 + (c_custkey * 37 % 101) / 10e0 as lon, 50 + (c_custkey * 53 % 71) / 10e0 as lat, c_acctbal as value from customer"
_S = "select s_suppkey as ID, 5 + (s_suppkey * 37 % 101) / 10e0 as lon, 50 + (s_suppkey * 53 % 71) / 10e0 as lat, s_acctbal as value from supplier"


@query(f"select cast(floor(lon / 0.5e0) as bigint) as lon_bin, cast(floor(lat / 0.5e0) as bigint) as lat_bin, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat, round(avg(value), 4) as value from ({_C}) group by 1, 2")
def spatial_bin(spark, sf_dir):
    p = points(spark, sf_dir, "customer", "c_custkey", F.col("c_acctbal").alias("value"))
    return rounded(rounded(geo.spatial_bins(p, 0.5, ["value"]), "lon", "lat"), "value", places=4)


@query(f"""with p as ({_C}), o as (select floor(min(lat) / 2) * 2 as a, floor(min(lon) / 2) * 2 as b from p)
select ID, cast(floor((lat - a) / 2) as integer) as tile_i, cast(floor((lon - b) / 2) as integer) as tile_j, cast(floor((lat - a) / 2) as integer) || '_' || cast(floor((lon - b) / 2) as integer) as tile from p, o""")
def tile_assign(spark, sf_dir):
    return geo.tiles(points(spark, sf_dir, "customer", "c_custkey"), 2.0).select("ID", "tile_i", "tile_j", "tile")


_RINGS = [[[6.03, 51.02], [13.04, 50.51], [12.07, 55.53], [9.01, 53.04], [6.52, 56.01], [6.03, 51.02]], [[8.03, 51.52], [9.04, 51.51], [8.52, 52.53], [8.03, 51.52]]]
_EDGES = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for r in _RINGS for a, b in zip(r, r[1:]))


@query(f"""select ID, count(x1) % 2 = 1 as inside from ({_C}) p left join (values {_EDGES}) e(x1, y1, x2, y2) on (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 group by ID""")
def point_in_polygon(spark, sf_dir):
    edges = geo.polygon_edges(spark.createDataFrame([(0, _RINGS)], "region int, rings array<array<array<double>>>"))
    return geo.inside(points(spark, sf_dir, "customer", "c_custkey"), edges).select("ID", "inside")


_PAIRS = f"""select q.ID, c.value, c.lon, c.lat, 2 * 6371e0 * asin(sqrt(least(1, pow(sin(radians(c.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - q.lon) / 2), 2)))) as d
  from ({_C}) q, (select lon, lat, avg(value) as value from ({_S}) group by 1, 2) c"""
_NEAR = f"select * from (select *, row_number() over (partition by ID order by d, lon, lat) as n from ({_PAIRS})) where d <= 300"


@query(f"select q.ID, round(n.value, 4) as prediction from ({_C}) q left join ({_NEAR}) n on n.ID = q.ID and n.n = 1")
def nn_haversine(spark, sf_dir):
    s = points(spark, sf_dir, "supplier", "s_suppkey", F.col("s_acctbal").alias("value"))
    return rounded(gridding.nearest(points(spark, sf_dir, "customer", "c_custkey"), s, "value"), "prediction", places=4)


@query(f"""select q.ID, round(coalesce(max(case when d = 0 then n.value end), sum(n.value * pow(greatest(d, 1e-12), -2)) / sum(pow(greatest(d, 1e-12), -2))), 4) as prediction
from ({_C}) q left join ({_NEAR}) n on n.ID = q.ID and n.n <= 8 group by 1""")
def idw_haversine(spark, sf_dir):
    s = points(spark, sf_dir, "supplier", "s_suppkey", F.col("s_acctbal").alias("value"))
    return rounded(gridding.idw(points(spark, sf_dir, "customer", "c_custkey"), s, "value"), "prediction", places=4)


@query("""select y * 30 + x as ID, case when x < 20 and x >= 10 then x + y * 1e0 when x < 20 then x - y * 1e0 when x >= 10 then x + y * 1e0 end as prediction from range(30) a(x), range(20) b(y)""")
def grid_overlay(spark, sf_dir):
    g = gridding.target_grid(spark, list(range(30)), list(range(20))).withColumns({"onshore": F.col("lon") < 20, "offshore": F.col("lon") >= 10})
    on, off = g.select("ID", (F.col("lon") - F.col("lat")).alias("prediction")), g.select("ID", (F.col("lon") + F.col("lat")).alias("prediction"))
    return gridding.merge_surfaces(g, on, off).select("ID", "prediction")


def _controls(spark, sf_dir):
    k = F.col("c_custkey")
    return points(spark, sf_dir, "customer", "c_custkey", (0.8 + (k % 17) / 40.0).alias("scalar"), ((k % 9) / 10.0 - 0.4).alias("offset"), F.when(k % 4 == 0, "offshore").otherwise("onshore").alias("mode"))


@query()
def blocked_cv(spark, sf_dir):
    own = _controls(spark, sf_dir)
    scores = [gridding.cross_validate(own, mode, value, ["nearest", "idw"]) for mode in ("onshore", "offshore") for value in ("scalar", "offset")]
    return rounded(reduce(DataFrame.unionByName, scores), "mae", "rmse")


def _coarse(spark):
    return gridding.target_grid(spark, [5 + i / 2 for i in range(20)], [50 + i / 2 for i in range(14)])


@query()
def kriging_grid(spark, sf_dir):
    return rounded(gridding.kriging(_coarse(spark), _controls(spark, sf_dir), "scalar"), "prediction")


@query()
def rbf_grid(spark, sf_dir):
    return rounded(gridding.rbf(_coarse(spark), _controls(spark, sf_dir), "scalar"), "prediction")


@query("""select user_id, strftime(d, '%Y-%m-%d') as day, round(avg(value), 6) as value, count(value) as n from (select *, date_trunc('day', ts) as d, max(ts) over () as last from events)
where d + interval 2 day <= date_trunc('millisecond', last) group by 1, 2""")
def stream_daily_window(spark, sf_dir):
    """The events as a stream, drained to a table in the shared folder: the windows that the watermark has passed."""
    from galeframe.storage import shared_dir
    from galeframe.streaming import windows

    at = f"{shared_dir(spark)}/galeframe-stream-{uuid.uuid4().hex}"
    # Windows are those of UTC days, as ts has no zone.
    stream = windows.read_folder(spark, f"{sf_dir}/events.parq[u]et", table(spark, sf_dir, "events").schema)  # a pattern, as a stream's source is no single file
    w = windows.windowed_mean(stream, ["user_id"], "value", "ts")
    windows.drain(w, f"{at}/out", f"{at}/checkpoint")
    out = spark.read.schema(w.schema).parquet(f"{at}/out")
    return rounded(out.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "value", "n"), "value")


def _runs(spark, sf_dir) -> DataFrame:
    """Simulated months of two runs and of the uncorrected one: (num_clu, time_res, ID, year, month, cf)."""
    m = _monthly_cf(spark, sf_dir).where("obs > 0")
    parts = [m.select(F.lit(k).alias("num_clu"), F.lit(r).alias("time_res"), "ID", "year", "month", (F.col("obs") * (f + F.col("ID") % 5 / 10.0)).alias("cf")) for k, r, f in _RUNS]
    return reduce(DataFrame.unionByName, parts)


_RUNS = [(1, "uncorrected", 0.8), (1, "season", 0.9), (4, "month", 0.85)]
_RUNS_SQL = " union all ".join(f"select {k} as num_clu, '{r}' as time_res, ID, year, month, obs as cf_obs, obs * ({f}e0 + ID % 5 / 10e0) as cf_sim, (ID % 40 + 10) * 100e0 as capacity from ({_MONTHLY}) where obs > 0" for k, r, f in _RUNS)
_BY_RUN = f"select num_clu, time_res, {_SPACE} from (select num_clu, time_res, avg((cf_sim - cf_obs) * (cf_sim - cf_obs)) as s, avg(abs(cf_sim - cf_obs)) as a, avg(cf_sim - cf_obs) as d, avg(capacity) as w from ({_RUNS_SQL}) group by num_clu, time_res, ID) group by 1, 2"


def _scores(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(c.alias("ID"), ((c % 40 + 10) * 100.0).alias("capacity"))
    return rounded(errors.sweep("total", _runs(spark, sf_dir), _monthly_cf(spark, sf_dir).where("obs > 0"), t), "rmse", "mae", "mbe")


@query(_BY_RUN)
def error_sweep(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(f"select num_clu, time_res, unnest(['rmse', 'mae', 'mbe']) as metric, unnest([rmse, mae, mbe]) as value from ({_BY_RUN}) where time_res <> 'uncorrected'")
def error_plot_lines(spark, sf_dir):
    return errors.error_lines(_scores(spark, sf_dir))


@query(f"""select ID, min(in_training) as in_training, min(region) as region, min(cluster) as cluster, round(avg(cf_sim), 9) as cf_sim, round(avg(cf_obs), 9) as cf_obs, avg(capacity) as capacity, round(avg(cf_sim) - avg(cf_obs), 9) as diff,
  case when ID % 3 = 0 then 0 else round(2 * 6371e0 * asin(sqrt(least(1, pow(sin(radians(55 - (50 + (ID * 53 % 71) / 10e0)) / 2), 2) + cos(radians(50 + (ID * 53 % 71) / 10e0)) * cos(radians(55)) * pow(sin(radians(10 - (5 + (ID * 37 % 101) / 10e0)) / 2), 2)))), 6) end as distance_km
from ({_MERGED}) group by ID""")
def error_turbine(spark, sf_dir):
    """Each turbine's error beside its distance from the nearest turbine trained on, which here is one at (10, 55); those trained on are their own."""
    each = errors.error("turbine-error", _merged(spark, sf_dir))
    trained = spark.createDataFrame([(10.0, 55.0)], "lon double, lat double")
    out = errors.with_distance(each, points(spark, sf_dir, "customer", "c_custkey"), trained)
    return rounded(rounded(out, "distance_km"), "cf_sim", "cf_obs", "diff", places=9)


def _observed(spark, sf_dir) -> DataFrame:
    return columns.pivot_months(_monthly_cf(spark, sf_dir))


_CLEAN = f"""select m.ID, m.year, m.month, nullif(m.obs, 0) as obs from ({_MONTHLY}) m join (select ID, year from ({_MONTHLY}) group by 1, 2 having max(obs) <= 1 and coalesce(avg(nullif(obs, 0)), 1) > 0.01) using (ID, year)"""
_WHOLE = f"select ID from (select ID, count(distinct year) as n from ({_CLEAN}) group by 1) where n = (select max(year) - min(year) + 1 from ({_CLEAN}))"
_SIM = "select o_custkey as ID, year(o_orderdate) as year, month(o_orderdate) as month, avg(o_totalprice / 400000) as sim from orders group by all"
_SET = f"select s.ID, s.year, s.month, s.sim, c.obs from ({_SIM}) s left join ({_CLEAN}) c using (ID, year, month) where s.ID in ({_WHOLE})"


def _training(spark, sf_dir) -> DataFrame:
    cf = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time"), F.col("o_custkey").alias("ID"), (F.col("o_totalprice") / 400000).alias("cf"))
    return bias.training_set(cf, _observed(spark, sf_dir), points(spark, sf_dir, "customer", "c_custkey"), "DE")


@query(f"select ID, cast(year as integer) as year, cast(month as integer) as month, round(sim, 9) as sim, round(obs, 9) as obs from ({_SET})")
def training_set_turbines(spark, sf_dir):
    return rounded(_training(spark, sf_dir), "sim", "obs", places=9)


@query(f"""with e as (select ID, year, {_SEASON} as time_slice, avg(obs) as obs, avg(sim) as sim from ({_SET}) group by all),
g as (select year, time_slice, cast(ID % 4 as integer) as cluster, coalesce(sum(obs * (ID % 40 + 10)), 0) / sum(ID % 40 + 10) as obs, sum(sim * (ID % 40 + 10)) / sum(ID % 40 + 10) as sim from e group by all)
select cast(year as integer) as year, time_slice, cluster, round(obs, 6) as obs, round(sim, 6) as sim, round(obs / nullif(sim, 0), 6) as scalar from g""")
def training_set_clusters(spark, sf_dir):
    c = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(c.alias("ID"), (c % 4).cast("int").alias("cluster"), (c % 40 + 10).cast("double").alias("capacity"))
    return rounded(bias.clustered(_training(spark, sf_dir), t, "season"), "obs", "sim", "scalar")


@query("""with s as (select year(o_orderdate) as year, month(o_orderdate) as month, avg(o_totalprice) as sim from orders group by 1, 2), o as (select year(l_shipdate) as year, month(l_shipdate) as month, avg(l_extendedprice) as obs from lineitem group by 1, 2),
m as (select year, cast(ceil(month / 2.0) as integer) || '/6' as time_slice, avg(obs) as obs, avg(sim) as sim from s join o using (year, month) group by 1, 2)
select cast(year as integer) as year, time_slice, 0 as cluster, round(obs, 4) as obs, round(sim, 4) as sim, round(obs / sim, 6) as scalar, 0e0 as "offset" from m""")
def training_set_country(spark, sf_dir):
    by = lambda day: [F.year(day).alias("year"), F.month(day).alias("month")]
    sim = table(spark, sf_dir, "orders").groupBy(*by("o_orderdate")).agg(F.avg("o_totalprice").alias("sim"))
    obs = table(spark, sf_dir, "lineitem").groupBy(*by("l_shipdate")).agg(F.avg("l_extendedprice").alias("obs"))
    return rounded(rounded(bias.country_training_set(sim, obs, "bimonth"), "obs", "sim", places=4), "scalar")


@query(f"""with ok as (select ID from ({_MONTHLY}) where year = 1995 group by 1 having max(obs) <= 1 and coalesce(avg(nullif(obs, 0)), 1) > 0.01)
select ok.ID, 1995 as year, cast(k as integer) as month, round(nullif(obs, 0), 9) as obs from ok cross join range(1, 13) t(k) left join ({_MONTHLY}) m on m.ID = ok.ID and m.year = 1995 and m.month = k where ok.ID in (select c_custkey from customer where c_nationkey < 12)""")
def validation_set(spark, sf_dir):
    t = points(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_nationkey < 12")
    return rounded(bias.validation_set(_observed(spark, sf_dir), t, 1995)[0], "obs", places=9)


@query(f"""select cast(year as integer) as year, cast(month as integer) as month, round(sum(obs * (ID % 40 + 10)) / sum(ID % 40 + 10), 9) as cf from ({_MONTHLY}) where ID % 7 <> 0 group by 1, 2""")
def turbines_to_country(spark, sf_dir):
    c = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(c.alias("ID"), F.when(c % 7 != 0, c % 40 + 10).cast("double").alias("capacity"))
    return rounded(bias.turbines_to_country(_monthly_cf(spark, sf_dir).withColumnRenamed("obs", "cf"), t), "cf", places=9)


@query("select strftime(l_shipdate, '%Y') as mode, l_returnflag as value, l_linestatus as method, round(avg(l_discount), 9) as mae, round(avg(l_tax), 9) as rmse from lineitem group by all")
def cv_summary(spark, sf_dir):
    scores = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("mode"), F.col("l_returnflag").alias("value"), F.col("l_linestatus").alias("method"), F.col("l_discount").alias("mae"), F.col("l_tax").alias("rmse"))
    return rounded(gridding.summary(scores), "mae", "rmse", places=9)


@query(f"""with w as ({_WIND}), c as ({_CURVE}), s as (select w.*, case when ws < 0 then 0 when ws > 25 then 1 else a.cf + (b.cf - a.cf) * (ws - a.s) end as cf from w left join c a on a.model = w.model and a.s = least(24, floor(greatest(ws, 0))) left join c b on b.model = w.model and b.s = a.s + 1),
d as (select time, sum(cf * capacity) / sum(capacity) as cf from s join ({_TURB}) t on t.ID = s.ID group by 1)
select strftime(last_day(time), '%Y-%m-%d') as month_end, round(avg(cf), 6) as cf from d group by 1""")
def country_series_monthly(spark, sf_dir):
    t = _turbines(spark, sf_dir)
    w = wind.wind_at(_reanalysis(spark), t).join(t.select("ID", "model"), "ID")
    cf = wind.country_series(wind.to_capacity_factor(w, wind.linear_segments(_curves(spark)), "clamp"), t)
    return rounded(cf.select(F.date_format("time", "yyyy-MM-dd").alias("month_end"), "cf"), "cf")


@query("""select 'M0' as model""")
def default_curve(spark, sf_dir):
    return spark.createDataFrame([(wind.default_model(_curves(spark)),)], "model string")


@query(f"""select ID, case when count(x1) % 2 = 1 then 'onshore' else 'offshore' end as mode from (select * from ({_C}) where lon between 5.5 and 14.5 and lat between 50.2 and 56.8) p
left join (values {_EDGES}) e(x1, y1, x2, y2) on (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 group by ID""")
def control_domain(spark, sf_dir):
    """Controls by the area that holds each: the polygon with its hole first, then the box about it; those in neither go."""
    box = [[[5.5, 50.15], [14.55, 50.15], [14.55, 56.85], [5.5, 56.85], [5.5, 50.15]]]
    on, off = (geo.polygon_edges(spark.createDataFrame([(0, r)], "region int, rings array<array<array<double>>>")) for r in (_RINGS, box))
    p = columns.in_box(points(spark, sf_dir, "customer", "c_custkey"), (5.5, 14.5, 50.2, 56.8))
    return gridding.control_domain(p, on, off).select("ID", "mode")


@query("select c_custkey as ID, 5 + (c_custkey * 37 % 101) / 10e0 as lon, 50 + (c_custkey * 53 % 71) / 10e0 as lat from customer where 5 + (c_custkey * 37 % 101) / 10e0 between 7.55 and 13.55 and 50 + (c_custkey * 53 % 71) / 10e0 between 54.05 and 56.15")
def bounding_box(spark, sf_dir):
    return columns.in_box(points(spark, sf_dir, "customer", "c_custkey"), (7.55, 13.55, 54.05, 56.15))


@query("select s_suppkey as ID, s_acctbal * 1e0 as lon, 50e0 as lat from supplier where s_suppkey % 3 <> 0 and s_suppkey % 5 <> 0")
def finite_coordinates(spark, sf_dir):
    k = F.col("s_suppkey")
    lon = F.when(k % 3 == 0, "NaN").when(k % 5 == 0, "no number").otherwise(F.col("s_acctbal").cast("double").cast("string"))
    return columns.finite_points(table(spark, sf_dir, "supplier").select(k.alias("ID"), lon.alias("lon"), F.lit(50.0).alias("lat")))


@query("select c_custkey as ID, c_name as owner, cast(c_acctbal as double) as value, cast(null as varchar) as extra from customer")
def subset_and_schema(spark, sf_dir):
    own = columns.renamed(table(spark, sf_dir, "customer"), {"c_custkey": "ID", "c_name": "owner", "c_acctbal": "value"})
    return columns.conform(own, {"ID": "long", "owner": "string", "value": "double", "extra": "string"})


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 40 offset 10")
def positional_slice(spark, sf_dir):
    return columns.rows_between(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, 50)


@query("""with r as (select case r_regionkey when 0 then 'a' when 1 then 'b' else 'c' end as k, count(*) as nations, sum(n_nationkey) as keys from nation join region on n_regionkey = r_regionkey group by 1)
select 'nations' as name, cast(max(case when k = 'a' then nations end) as double) as a, cast(max(case when k = 'b' then nations end) as double) as b, cast(max(case when k = 'c' then nations end) as double) as c from r
union all select 'keys', max(case when k = 'a' then keys end), max(case when k = 'b' then keys end), max(case when k = 'c' then keys end) from r""")
def transpose(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.when(F.col("n_regionkey") == 0, "a").when(F.col("n_regionkey") == 1, "b").otherwise("c")
    return columns.transposed(n.groupBy(k.alias("k")).agg(F.count("*").alias("nations"), F.sum("n_nationkey").alias("keys")), "k", ["a", "b", "c"])


@query("""with a as (select o_orderkey as k, o_totalprice as u from orders where o_orderkey % 3 <> 0), b as (select o_orderkey as k, o_custkey + 2e0 as v from orders where o_orderkey % 5 <> 0)
select coalesce(a.k, b.k) as lat, u as u100, v as v100 from a full join b on a.k = b.k""")
def combine_variables(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time"), F.col("o_orderkey").alias("lat"), F.lit(1.0).alias("lon"), F.col("o_totalprice").alias("u100"), (F.col("o_custkey") + 2.0).alias("v100"))
    return sources.combined(o.where("lat % 3 <> 0").drop("v100"), o.where("lat % 5 <> 0").drop("u100")).select("lat", "u100", "v100")


@query("select l_orderkey, l_linenumber, round(l_extendedprice * 1000 / (pi() * pow((l_quantity + 20) / 2e0, 2)), 6) as p_density from lineitem")
def power_density(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return rounded(l.select("l_orderkey", "l_linenumber", scalars.specific_power(F.col("l_extendedprice"), F.col("l_quantity") + 20.0).alias("p_density")), "p_density")


@query("select strftime(m, '%Y-%m-%d') as month_start, count(o_orderkey) as n from (select unnest(generate_series(date '1992-01-01', date '1998-12-01', interval 1 month)) as m) left join orders on date_trunc('month', o_orderdate) = m group by 1")
def month_series(spark, sf_dir):
    m = timeslice.months_between(spark, "1992-01-01", "1998-12-01")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("month_start"))
    return m.join(o, "month_start", "left").groupBy(F.date_format("month_start", "yyyy-MM-dd").alias("month_start")).agg(F.count("o_orderkey").alias("n"))


@query("""select event_id, case when event_id % 3 <> 0 then value end as onshore, case when event_id % 4 <> 0 then value * 2 end as offshore,
  round(case when event_id % 12 = 0 then value * 5 else coalesce(case when event_id % 3 <> 0 then value end, 0) + coalesce(case when event_id % 4 <> 0 then value * 2 end, 0) end, 6) as total from events""")
def opsd_generation(spark, sf_dir):
    k, v = F.col("event_id"), F.col("value")
    e = table(spark, sf_dir, "events").select(
        k.cast("timestamp").alias("utc_timestamp"), F.when(k % 3 != 0, v).alias("DK_wind_onshore_generation_actual"), F.when(k % 4 != 0, v * 2).alias("DK_wind_offshore_generation"), (v * 5).alias("DK_wind_generation_actual"), v.alias("SE_wind_generation_actual")
    )
    h = sources.hourly_generation(e, "DK")
    return rounded(h.select(F.col("time").cast("long").alias("event_id"), "onshore", "offshore", "total"), "total")


@query("""select cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, round(sum(o_totalprice / 1000 * 1e6), 2) as output_kwh from orders where o_orderpriority <> '1-URGENT' and year(o_orderdate) between 1993 and 1996 group by 1, 2""")
def country_generation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    carrier = F.when(F.col("o_orderpriority") == "1-URGENT", "Solar").otherwise("Wind")
    g = o.select(carrier.alias("Standard international energy product classification (SIEC)"), F.date_format("o_orderdate", "yyyy-MM").alias("TIME_PERIOD"), (F.col("o_totalprice") / 1000).cast("string").alias("OBS_VALUE"), F.lit("DK").alias("geo"))
    return rounded(sources.country_generation(g, "dk", 1993, 1996), "output_kwh", places=2)


_PARTS = "select p_partkey as k, case when p_partkey % 11 <> 0 then p_size * 50e0 end as capacity, p_size * 2e0 as diameter, p_size - 1e0 as height, lower(split_part(p_name, ' ', 1)) as maker from part"


def _raw_turbines(spark, sf_dir, *more) -> DataFrame:
    """Parts under the German headers."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.lpad(k.cast("string"), 7, "1").alias("V1"), F.col("p_name").alias("Manufacturer"), F.when(k % 11 != 0, (s * 50.0).cast("string")).alias("kW"), (s * 2.0).alias("Rotor..m."), (s - 1.0).alias("Tower..m.")
    )


@query(f"""select lpad(cast(k as varchar), 7, '1') as ID, capacity, diameter, height, cast(substr(lpad(cast(k as varchar), 7, '1'), 1, 5) as integer) / 1e4 as lon, 51e0 as lat, 'onshore' as type from ({_PARTS})
where capacity is not null and height > 1 and cast(substr(lpad(cast(k as varchar), 7, '1'), 1, 5) as integer) % 2 = 1""")
def load_germany(spark, sf_dir):
    codes = spark.range(1, 100000, 2).select(F.col("id").alias("postcode"), (F.col("id") / 1e4).alias("lon"), F.lit(51.0).alias("lat"))
    return sources.load_turbines("de", _raw_turbines(spark, sf_dir), codes).select("ID", "capacity", "diameter", "height", "lon", "lat", "type")


@query(f"""select cast(k as varchar) as ID, capacity, diameter, height, maker as manufacturer, case when k % 2 = 0 then 'offshore' else 'onshore' end as type, 9e0 as lon from ({_PARTS}) where capacity is not null and height > 1""")
def load_denmark(spark, sf_dir):
    """All on UTM 32's own meridian, where the longitude is known without a projection."""
    k, s = F.col("p_partkey"), F.col("p_size")
    cells = {"ID": k, "manufacturer": F.col("p_name"), "capacity": F.when(k % 11 != 0, s * 50.0), "diameter": s * 2.0, "height": s - 1.0, "east": F.lit(500000.0), "north": 6000000.0 + k, "type": F.when(k % 2 == 0, "HAV").otherwise("LAND")}
    dk = table(spark, sf_dir, "part").select(*(cells[own].cast("string").alias(raw) for raw, own in sources.HEADERS["DK"].items()))
    return rounded(sources.load_turbines("DK", dk).select("ID", "capacity", "diameter", "height", "manufacturer", "type", "lon"), "lon")


@query(f"""select cast(k as varchar) as ID, capacity * 1000 as capacity, diameter, height, 2 + k % 9 / 10e0 as lon, 47e0 as lat from ({_PARTS}) where capacity is not null and height > 1 and k % 4 <> 0""")
def load_france(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    cells = {"ID": k, "capacity": F.when(k % 11 != 0, s * 50.0), "diameter": s * 2.0, "height": s - 1.0, "manufacturer": F.col("p_name"), "x": 2 + k % 9 / 10.0, "y": F.lit(47.0), "status": F.when(k % 4 == 0, "Refusé").otherwise("Autorisé")}
    fr = table(spark, sf_dir, "part").select(*(cells[own].alias(raw) for raw, own in sources.HEADERS["FR"].items()), F.lit(4326).alias("epsg"))
    return sources.load_turbines("FR", fr).select("ID", "capacity", "diameter", "height", "lon", "lat")


@query("""with m as (select o_custkey as ID, year(o_orderdate) as year, month(o_orderdate) as month, round(sum(o_totalprice), 2) as v from orders where year(o_orderdate) between 1993 and 1994 group by all)
select cast(ID as varchar) as ID, cast(year as integer) as year, """ + ", ".join(f"coalesce(max(case when month = {m} then v end), 0) as obs_{m}" for m in range(1, 13)) + " from m group by ID, year")
def observations_germany(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    long = o.groupBy(F.col("o_custkey").alias("ID"), F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month")).agg(F.round(F.sum("o_totalprice"), 2).alias("Output"))
    return sources.observations("DE", long, 1993, 1994)


@query("""with m as (select o_custkey as ID, year(o_orderdate) as year, month(o_orderdate) as month, sum(o_totalprice) as v from orders where year(o_orderdate) between 1993 and 1995 group by all), y as (select distinct ID, year from m),
t as (select c_custkey as ID, 1000e0 + c_custkey % 3 * 500 as kw, 'P' || (c_custkey % 3) as model from customer where c_custkey % 13 <> 0)
select cast(y.ID as varchar) as ID, cast(y.year as integer) as year, cast(k as integer) as month, round(coalesce(v, 0) / (24 * day(last_day(make_date(y.year, k, 1))) * kw), 9) as obs, model
from y join t on t.ID = y.ID cross join range(1, 13) r(k) left join m on m.ID = y.ID and m.year = y.year and m.month = k""")
def prepare_country_turbines(spark, sf_dir):
    """Turbines get the model of their maker with their own density; a maker stands for each of three models."""
    c = F.col("c_custkey")
    kw, kind = 1000.0 + c % 3 * 500, c % 3
    name = lambda k: F.element_at(F.array(*map(F.lit, ("aaaaaaaa", "qqqqqqqq", "zzzzzzzz"))), (k + 1).cast("int"))
    t = points(spark, sf_dir, "customer", "c_custkey", kw.alias("capacity"), F.lit(80.0).alias("diameter"), F.when(c % 13 != 0, 90.0).alias("height"), name(kind).alias("manufacturer"))
    models = spark.range(3).select(name(F.col("id")).alias("manufacturer"), F.concat(F.lit("P"), "id").alias("model"), scalars.specific_power(1000.0 + F.col("id") * 500, F.lit(80.0)).alias("p_density"))
    o = table(spark, sf_dir, "orders")
    long = o.groupBy(F.col("o_custkey").alias("ID"), F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month")).agg(F.sum("o_totalprice").alias("Output"))
    wide = sources.observations("DE", long, 1993, 1995)
    windows = sources.TRAINING_YEARS | {"DE": (1993, 1995)}
    obs, known = sources.prepare_country("DE", t, long, models, windows=windows)
    assert wide.columns == obs.columns
    return rounded(columns.melt_months(obs).join(known.select("ID", "model"), "ID"), "obs", places=9)


@query("""with t as (select case when p_partkey % 4 <> 0 then p_size * 1e0 end as c, case when p_partkey % 3 <> 0 then 1 end as d, case when p_partkey % 2 = 0 then 'onshore' when p_partkey % 5 = 0 then 'offshore' end as type from part)
select count(*) as rows, count(*) - count(c) as without_capacity, count(*) - count(d) as without_diameter, cast(0 as bigint) as without_height, count(*) filter (type = 'onshore') as onshore, count(*) filter (type = 'offshore') as offshore, min(c) / 1000 as least_mw, max(c) / 1000 as most_mw from t""")
def metadata_report(spark, sf_dir):
    k = F.col("p_partkey")
    return metadata.report(table(spark, sf_dir, "part").select(F.when(k % 4 != 0, F.col("p_size") * 1.0).alias("capacity"), F.when(k % 3 != 0, 1.0).alias("diameter"), F.lit(1.0).alias("height"), F.when(k % 2 == 0, "onshore").when(k % 5 == 0, "offshore").alias("type")))


@query("select 'BE_FLA_' || s_suppkey as ID, round(s_acctbal / 1000, 9) as capacity, 90e0 as diameter, 100e0 as height, 3e0 as lon, 51e0 as lat, 'onshore' as type from supplier")
def load_flanders(spark, sf_dir):
    k = F.col("s_suppkey")
    f = table(spark, sf_dir, "supplier").select(k.alias("fid"), F.lit("100").alias("ashoogte"), F.lit(90).alias("rotordiameter"), F.col("s_acctbal").cast("string").alias("vermogenmax"), F.lit(3.0).alias("lon"), F.lit(51.0).alias("lat"))
    return rounded(metadata.flanders(f).select("ID", "capacity", "diameter", "height", "lon", "lat", "type"), "capacity", places=9)


@query("""select 'OSM_' || case when p_partkey % 2 = 0 then 'node' else 'way' end || '_' || p_partkey as ID, p_size / 10e0 as capacity, case when p_partkey % 3 = 0 then p_size + 0.5e0 end as diameter, case when p_partkey % 2 = 0 then 4e0 else 5e0 end as lon, p_brand as manufacturer from part""")
def load_map_elements(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    power = F.when(k % 3 == 0, F.concat((s * 100).cast("string"), F.lit(" kW"))).when(k % 3 == 1, F.concat((s / 10).cast("string"), F.lit(" MW"))).otherwise((s / 10).cast("string"))
    tags = F.map_from_arrays(F.array(*map(F.lit, ("generator:output:electricity", "rotor:diameter", "brand"))), F.array(power, F.when(k % 3 == 0, F.concat(s.cast("string"), F.lit(",5 m"))).otherwise(""), F.col("p_brand")))
    e = table(spark, sf_dir, "part").select(F.when(k % 2 == 0, "node").otherwise("way").alias("type"), k.alias("id"), F.when(k % 2 == 0, 51.0).alias("lat"), F.when(k % 2 == 0, 4.0).alias("lon"), F.struct(F.lit(51.0).alias("lat"), F.lit(5.0).alias("lon")).alias("center"), tags.alias("tags"))
    return metadata.osm(e).select("ID", "capacity", "diameter", "lon", "manufacturer")


@query("select distinct cast(l_linenumber as integer) as num_clu, strftime(l_shipdate, '%Y-%m') as time_res from lineitem where (l_linenumber, strftime(l_shipdate, '%Y-%m')) not in (select l_linenumber, strftime(l_shipdate, '%Y-%m') from lineitem where l_returnflag = 'A' and l_quantity < 3)")
def runs_to_do(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    runs = l.select(F.col("l_linenumber").cast("int").alias("num_clu"), F.date_format("l_shipdate", "yyyy-MM").alias("time_res"), "l_returnflag", "l_quantity")
    return sources.missing_runs(runs.select("num_clu", "time_res").distinct(), runs.where("l_returnflag = 'A' and l_quantity < 3"))


@query("select l_linestatus, max(abs(l_tax - 1)) as scalar, case when max(abs(l_discount)) > 0 then max(abs(l_discount)) else 1 end as \"offset\" from lineitem group by 1")
def symmetric_limits(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_linestatus").agg(symmetric_range(F.col("l_tax"), 1.0).alias("scalar"), symmetric_range(F.col("l_discount"), 0.0).alias("offset"))
