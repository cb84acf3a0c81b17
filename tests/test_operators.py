"""Operators against closed forms and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galeframe.functions import aggregates, scalars, timeslice
from galeframe.operators import bias, columns, errors, geo, gridding, metadata, series, wind
from galeframe.plans.model import WindModel
from galeframe.sources import tables as sources
from galeframe.streaming import windows


def one(df, c):
    return df.select(c.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def single(spark):
    return spark.range(1)


def test_log_profile_at_100_m_is_the_speed_there(single):
    assert one(single, scalars.log_profile(F.lit(8.0), F.lit(100.0), F.lit(0.03))) == pytest.approx(8.0)
    assert one(single, scalars.log_profile(F.lit(8.0), F.lit(50.0), F.lit(100.0))) is None


def test_roughness_round_trip(single):
    z0, w100 = 0.05, 9.0
    w10 = w100 * math.log(10 / z0) / math.log(100 / z0)
    assert one(single, scalars.roughness(scalars.log_roughness(F.lit(w10), F.lit(w100)))) == pytest.approx(z0)
    assert one(single, scalars.roughness(scalars.log_roughness(F.lit(5.0), F.lit(5.0)))) is None


def test_utm_and_lambert(single):
    lon, lat = scalars.utm_to_lonlat(F.lit(500000.0), F.lit(0.0))
    assert (one(single, lon), one(single, lat)) == pytest.approx((9.0, 0.0))
    lon, lat = scalars.utm_to_lonlat(F.lit(691875.63), F.lit(6098907.83))
    assert (one(single, lon), one(single, lat)) == pytest.approx((12.0, 55.0), abs=1e-6)
    lon, lat = scalars.to_lonlat(F.lit(700000.0), F.lit(6600000.0), 2154)
    assert (one(single, lon), one(single, lat)) == pytest.approx((3.0, 46.5), abs=1e-6)
    with pytest.raises(ValueError):
        scalars.to_lonlat(F.lit(0.0), F.lit(0.0), 1234)


def test_text_to_numbers(single):
    for text, mw in (("3,5 MW", 3.5), ("2000 kW", 2.0), ("500000 W", 0.5), ("4", 4.0), ("none", None)):
        assert one(single, scalars.capacity_mw(F.lit(text))) == mw
    assert one(single, scalars.domain(F.lit(" Sea "))) == "offshore"
    assert one(single, scalars.number(F.lit("nan"))) is None


def test_slices(spark):
    d = {(r["time_res"], r["month"]): r["time_slice"] for r in timeslice.dimension(spark).collect()}
    assert len(d) == 48 and d["season", 12] == d["season", 1] == "winter" and d["bimonth", 12] == "6/6" and d["fixed", 7] == "1/1"
    with pytest.raises(ValueError):
        timeslice.slice_of(F.lit(1), "week")
    assert timeslice.months_between(spark, "2020-01-01", "2020-12-01").count() == 12


def test_two_null_policies(spark):
    df = spark.createDataFrame([(None, 3.0), (8.0, 1.0)], "v double, w double")
    assert one(df, aggregates.mean_over_all_weights(F.col("v"), F.col("w"))) == 2.0
    assert one(df, aggregates.mean_over_present_weights(F.col("v"), F.col("w"))) == 8.0
    none = df.where("v is null")
    assert one(none, aggregates.mean_over_all_weights(F.col("v"), F.col("w"))) == 0.0


def test_interpolate_as_documented(spark):
    values = [None, None, None, 1.0, None, 3.0, None, None, None, None, None, 9.0, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    got = [r["v"] for r in series.interpolate(df, ["k"], ["i"], "v", 2).orderBy("i").collect()]
    assert got == [None, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, None, 7.0, 8.0, 9.0, 9.0]


def test_nearest_match_against_brute_force(spark):
    rng = np.random.default_rng(3)
    l = pd.DataFrame({"id": range(300), "k": rng.integers(0, 500, 300).astype(float)})
    r = pd.DataFrame({"rk": rng.integers(0, 500, 60).astype(float), "name": [f"n{i}" for i in range(60)]})
    left = spark.createDataFrame(l).unionByName(spark.createDataFrame([(999, None)], "id long, k double"))
    got = {x["id"]: x["name"] for x in series.nearest_match(left, spark.createDataFrame(r), "k", "rk", 6).collect()}
    for i, k in l.itertuples(index=False):
        best = min(r.itertuples(index=False), key=lambda x: (abs(x.rk - k), x.rk, x.name))
        assert got[i] == (best.name if abs(best.rk - k) <= 6 else None)
    assert got[999] is None and len(got) == 301
    tie = series.nearest_match(spark.createDataFrame([(1.0,)], "k double"), spark.createDataFrame([(0.0,), (2.0,)], "rk double"), "k", "rk").first()
    assert tie["rk"] == 0.0
    empty = series.nearest_match(spark.createDataFrame([(1.0,)], "k double"), spark.createDataFrame([], "rk double"), "k", "rk").first()
    assert empty["rk"] is None


def plane(spark, hole=False):
    rows = [(pd.Timestamp("2020-01-01").to_pydatetime(), 50 + j * 1.0, 5 + i * 1.0, None if hole and i == j == 1 else 2.0 * (5 + i) + 3.0 * (50 + j), 0.1) for i in range(3) for j in range(3)]
    return spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, wnd100m double, roughness double")


def test_bilinear_reproduces_a_plane_in_and_beyond_the_grid(spark):
    at = [("in", 5.3, 50.8), ("edge", 7.0, 52.0), ("out", 8.5, 49.0)]
    t = spark.createDataFrame([(i, x, y, 100.0) for i, x, y in at], "ID string, lon double, lat double, height double")
    got = {r["ID"]: r["ws"] for r in wind.wind_at(plane(spark), t).collect()}
    for i, x, y in at:
        assert got[i] == pytest.approx(2 * x + 3 * y)
    assert {r["ID"]: r["ws"] for r in wind.wind_at(plane(spark, hole=True), t).collect()}["in"] is None


def test_akima_against_its_formula(spark):
    x = np.array([0, 1, 2, 4, 5, 7, 8, 9], float)
    y = np.array([0, 0, 0.1, 0.5, 0.9, 1, 1, 1])
    m = np.diff(y) / np.diff(x)
    e = np.r_[3 * m[0] - 2 * m[1], 2 * m[0] - m[1], m, 2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]
    a, b = np.abs(e[3:] - e[2:-1]), np.abs(e[1:-2] - e[:-3])
    t = np.where(a + b > 1e-9 * (a + b).max(), (a * e[1:-2] + b * e[2:-1]) / np.where(a + b == 0, 1, a + b), (e[1:-2] + e[2:-1]) / 2)
    c = spark.createDataFrame([("m", float(p), float(q)) for p, q in zip(x, y)], "model string, speed double, cf double")
    q = np.r_[np.linspace(-1, 10, 45), x]
    w = spark.createDataFrame([("m", float(v)) for v in q], "model string, ws double")
    got = {r["ws"]: r["cf"] for r in wind.to_capacity_factor(w, wind.akima_segments(c)).collect()}
    for v in q:
        if v < 0 or v > 9:
            assert got[v] is None
            continue
        i = min(np.searchsorted(x, v, side="right") - 1, len(x) - 2)
        h, d = x[i + 1] - x[i], v - x[i]
        want = y[i] + d * (t[i] + d * ((3 * m[i] - 2 * t[i] - t[i + 1]) / h + d * (t[i] + t[i + 1] - 2 * m[i]) / h**2))
        assert got[v] == pytest.approx(want, abs=1e-12)
    clamped = {r["ws"]: r["cf"] for r in wind.to_capacity_factor(w, wind.linear_segments(c), "clamp").collect()}
    assert clamped[-1.0] == 0.0 and clamped[10.0] == 1.0 and clamped[4.0] == 0.5


def test_two_node_curve(spark):
    c = spark.createDataFrame([("m", 0.0, 0.0), ("m", 10.0, 1.0)], "model string, speed double, cf double")
    w = spark.createDataFrame([("m", 5.0)], "model string, ws double")
    assert wind.to_capacity_factor(w, wind.akima_segments(c)).first()["cf"] == pytest.approx(0.5)


def test_solver():
    assert abs(bias.solve_offset(lambda o: (5 + o) / 10, 0.7, 0.5) - 2.0) < 0.05
    assert bias.solve_offset(lambda o: 0.5, 0.5, 0.5) == 0.0
    assert math.isnan(bias.solve_offset(lambda o: 0.0, 0.9, 0.1))
    assert math.isnan(bias.solve_offset(lambda o: float("nan"), 0.9, 0.1))
    assert bias.solve_offset(lambda o: 1.0, float("nan"), 0.5) == 0.0


def test_clusters_of_repeated_places(spark):
    """Each place once, weighted by its turbines: the centre of two groups lies where that of all rows does."""
    rows = [(50.0, 5.0)] * 9 + [(50.0, 6.0)] + [(56.0, 12.0)] * 3 + [(56.0, 13.0)] * 3
    t = spark.createDataFrame(rows, "lat double, lon double")
    model = bias.fit_clusters(t, 2)
    assert model.summary.predictions.count() == 4
    assert np.allclose(sorted(c.tolist() for c in model.clusterCenters()), [[50.0, 5.1], [56.0, 12.5]])
    assert bias.assign_clusters(model, t).count() == len(rows)


def test_factors_of_missing_groups(spark):
    t = spark.createDataFrame([(0, "1/1", 0.0, 2.0), (1, "1/1", 2.0, 1.0), (1, "1/1", 0.0, 3.0)], "cluster int, time_slice string, scalar double, offset double")
    got = {r["cluster"]: (r["scalar"], r["offset"]) for r in bias.factors(t).collect()}
    assert got == {0: (1.0, 0.0), 1: (2.0, 2.0)}


def test_country_generation_guards(spark):
    obs = spark.createDataFrame([(2020, 2, 1e6)], "year int, month int, output_kwh double")
    small = spark.createDataFrame([(5.0,)], "capacity double")
    with pytest.raises(ValueError):
        bias.country_generation_to_cf(obs, small)
    got = bias.country_generation_to_cf(obs, spark.createDataFrame([(20.0,)], "capacity double"), unit="MW").first()
    assert got["obs"] == pytest.approx(1e6 / (20_000 * 29 * 24))


def test_clean_observations(spark):
    names = columns.month_names()
    rows = [("high", 2020, *[1.2] + [0.5] * 11), ("low", 2020, *[0.01] * 12), ("zero", 2020, *[0.0] * 12), ("null", 2020, *[None] * 12), ("fine", 2020, *[0.0] + [0.4] * 11)]
    df = spark.createDataFrame(rows, "ID string, year int, " + ", ".join(f"{n} double" for n in names))
    assert {r["ID"] for r in columns.clean_observations(df).collect()} == {"zero", "null", "fine"}
    assert {r["ID"] for r in columns.clean_observations(df, train=True, country="DK").collect()} == {"null"}
    long = columns.melt_months(df.where("ID = 'fine'"))
    assert long.count() == 12 and columns.pivot_months(long).first().asDict() == df.where("ID = 'fine'").first().asDict()


def test_point_in_polygon_with_a_hole(spark):
    square = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]]
    edges = geo.polygon_edges(spark.createDataFrame([(0, square)], "region int, rings array<array<array<double>>>"))
    p = spark.createDataFrame([("in", 3.0, 3.0), ("hole", 1.5, 1.5), ("out", 5.0, 1.0), ("null", None, 1.0)], "ID string, lon double, lat double")
    assert {r["ID"]: r["inside"] for r in geo.inside(p, edges).collect()} == {"in": True, "hole": False, "out": False, "null": False}


def haversine(a, b):
    (x1, y1), (x2, y2) = np.radians(a), np.radians(b)
    return 2 * 6371 * np.arcsin(np.sqrt(np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2))


@pytest.mark.parametrize(("lat", "lon"), [(0, 0), (55, 0), (84, 0), (20, 180)])
def test_neighbours_against_brute_force(spark, lat, lon):
    rng = np.random.default_rng(lat)
    turn = lambda x: (x + lon + 180) % 360 - 180
    c = np.c_[turn(rng.uniform(-20, 20, 80)), rng.uniform(lat - 4, lat + 4, 80)]
    q = np.c_[turn(rng.uniform(-20, 20, 30)), rng.uniform(lat - 4, lat + 4, 30)]
    controls = spark.createDataFrame([(float(x), float(y), float(i)) for i, (x, y) in enumerate(c)], "lon double, lat double, value double")
    queries = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(q)], "ID int, lon double, lat double")
    got = geo.neighbours(queries, controls, 3, 250.0).toPandas()
    for i in range(30):
        d = np.array([haversine(q[i], p) for p in c])
        want = [float(j) for j in np.argsort(d)[:3] if d[j] <= 250]
        assert got[got.ID == i].sort_values("nth")["value"].tolist() == want


@pytest.mark.parametrize("km", [None, 60.0])
@pytest.mark.parametrize("most", [150, 500_000])
def test_neighbours_of_dense_controls(spark, monkeypatch, km, most):
    """Dense and sparse controls, in bands and in one tree: as by brute force, without a pair of each query and control within reach."""
    monkeypatch.setattr(geo, "TREE", most)
    rng = np.random.default_rng(7)
    c = np.r_[rng.normal([8, 52], 0.01, (400, 2)), rng.uniform([5, 50], [12, 56], (200, 2))]
    q = np.r_[rng.normal([8, 52], 0.01, (60, 2)), rng.uniform([4, 49], [13, 57], (60, 2)), c[:10], c[-10:]]
    controls = spark.createDataFrame([(float(x), float(y), float(i)) for i, (x, y) in enumerate(c)], "lon double, lat double, value double")
    queries = spark.createDataFrame([(i, *map(float, q[i % len(q)])) for i in range(2 * len(q))] + [(-1, None, 50.0)], "ID int, lon double, lat double")
    found = geo.neighbours(queries, controls, 5, km)
    got = found.orderBy("ID", "nth").toPandas().groupby("ID")["value"].apply(list).to_dict()
    for i in range(2 * len(q)):
        d = np.array([haversine(q[i % len(q)], p) for p in c])
        assert got.get(i, []) == [float(j) for j in np.argsort(d, kind="stable")[:5] if km is None or d[j] <= km]
    assert -1 not in got and gridding.nearest(queries, controls, "value", 60.0).where("ID = -1").first()["prediction"] is None
    assert "Join" not in geo.near_places(queries, controls, 5, km)._jdf.queryExecution().optimizedPlan().toString()


def test_greedy_thinning_against_brute_force(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"ID": range(120), "lon": 5 + rng.uniform(0, 0.05, 120), "lat": 52 + rng.uniform(0, 0.03, 120), "priority": rng.integers(0, 3, 120)})
    got = set(geo.thin_by_distance(spark.createDataFrame(p), 0.4).toPandas().ID)
    kept = []
    for r in p.sort_values(["priority", "ID"]).itertuples():
        at = lambda q: np.array([math.radians(q.lon) * math.cos(math.radians(p.lat.mean())), math.radians(q.lat)]) * 6371
        if all(((at(r) - at(k)) ** 2).sum() > 0.4**2 for k in kept):
            kept.append(r)
    assert got == {k.ID for k in kept}
    chain = spark.createDataFrame([("A", 0.0, 50.0, 0), ("B", 0.0, 50.0018, 0), ("C", 0.0, 50.0036, 0), ("N", None, None, 0)], "ID string, lon double, lat double, priority int")
    assert {r["ID"] for r in geo.thin_by_distance(chain, 0.25).collect()} == {"A", "C", "N"}


def test_thinning_in_many_tiles(spark, monkeypatch):
    """A chain in order and a cloud cross tiles of two distances; the choice is that of one pass in order. A row without an ID and a repeated row count as rows."""
    monkeypatch.setattr(geo, "TILE", 2)
    monkeypatch.setattr(geo, "STRIP", 1)
    rng = np.random.default_rng(1)
    chain = [(i, 5 + 0.003 * i, 50.0, 0) for i in range(60)]
    cloud = [(100 + i, 5 + float(x), 50 + float(y), int(p)) for i, (x, y, p) in enumerate(zip(rng.uniform(0, 0.1, 500), rng.uniform(0, 0.06, 500), rng.integers(1, 4, 500)))]
    rows = [*chain, *cloud, (900, 7.0, 50.0, 0), (900, 7.0, 50.0, 0), (None, 8.0, 50.0, None)]
    got = [r["ID"] for r in geo.thin_by_distance(spark.createDataFrame(rows, "ID int, lon double, lat double, priority int"), 0.3).collect()]
    scale, kept = np.cos(np.radians(np.mean([r[2] for r in rows]))), []
    for r in sorted(rows[:-1], key=lambda r: (r[3], r[0])):
        at = np.radians([r[1] * scale, r[2]]) * 6371
        if all(((at - b) ** 2).sum() > 0.3**2 for _, b in kept):
            kept.append((r[0], at))
    assert sorted(got, key=lambda i: (i is None, i or 0)) == [*sorted(i for i, _ in kept), None]


@pytest.fixture(scope="module")
def surface(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), float(y), float(4 + 0.1 * x - 0.05 * y), "onshore") for x, y in rng.uniform([5, 50], [12, 56], (60, 2))]
    return spark.createDataFrame(rows, "lon double, lat double, scalar double, mode string")


def test_surfaces_pass_through_their_controls(spark, surface):
    at = surface.limit(10).select(F.monotonically_increasing_id().alias("ID"), "lon", "lat", "scalar").toPandas()
    q = spark.createDataFrame(at[["ID", "lon", "lat"]])
    for method in gridding.METHODS:
        got = gridding.predict(method, q, surface, "scalar").toPandas().set_index("ID")["prediction"]
        assert np.allclose(got.loc[at.ID], at.scalar, atol=1e-6), method
    with pytest.raises(ValueError):
        gridding.predict("magic", q, surface, "scalar")


def test_thin_plate_reproduces_a_plane(spark, surface):
    g = gridding.target_grid(spark, [6.0, 8.5, 11.0], [51.0, 53.0, 55.0])
    got = gridding.rbf(g, surface, "scalar").join(g, "ID").toPandas()
    assert np.allclose(got.prediction, 4 + 0.1 * got.lon - 0.05 * got.lat, atol=1e-6)
    assert np.allclose(gridding.kriging(g, surface, "scalar").toPandas().sort_values("ID").prediction, got.sort_values("ID").prediction, atol=0.05)


def test_few_controls_give_nulls(spark, surface):
    g = gridding.target_grid(spark, [6.0], [51.0])
    for method in ("ok", "rbf"):
        assert gridding.predict(method, g, surface.limit(3), "scalar").first()["prediction"] is None
    assert gridding.nearest(g, surface.limit(0), "scalar").first()["prediction"] is None


def test_cross_validation(spark, surface):
    scores = gridding.cross_validate(surface, "onshore", "scalar", ["nearest", "idw"]).toPandas()
    assert len(scores) == 10 and scores.n_test.sum() == 120 and (scores.mae < 0.5).all()
    assert gridding.summary(spark.createDataFrame(scores)).count() == 2
    with pytest.raises(ValueError):
        gridding.cross_validate(surface, "offshore", "scalar", ["nearest"])


def test_cross_validation_reads_its_points_once(spark, surface):
    scores = gridding.cross_validate(surface.unionAll(surface), "onshore", "scalar", ["nearest", "idw"])
    files = scores.inputFiles()
    assert files and all("galeframe-folds" in f for f in files)
    once = gridding.cross_validate(surface, "onshore", "scalar", ["nearest", "idw"]).collect()
    assert sorted(map(str, scores.collect())) == sorted(map(str, once))


def test_export_has_identity_outside_the_areas(spark, surface):
    def box(a, b, c, d):
        return geo.polygon_edges(spark.createDataFrame([(0, [[[a, c], [b, c], [b, d], [a, d], [a, c]]])], "region int, rings array<array<array<double>>>"))

    controls = surface.withColumn("offset", F.lit(0.1)).drop("mode")
    out = gridding.export_grid(gridding.target_grid(spark, [6.0, 9.0, 20.0], [52.0, 54.0]), controls, box(5.0, 8.5, 50.0, 56.0), box(8.0, 12.0, 50.0, 56.0)).toPandas()
    far = out[out.x == 20]
    assert (far.scalar == 1).all() and (far.offset == 0).all() and out.scalar.notna().all() and len(out) == 6
    both = gridding.compare(gridding.target_grid(spark, [6.0, 9.0], [52.0]), controls, box(5.0, 8.5, 50.0, 56.0), box(8.0, 12.0, 50.0, 56.0))
    assert both.count() == 8


def test_impute_and_report(spark):
    df = spark.createDataFrame([("a", 4.0, None, None, "onshore"), ("b", None, None, None, "onshore"), ("c", None, 300.0, 90.0, "offshore")], "ID string, capacity double, diameter double, height double, type string")
    got = {r["ID"]: r for r in metadata.impute(df).collect()}
    assert set(got) == {"a", "b"} and got["a"]["capacity"] == 4000.0 and got["a"]["diameter"] == 70.0 and got["a"]["height"] == pytest.approx(77.0)
    assert metadata.report(df).first()["rows"] == 3


def test_norwegian_expansion(spark):
    kind = "VindkraftAnleggId string, InstallertEffekt_MW double, Turbiner array<struct<AntallTurbiner: int, TurbinStorrelse_kW: double, TurbinProdusent: string>>"
    plants = spark.createDataFrame([("1", 9.0, [(2, 3000.0, "V"), (0, None, "")]), ("2", 5.0, []), ("x", 1.0, [])], kind)
    e = metadata.enrichment(spark.createDataFrame([(1, 60.0, 6.0, 90.0, 110.0)], "plant_id int, lat double, lon double, hub_height double, rotor_diameter double"))
    got = {r["ID"]: r for r in metadata.norwegian_turbines(plants, e).collect()}
    assert set(got) == {"NO_1_blk_0_t_0", "NO_1_blk_0_t_1", "NO_1_blk_1_t_0", "NO_2_plant"}
    assert got["NO_1_blk_0_t_1"]["capacity"] == 3.0 and got["NO_1_blk_1_t_0"]["manufacturer"] is None and got["NO_2_plant"]["capacity"] == 5.0
    moved = metadata.norwegian_turbines(plants, e, jitter_km=1.0).where("ID like '%blk%'").toPandas()
    assert all(0 < haversine((r.lon, r.lat), (6.0, 60.0)) < 1.05 for r in moved.itertuples())


def test_belgium(spark):
    fl = spark.createDataFrame([(1, 100.0, 90.0, 2000.0, 3.0, 51.0)], "fid int, ashoogte double, rotordiameter double, vermogenmax double, lon double, lat double")
    off = spark.createDataFrame([("w1", 2.8, 51.6)], "Naam string, lon double, lat double")
    mapped = spark.createDataFrame(
        [("node", 5, 51.0001, 3.0, None, {}), ("way", 6, None, None, (50.5, 4.0), {"generator:output:electricity": "3 MW", "rotor:diameter": "101,5 m"}), ("way", 7, None, None, None, {})],
        "type string, id long, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>",
    )
    got = {r["ID"]: r for r in metadata.belgium(fl, off, mapped).collect()}
    assert set(got) == {"BE_FLA_1", "OSM_way_6"} and got["OSM_way_6"]["capacity"] == 3000.0 and got["OSM_way_6"]["diameter"] == 101.5


def test_assign_models(spark):
    models = spark.createDataFrame([("Vestas", "V90", 314.4), ("Siemens", "S1", 400.0), ("Siemens", "S2", 500.0)], "manufacturer string, model string, p_density double")
    rows = [("a", 2000.0, 90.0, 80.0, "vestas wind"), ("b", 2000.0, 79.0, 80.0, "unknownish"), ("c", 9000.0, 50.0, 80.0, "vestas"), ("d", 2000.0, 90.0, 0.5, "vestas")]
    t = spark.createDataFrame([(i, k, d, h, 5.0, 50.0, m) for i, k, d, h, m in rows], "ID string, capacity double, diameter double, height double, lon double, lat double, manufacturer string")
    got = {r["ID"]: r["model"] for r in metadata.assign_models(t, models).collect()}
    assert got == {"a": "V90", "b": "S1"}


def test_assign_models_beside_one_without_density(spark):
    models = spark.createDataFrame([("vestas", "V0", None), ("vestas", "V2", 314.0), ("vestas", "V1", 314.0), ("zzzz", "Q", 314.4)], "manufacturer string, model string, p_density double")
    t = spark.createDataFrame([(m, 2000.0, 90.0, 80.0, 5.0, 50.0, m) for m in ("vestas", "qqqq")], "ID string, capacity double, diameter double, height double, lon double, lat double, manufacturer string")
    found = metadata.assign_models(t, models)
    assert {r["ID"]: r["model"] for r in found.collect()} == {"vestas": "V1", "qqqq": "Q"}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_loaders(spark, tmp_path):
    dk = spark.createDataFrame([("570", "VESTAS Wind", "2000", "90", "80", "500000", "6100000", "HAV")], "ID string, manufacturer string, capacity string, diameter string, height string, east string, north string, type string")
    r = sources.load_turbines("DK", dk).first()
    assert r["lon"] == pytest.approx(9.0) and r["type"] == "offshore" and r["manufacturer"] == "vestas"
    fr = spark.createDataFrame([("1", "Autorisé", 2.0, 90.0, 80.0, "x", 3.0, 46.5, 4326), ("2", "Autorisé", 2.0, 90.0, 80.0, "x", 700000.0, 6600000.0, 2154), ("3", "Refusé", 2.0, 90.0, 80.0, "x", 3.0, 46.0, 4326)], "ID string, status string, capacity double, diameter double, height double, manufacturer string, x double, y double, epsg int")
    got = {r["ID"]: (r["lon"], r["lat"], r["capacity"]) for r in sources.load_turbines("FR", fr).collect()}
    assert set(got) == {"1", "2"} and got["2"] == pytest.approx((3.0, 46.5, 2000.0), abs=1e-6)
    de = spark.createDataFrame([("12345678", "x", 2.0, 1.0, 90.0)], "ID string, manufacturer string, capacity double, diameter double, height double")
    assert sources.load_turbines("DE", de, spark.createDataFrame([("12345", 9.0, 52.0)], "postcode string, lon double, lat double")).first()["lat"] == 52.0
    with pytest.raises(ValueError):
        sources.load_turbines("XX", dk)
    gen = spark.createDataFrame([("Wind", "2020-01", "1.5", "DK"), ("Solar", "2020-01", "9", "DK")], "siec string, TIME_PERIOD string, OBS_VALUE string, geo string")
    assert sources.country_generation(gen, "DK", 2019, 2021).first()["output_kwh"] == 1.5e6
    with pytest.raises(ValueError):
        sources.country_generation(gen, "FR", 2019, 2021)
    low = dk.withColumn("height", F.lit("1"))
    with pytest.raises(ValueError):
        sources.load_turbines("DK", low)
    (tmp_path / "p.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"a","kw":2},"geometry":{"type":"Point","coordinates":[4.5,52.5]}},{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}}]}')
    assert [tuple(r) for r in sources.points(spark, str(tmp_path / "p.geojson"), "id", "kw").collect()] == [("a", "2", 4.5, 52.5)]
    assert sources.training_years("dk") == (2015, 2019) and sources.training_years("BE") == (2015, 2018) and sources.training_years("BE", 2020, train=False) == (2020, 2020)
    (tmp_path / "r.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6],[5,5]]]]}}]}')
    assert geo.polygon_edges(sources.rings(spark, str(tmp_path / "r.geojson"))).count() == 6


def test_run_names():
    assert sources.run_name("DK") == "DK-onshore-obs_turbine-corrected"
    assert sources.run_name("DK", add_nan=0.1, calc_z0=True) == "DK-onshore-obs_turbine-r0.1-calc_z0"
    assert sources.run_name("DK", corrected=False) == "DK-uncorrected"


def test_reanalysis_daily_means(spark):
    rows = [((pd.Timestamp("2020-01-01") + pd.Timedelta(hours=h)).to_pydatetime(), 55.0, 9.0, 6.0 + h % 3, 0.0, 4.0, 0.0) for h in range(48)]
    raw = spark.createDataFrame(rows, "valid_time timestamp_ntz, lat double, lon double, u100 double, v100 double, u10 double, v10 double")
    got = wind.prepare_reanalysis(raw, "DK").toPandas()
    assert len(got) == 2 and np.allclose(got.wnd100m, 7.0) and got.roughness.between(1e-6, 2).all()
    assert wind.prepare_reanalysis(raw, "UK").count() == 0
    flat = raw.withColumn("fsr", F.lit(0.2))
    assert wind.prepare_reanalysis(flat, "DK", from_two_heights=False).first()["roughness"] == pytest.approx(0.2)


def test_whole_model(spark, tmp_path):
    rng = np.random.default_rng(1)
    days = pd.date_range("2019-01-01", "2020-12-31", freq="7D")
    rows = [(t.to_pydatetime(), 50 + j * 1.0, 5 + i * 1.0, float(7 + 2 * math.sin(k) + 0.3 * i + rng.normal(0, 0.2)), 0.05) for k, t in enumerate(days) for i in range(3) for j in range(3)]
    re = spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, wnd100m double, roughness double").cache()
    turb = spark.createDataFrame([(f"t{i}", "onshore", 2000.0 + i * 100, 5.2 + i * 0.4, 50.2 + i * 0.4, 90.0, "m") for i in range(4)], "ID string, type string, capacity double, lon double, lat double, height double, model string")
    curve = spark.createDataFrame([("m", 0, float(s), min(1.0, max(0.0, ((s - 3) / 9) ** 3))) for s in range(31)], "model string, ordinal int, speed double, cf double")
    months = ", ".join(f"obs_{m} double" for m in range(1, 13))
    obs = spark.createDataFrame([(f"t{i}", y, *[0.25 + 0.02 * i + 0.01 * (m % 3) for m in range(12)]) for i in range(4) for y in (2019, 2020)], f"ID string, year int, {months}")
    model = WindModel("DE", str(tmp_path), clusters=(1, 2), resolutions=("fixed", "season"))
    f = model.train(re, turb, curve, obs)
    assert f.groupBy("num_clu", "time_res").count().count() == 4 and f.where("scalar is null").count() == 0
    assert model.train(re, turb, curve, obs).count() == f.count()
    cf = model.simulate(re, turb, curve, 2020)
    assert cf.select("num_clu", "time_res").distinct().count() == 5
    s = model.score(obs, turb, 2020).toPandas()
    assert len(s) == 15
    total = s[s["mode"] == "total"].set_index("time_res")["mae"]
    assert total.loc["fixed"].max() < total.loc["uncorrected"]
    assert errors.error_lines(spark.createDataFrame(s.drop(columns="mode"))).count() == 36
    country = WindModel("DE", str(tmp_path), level="country", resolutions=("fixed",))
    c_obs = spark.createDataFrame([(y, m, 0.3) for y in (2019, 2020) for m in range(1, 13)], "year int, month int, obs double")
    got = country.train(re, turb, curve, c_obs).first()
    assert got["cluster"] == 0 and got["offset"] == 0.0 and got["scalar"] > 0


def test_stream_equals_batch(spark, tmp_path, tables):
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.parquet").symlink_to(f"{tables}/events.parquet")
    stream = windows.windowed_mean(windows.read_folder(spark, str(tmp_path / "in"), kind), ["user_id"], "value", "ts")
    windows.drain(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r["start"], r["user_id"]): round(r["value"], 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = windows.windowed_mean(spark.read.parquet(f"{tables}/events.parquet"), ["user_id"], "value", "ts")
    want = {(r["start"], r["user_id"]): round(r["value"], 9) for r in batch.collect()}
    assert len(got) > 0.8 * len(want) and all(want[k] == v for k, v in got.items())
