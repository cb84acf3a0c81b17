"""Turbine metadata: normalising, imputing, expanding and matching with models."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions.scalars import capacity_mw, clip, extracted_number, number, specific_power
from galeframe.operators.columns import conform, numeric, pick, require
from galeframe.operators.geo import thin_by_distance
from galeframe.storage import small

SCHEMA = {
    "ID": "string", "capacity": "double", "diameter": "double", "height": "double", "manufacturer": "string", "lon": "double", "lat": "double", "type": "string",
}

NUMBERS = ("lon", "lat", "height", "diameter", "capacity")


def standardise(df: DataFrame) -> DataFrame:
    """df with string IDs, numbers as numbers and a type (onshore by default), without heights of 1 m or less or none. No row left is an error."""
    require(df, "ID", "height")
    out = numeric(df, "capacity", "height", "diameter", "lon", "lat").withColumn("ID", F.col("ID").cast("string"))
    out = out.withColumn("type", F.coalesce(pick(df, "type"), F.lit("onshore"))).where("height > 1")
    if out.isEmpty():
        raise ValueError("no turbine has a hub height above 1 m")
    return out


def impute(df: DataFrame, drop_without_capacity: bool = True) -> DataFrame:
    """Metadata in MW to kW: capacity by the type's median, diameter by 35 sqrt(MW) within 40 to 260 m, height by 1.1 or 0.9 diameters."""
    df = numeric(df, "capacity", "diameter", "height")
    medians = df.groupBy("type").agg(F.median("capacity").alias("_median"))
    out = df.join(F.broadcast(medians), "type", "left").withColumn("capacity", F.coalesce("capacity", "_median")).drop("_median")
    out = out.withColumn("diameter", clip(F.coalesce("diameter", 35.0 * F.sqrt("capacity")), 40.0, 260.0))
    times = F.when(F.col("type") == "onshore", 1.1).when(F.col("type") == "offshore", 0.9)
    out = out.withColumn("height", F.coalesce("height", times * F.col("diameter")))
    if drop_without_capacity:
        out = out.where("capacity is not null")
    return out.withColumn("capacity", F.col("capacity") * 1000.0).select(*df.columns)


def report(df: DataFrame) -> DataFrame:
    """(rows, without capacity, diameter and height, onshore, offshore, least and greatest MW): one row."""
    gaps = [F.count_if(F.col(c).isNull()).alias(f"without_{c}") for c in ("capacity", "diameter", "height")]
    kinds = [F.count_if(F.col("type") == t).alias(t) for t in ("onshore", "offshore")]
    return df.agg(F.count("*").alias("rows"), *gaps, *kinds, (F.min("capacity") / 1000).alias("least_mw"), (F.max("capacity") / 1000).alias("most_mw"))


def flanders(df: DataFrame) -> DataFrame:
    """Flemish turbines (fid, ashoogte, rotordiameter, vermogenmax in kW, lon, lat) in MW."""
    return conform(df.select(
        F.concat(F.lit("BE_FLA_"), F.col("fid").cast("string")).alias("ID"), (number(F.col("vermogenmax")) / 1000.0).alias("capacity"), number(F.col("rotordiameter")).alias("diameter"),
        number(F.col("ashoogte")).alias("height"), number(F.col("lon")).alias("lon"), number(F.col("lat")).alias("lat"), F.lit("onshore").alias("type"),
    ), SCHEMA)


def belgian_offshore(df: DataFrame) -> DataFrame:
    """Offshore points with whatever id column they have; one without gets a number by its place."""
    found = next((c for name in "id fid objectid uuid name naam gml_id".split() for c in df.columns if c.lower() == name), None)
    own = F.col(found).cast("string") if found else F.concat(F.lit("BE_OFF_"), F.hex(F.xxhash64("lon", "lat")))
    return conform(df.select(own.alias("ID"), number(F.col("lon")).alias("lon"), number(F.col("lat")).alias("lat"), F.lit("offshore").alias("type")), SCHEMA)


def osm(df: DataFrame) -> DataFrame:
    """Map elements (type, id, lat, lon, center, tags map) with coordinates, as turbines in MW."""
    names = dict(df.dtypes)

    def tag(*keys):
        return F.nullif(F.coalesce(*(F.element_at("tags", k) for k in keys)), F.lit(""))

    node = F.col("type") == "node"
    centre = (F.col("center.lon"), F.col("center.lat")) if "center" in names else (F.lit(None), F.lit(None))
    lon, lat = (F.when(node, F.col(c)).otherwise(x).cast("double") for c, x in zip(("lon", "lat"), centre))
    return conform(df.select(
        F.concat(F.lit("OSM_"), F.col("type"), F.lit("_"), F.col("id").cast("string")).alias("ID"), capacity_mw(tag("generator:output:electricity")).alias("capacity"),
        extracted_number(tag("rotor:diameter", "rotor_diameter")).alias("diameter"), extracted_number(tag("hub_height", "height")).alias("height"),
        tag("manufacturer", "brand").alias("manufacturer"), lon.alias("lon"), lat.alias("lat"), F.lit("onshore").alias("type"),
    ).where("lon is not null and lat is not null"), SCHEMA)


def belgium(flemish: DataFrame, offshore: DataFrame, mapped: DataFrame, km: float = 0.25) -> DataFrame:
    """All Belgian sources in one, thinned to one turbine within km (Flemish before offshore before mapped), imputed, in kW."""
    parts = [p.withColumn("priority", F.lit(i)) for i, p in enumerate((flanders(flemish), belgian_offshore(offshore), osm(mapped)))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return impute(thin_by_distance(union, km).drop("priority"))


def enrichment(df: DataFrame) -> DataFrame:
    """(plant, lat, lon, avg_hub_height, avg_rotor_diameter), one row a plant, from the names that the sources use."""
    def first(*names):
        return number(pick(df, *names))

    out = df.select(
        pick(df, "VindkraftAnleggId", "plant_id", "plantId", "id").cast("long").alias("plant"), first("lat", "latitude").alias("lat"), first("lon", "longitude", "lng").alias("lon"),
        first("avg_hub_height", "hub_height", "avgHubHeight").alias("avg_hub_height"), first("avg_rotor_diameter", "rotor_diameter", "avgRotorDiameter").alias("avg_rotor_diameter"),
    )
    return out.where("plant is not null").groupBy("plant").agg(F.min(F.struct("lat", "lon", "avg_hub_height", "avg_rotor_diameter")).alias("_e")).select("plant", "_e.*")


def norwegian_turbines(plants: DataFrame, enriched: DataFrame, jitter_km: float = 0.0, seed: int = 0) -> DataFrame:
    """One row for each turbine of each block of each plant, at the plant's place, in MW; a plant without blocks is one row.

    plants: (VindkraftAnleggId, InstallertEffekt_MW, Turbiner array<struct<AntallTurbiner, TurbinStorrelse_kW, TurbinProdusent>>). A block of no
    turbines counts as one. jitter moves each within a disc, by a hash of its ID and the seed.
    """
    base = plants.select(F.col("VindkraftAnleggId").try_cast("long").alias("plant"), number(F.col("InstallertEffekt_MW")).alias("mw"), F.posexplode_outer("Turbiner").alias("block", "b"))
    base = base.where("plant is not null").join(small(enriched), "plant", "left")
    count = F.when(F.col("b").isNull(), 1).otherwise(F.greatest(F.coalesce(F.col("b.AntallTurbiner").try_cast("int"), F.lit(0)), F.lit(1)))
    rows = base.withColumn("t", F.explode(F.sequence(F.lit(0), count - 1)))
    own = F.when(F.col("b").isNull(), F.format_string("NO_%d_plant", "plant")).otherwise(F.format_string("NO_%d_blk_%d_t_%d", "plant", "block", "t"))
    rows = rows.select(
        own.alias("ID"), F.when(F.col("b").isNull(), F.col("mw")).otherwise(number(F.col("b.TurbinStorrelse_kW")) / 1000.0).alias("capacity"), F.col("avg_rotor_diameter").alias("diameter"),
        F.col("avg_hub_height").alias("height"), F.nullif(F.col("b.TurbinProdusent"), F.lit("")).alias("manufacturer"), "lon", "lat", F.lit("onshore").alias("type"), F.col("b").isNotNull().alias("_block"),
    )
    if jitter_km:
        def unit(salt: int):
            return F.pmod(F.xxhash64("ID", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))

        r, angle = jitter_km * F.sqrt(unit(1)), 2 * F.pi() * unit(2)
        dlon = r * F.cos(angle) / (111.0 * F.greatest(F.lit(0.2), F.cos(F.radians("lat"))))
        rows = rows.withColumns({"lon": F.when(F.col("_block"), F.col("lon") + dlon).otherwise(F.col("lon")), "lat": F.when(F.col("_block"), F.col("lat") + r * F.sin(angle) / 111.0).otherwise(F.col("lat"))})
    return conform(rows, SCHEMA)


def similar(left: DataFrame, right: DataFrame, cutoff: float = 0.3, most: int = 50) -> DataFrame:
    """(l, r, ratio): for each distinct string of right its up to most closest of left, by the ratio of matching characters.

    left, right: one string column each. The distinct names of makers are few; the smaller side of the cross join is broadcast by Spark
    only if its size allows.
    """
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            m = difflib.SequenceMatcher(None, y, x)
            m.set_seq1(x)
            m.set_seq2(y)
            out.append(m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0)
        return pd.Series(out)

    a, b = left.toDF("l").where("l is not null").distinct(), right.toDF("r").where("r is not null").distinct()
    pairs = a.crossJoin(b).withColumn("ratio", ratio("l", "r")).where(F.col("ratio") >= cutoff)
    nth = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("ratio"), F.desc("l")))
    return pairs.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def assign_models(turbines: DataFrame, models: DataFrame, accept: float = 1.0, tolerance: float = 100.0) -> DataFrame:
    """turbines with p_density (W/m2) and the model: that of a similar maker if its density is within accept, else the nearest within tolerance.

    Without either a turbine falls out, as do those without numbers or under 1 m. models: (manufacturer, model, p_density), a catalogue, which is broadcast
    as lines sorted by density, so a turbine costs two binary searches and not a comparison with each model. Models without a density or a name can't be chosen.
    """
    t = numeric(require(turbines, "ID", *NUMBERS), *NUMBERS)
    t = t.dropna(subset=["ID", *NUMBERS]).where("height >= 1").select(
        F.col("ID").cast("string").alias("ID"), F.coalesce(pick(turbines, "type"), F.lit("onshore")).alias("type"), *NUMBERS,
        F.coalesce(F.lower(pick(turbines, "manufacturer")), F.lit("")).alias("maker"), specific_power(F.col("capacity"), F.col("diameter")).alias("p_density"),
    )
    m = models.select(F.coalesce(F.lower("manufacturer"), F.lit("")).alias("r"), F.col("model").alias("m_model"), number(F.col("p_density")).alias("m_density"))
    # Names like a maker's are at most some tens for each maker of the catalogue, however many turbines there are.
    close = similar(t.select("maker"), m.select("r")).select("l", "r").toPandas().groupby("l")["r"].apply(list).to_dict()
    known = m.where("m_density is not null and m_model is not null").groupBy("r", "m_density").agg(F.min("m_model").alias("m_model")).toPandas()
    by_maker = dict(tuple(known.groupby("r")))
    shared = turbines.sparkSession.sparkContext.broadcast((by_maker, close))

    def line(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        # Of the models of one density the first by name.
        best = rows.groupby("m_density", sort=True)["m_model"].min()
        return best.index.to_numpy(float), best.to_numpy(object)

    def nearest(at: np.ndarray, options: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        # Equal distances go to the smaller density.
        density, model = options
        if not len(density):
            return np.full(len(at), np.inf), np.full(len(at), None, object)
        up = np.clip(np.searchsorted(density, at), 0, len(density) - 1)
        down = np.maximum(up - 1, 0)
        take = np.where(np.abs(density[down] - at) <= np.abs(density[up] - at), down, up)
        return np.abs(density[take] - at), model[take]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalogue, near = shared.value
        whole, own = line(pd.concat(catalogue.values())) if catalogue else (np.empty(0), np.empty(0, object)), {}
        for batch in batches:
            makers, at = batch.column("maker").to_pandas(), batch.column("p_density").to_numpy(zero_copy_only=False)
            d, model = nearest(at, whole)
            model = np.where(d <= tolerance, model, None)
            for maker, rows in makers.groupby(makers).indices.items():
                if maker not in near:
                    continue
                if (key := tuple(sorted(near[maker]))) not in own:
                    parts = [catalogue[r] for r in key if r in catalogue]
                    own[key] = line(pd.concat(parts)) if parts else (np.empty(0), np.empty(0, object))
                d, similar_one = nearest(at[rows], own[key])
                model[rows] = np.where(d < accept, similar_one, model[rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model, pa.string())], [*batch.schema.names, "model"])

    schema = ", ".join(f"{c} {kind}" for c, kind in t.dtypes) + ", model string"
    return t.where("p_density is not null").mapInArrow(assign, schema).where("model is not null").select("ID", "type", *NUMBERS, "p_density", "model")
