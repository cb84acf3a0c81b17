"""Readers of the tables that wind analytics starts from, and writers of its results.

Array and spreadsheet files have no reader here: convert them to the tables whose columns the docstrings name. Web sources are
read from the responses that were saved as files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions.scalars import domain, first_word, number, recode, stripped, to_lonlat, utm_to_lonlat
from galeframe.operators.bias import generation_to_cf
from galeframe.operators.columns import conform, melt_months, month_names, pick, pivot_months, require
from galeframe.operators.metadata import NUMBERS, SCHEMA, assign_models, belgium, enrichment, impute, norwegian_turbines, standardise
from galeframe.operators.series import resample

#: The headers of the files as they are published, and what the loaders call them. Files with the loaders' own names load too.
HEADERS: dict[str, dict[str, str]] = {
    "DK": {
        "Turbine identifier (GSRN)": "ID", "Manufacture": "manufacturer", "Capacity (kW)": "capacity", "Rotor diameter (m)": "diameter", "Hub height (m)": "height",
        "X (east) coordinate\nUTM 32 Euref89": "east", "Y (north) coordinate\nUTM 32 Euref89": "north", "Type of location": "type",
    },
    "DE": {"V1": "ID", "Manufacturer": "manufacturer", "kW": "capacity", "Rotor..m.": "diameter", "Tower..m.": "height"},
    "FR": {
        "id_aerogenerateur": "ID", "puissance_mw": "capacity", "diametre_rotor": "diameter", "hauteur_mat_nacelle": "height", "constructeur": "manufacturer",
        "x_aerogenerateur": "x", "y_aerogenerateur": "y", "statut_parc": "status",
    },
    "generation": {"Standard international energy product classification (SIEC)": "siec"},
}
#: The years whose observations train a country's model; other countries take those of the last entry.
TRAINING_YEARS = {"DK": (2015, 2019), "DE": (2015, 2018), "UK": (2015, 2018), "": (2015, 2018)}


def csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A CSV with a header, in which quoted fields may hold line ends."""
    reader = spark.read.options(header=True, multiLine=True, **options)
    return (reader.schema(schema) if schema else reader).csv(path)


def reanalysis(spark: SparkSession, path: str) -> DataFrame:
    """(time or valid_time, lat, lon, u100, v100, u10, v10 or fsr) of a Parquet folder, best partitioned by year."""
    return spark.read.option("mergeSchema", True).parquet(path)


def combined(*parts: DataFrame) -> DataFrame:
    """Variables of the same nodes and hours from several tables, joined on (time, lat, lon)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["time", "lat", "lon"], "full")
    return out


def with_hours(df: DataFrame, first_hour: str, order: str = "step") -> DataFrame:
    """df with time counted in hours from first_hour by the number in order, for files without a usable clock."""
    return df.withColumn("time", F.to_timestamp_ntz(F.lit(first_hour)) + F.make_dt_interval(hours=F.col(order).cast("int")))


def merra2_daily(df: DataFrame, year: int, order: str = "step", box: tuple[float, float, float, float] = (7.0, 16.0, 54.3, 58.0)) -> DataFrame:
    """Daily means of all variables of an hourly grid without a usable clock: (step, lat or latitude, lon or longitude, ...), its first step being the year's first hour.

    box: (lon_min, lon_max, lat_min, lat_max), bounds included. Coordinates are rounded half-even to 5 places.
    """
    df = df.withColumnsRenamed({"longitude": "lon", "latitude": "lat"})
    inside = df.where(F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3]))
    values = [c for c in df.columns if c not in (order, "lat", "lon", "time")]
    clocked = with_hours(inside, f"{year}-01-01 00:00:00", order).withColumns({c: F.bround(c, 5) for c in ("lat", "lon")})
    return resample(clocked, "day", ["lat", "lon"], values).select("time", "lat", "lon", *values)


def _features(spark: SparkSession, path: str) -> DataFrame:
    kind = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.schema(kind).json(path, multiLine=True)
    return raw.select(F.posexplode("features").alias("region", "f")).select("region", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))


def points(spark: SparkSession, path: str, *names: str, epsg: int = 4326) -> DataFrame:
    """(names..., lon, lat) of the point features of a GeoJSON file, with those of their properties as strings."""
    each = _features(spark, path).where("type = 'Point'").withColumn("at", F.from_json("c", "array<double>"))
    lon, lat = to_lonlat(F.col("at")[0], F.col("at")[1], epsg)
    return each.select(*(F.element_at("properties", n).alias(n) for n in names), lon.alias("lon"), lat.alias("lat"))


def rings(spark: SparkSession, path: str) -> DataFrame:
    """(region, rings) of the polygons of a GeoJSON file."""
    each = _features(spark, path).select("region", "type", "c")
    one = F.from_json("c", "array<array<array<double>>>")
    many = F.flatten(F.from_json("c", "array<array<array<array<double>>>>"))
    return each.where(F.col("type").isin("Polygon", "MultiPolygon")).select("region", F.when(F.col("type") == "Polygon", one).otherwise(many).alias("rings"))


def headed(df: DataFrame, source: str) -> DataFrame:
    """df with the published headers of a source under the loaders' names."""
    return df.withColumnsRenamed(HEADERS[source])


def turbines_dk(df: DataFrame) -> DataFrame:
    """Danish metadata (ID, manufacturer, capacity, diameter, height, east, north, type as LAND or HAV); UTM zone 32.

    Rows without a capacity, a diameter or a place go.
    """
    df = require(headed(df, "DK"), "ID", "manufacturer", "capacity", "diameter", "height", "east", "north", "type")
    lon, lat = utm_to_lonlat(number(F.col("east")), number(F.col("north")), 32)
    kind = recode(F.lower(F.trim("type")), {"hav": "offshore", "land": "onshore"})
    return _metadata(df.withColumns({"lon": lon, "lat": lat, "type": kind, "manufacturer": first_word(F.lower("manufacturer"))})).dropna(subset=["capacity", "diameter"])


def turbines_de(df: DataFrame, postcodes: DataFrame) -> DataFrame:
    """German metadata (ID, manufacturer, capacity, diameter, height) placed by the postcode that the ID begins with.

    Rows without a capacity, a diameter or a place go.
    """
    df = headed(df, "DE")
    places = postcodes.groupBy(F.col("postcode").cast("int").alias("postcode")).agg(F.min(F.struct("lon", "lat")).alias("_p")).select("postcode", "_p.*")
    return _metadata(df.withColumn("postcode", F.substring("ID", 1, 5).try_cast("int")).join(places, "postcode", "left").withColumn("type", F.lit("onshore"))).dropna(subset=["capacity", "diameter"])


def turbines_fr(df: DataFrame, authorised: str | None = "Autorisé", kind: str = "onshore") -> DataFrame:
    """French metadata (ID, status, capacity in MW, diameter, height, manufacturer, x, y, epsg), each row in its own coordinate system.

    Where there is a status only the rows that have the authorised one stay. Rows without a capacity, a height or a place go.
    """
    df = require(headed(df, "FR"), "ID", "capacity", "diameter", "height", "manufacturer", "x", "y", "epsg")
    if authorised and "status" in df.columns:
        df = df.where(F.trim("status") == authorised)
    systems = [r["e"] for r in df.select(F.col("epsg").try_cast("int").alias("e")).where("e is not null").distinct().collect()]
    lon = lat = F.lit(None).cast("double")
    for e in sorted(systems):
        x, y = to_lonlat(number(F.col("x")), number(F.col("y")), e)
        own = F.col("epsg").try_cast("int") == e
        lon, lat = F.when(own, x).otherwise(lon), F.when(own, y).otherwise(lat)
    return _metadata(df.withColumns({"lon": lon, "lat": lat, "capacity": number(F.col("capacity")) * 1000.0, "type": F.lit(kind)})).dropna(subset=["capacity", "height"])


def turbines_nl(df: DataFrame) -> DataFrame:
    """Dutch metadata (id, rotor, hub, kW, land, maker, ondergrond as land or zee, lon, lat); foreign rows go."""
    own = df.where(F.col("land").isin("NL", "Nederland")) if "land" in df.columns else df
    out = own.select(
        F.col("id").alias("ID"), F.col("kW").alias("capacity"), F.col("rotor").alias("diameter"), F.col("hub").alias("height"), stripped(first_word(F.lower("maker"))).alias("manufacturer"),
        "lon", "lat", recode(F.lower("ondergrond"), {"land": "onshore", "zee": "offshore"}).alias("type"),
    )
    return _metadata(out)


def turbines_uk(df: DataFrame) -> DataFrame:
    """British metadata in the common schema's names; a missing type is onshore."""
    return _metadata(df.withColumn("type", domain(pick(df, "type", default="onshore"))))


def _metadata(df: DataFrame) -> DataFrame:
    numbers = {c: number(F.col(c)) for c in NUMBERS if c in df.columns}
    return conform(df.withColumns(numbers), SCHEMA).dropna(subset=["ID", "lon", "lat"])


def turbines_no(plants: DataFrame, enriched: DataFrame, jitter_km: float = 0.0, seed: int = 0) -> DataFrame:
    """Norwegian turbines of the plants (see norwegian_turbines), enriched by whatever names the second table uses, imputed, in kW."""
    return impute(norwegian_turbines(plants, enrichment(enriched), jitter_km, seed))


LOADERS: dict[str, Callable[..., DataFrame]] = {
    "DK": turbines_dk, "DE": turbines_de, "FR": turbines_fr, "NL": turbines_nl, "UK": turbines_uk, "BE": belgium, "NO": turbines_no,
}


def load_turbines(country: str, *tables: DataFrame, **options) -> DataFrame:
    """A country's metadata in the common schema, from the tables that its loader names, without hub heights of 1 m or less.

    An unknown country, and a table of which no turbine is left, raise ValueError.
    """
    if country.upper() not in LOADERS:
        raise ValueError(f"unknown country: {country}")
    return standardise(LOADERS[country.upper()](*tables, **options))


def training_years(country: str, year: int | None = None, train: bool = True, windows: dict[str, tuple[int, int]] = TRAINING_YEARS) -> tuple[int, int]:
    """The first and last year of a country's observations: those that it is trained on, or the year that is tested."""
    if train:
        return windows.get(country.upper(), windows[""])
    if year is None:
        raise ValueError("a test needs its year")
    return year, year


def prepare_country(country: str, turbines: DataFrame, observed: DataFrame, models: DataFrame | None = None, year: int | None = None, level: str = "turbine", windows: dict = TRAINING_YEARS) -> tuple[DataFrame, DataFrame]:
    """A country's observations and turbines, ready for training (year None) or for testing a year.

    turbines: of load_turbines(). level turbine: observed is that of observations(), and both come out as wide capacity factors (ID, year, obs_1..obs_12)
    of the turbines that have one of the models, and those turbines. level country: observed is that of country_generation(), and comes
    out as (year, month, output_kwh), with all turbines that have a capacity and a place.
    """
    first, last = training_years(country, year, year is None, windows)
    if level == "country":
        return country_generation(observed, country, first, last), turbines.dropna(subset=["capacity", "height", "lon", "lat"])
    if level != "turbine":
        raise ValueError(f"unknown level: {level}")
    if models is None:
        raise ValueError("turbines need the catalogue of models")
    known = assign_models(turbines, models)
    long = melt_months(observations(country, observed, first, last))
    cf = generation_to_cf(long.join(known.select("ID"), "ID", "left_semi"), known)
    return pivot_months(cf), known


def observations_long(df: DataFrame, first: int, last: int) -> DataFrame:
    """Wide observations (ID, year, obs_1..obs_12) of a long table (ID, Year, Month, Output) in kWh; missing months are 0."""
    long = df.select(F.col("ID").cast("string").alias("ID"), F.col("Year").try_cast("int").alias("year"), F.col("Month").try_cast("int").alias("month"), number(F.col("Output")).alias("obs"))
    wide = pivot_months(long.where(F.col("year").between(first, last)))
    return wide.fillna(0.0, subset=month_names())


def observations_wide(df: DataFrame, first: int, last: int) -> DataFrame:
    """Wide observations from a table that has them so already, of the years asked for."""
    out = df.select(F.col("ID").cast("string").alias("ID"), F.col("year").try_cast("int").alias("year"), *(number(F.col(c)).alias(c) for c in month_names()))
    return out.where(F.col("year").between(first, last)).dropna(subset=["ID", "year"])


def observations(country: str, df: DataFrame, first: int, last: int) -> DataFrame:
    """Turbine observations of DE (long) or of DK and UK (wide)."""
    if country not in ("DE", "DK", "UK"):
        raise ValueError(f"no turbine observations for {country}")
    return (observations_long if country == "DE" else observations_wide)(df, first, last)


def country_generation(df: DataFrame, country: str, first: int, last: int, carrier: str = "Wind") -> DataFrame:
    """(year, month, output_kwh) of a table (siec, TIME_PERIOD as yyyy-MM or a date, OBS_VALUE in GWh, geo).

    siec may have its published header. A country without any row of the carrier raises ValueError.
    """
    df = require(headed(df, "generation"), "siec", "TIME_PERIOD", "OBS_VALUE", "geo")
    own = df.where((F.col("geo") == country.upper()) & (F.col("siec") == carrier))
    if own.isEmpty():
        raise ValueError(f"no generation of {carrier} for {country}")
    day = F.to_date(F.substring(F.rpad(F.col("TIME_PERIOD").cast("string"), 10, "-01"), 1, 10))
    months = own.select(F.year(day).alias("year"), F.month(day).alias("month"), (number(F.col("OBS_VALUE")) * 1e6).alias("kwh"))
    return months.where(F.col("year").between(first, last)).groupBy("year", "month").agg(F.sum("kwh").alias("output_kwh"))


def hourly_generation(df: DataFrame, country: str, time: str = "utc_timestamp") -> DataFrame:
    """(time, onshore, offshore, total) in MW of a wide table of many countries; total falls back on the column wind."""
    def of(*kinds: str) -> Column:
        return number(pick(df, *(f"{country}_{k}_generation{end}" for k in kinds for end in ("_actual", ""))))

    on, off, whole = of("wind_onshore"), of("wind_offshore"), of("wind")
    total = F.when(on.isNull() & off.isNull(), whole).otherwise(F.coalesce(on, F.lit(0.0)) + F.coalesce(off, F.lit(0.0)))
    return df.select(F.to_timestamp(F.col(time)).alias("time"), on.alias("onshore"), off.alias("offshore"), total.alias("total"))


def run_name(country: str, mode: str = "onshore", level: str = "turbine", corrected: bool = True, add_nan=None, interp_nan=None, fix_turbine=None, calc_z0: bool = False) -> str:
    """The folder that a run's results belong in."""
    if level not in ("turbine", "country"):
        raise ValueError(f"unknown level: {level}")
    name = country
    if not corrected:
        name += "-uncorrected"
    else:
        name += f"-{mode}-obs_{level}"
        marks = [f"-r{add_nan}" if add_nan is not None else "", f"-i{interp_nan}" if interp_nan is not None else "", f"-{fix_turbine}" if fix_turbine is not None else ""]
        name += "".join(marks) or "-corrected"
    return name + ("-calc_z0" if calc_z0 else "")


def write(df: DataFrame, path: str, *by: str, single_csv: bool = False, mode: str = "overwrite") -> None:
    """Parquet, partitioned if asked for; single_csv makes one CSV file for exchange of small results."""
    if single_csv:
        df.coalesce(1).write.mode(mode).option("header", True).csv(path)
    else:
        writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*by) if by else writer).parquet(path)


def missing_runs(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """The (num_clu, time_res) that are wanted and have no factors yet."""
    return wanted.join(done.select("num_clu", "time_res").distinct(), ["num_clu", "time_res"], "left_anti")
