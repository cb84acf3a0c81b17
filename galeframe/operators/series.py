"""Ordered and resampled series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resample(df: DataFrame, unit: str, keys: list[str], values: list[str], time: str = "time") -> DataFrame:
    """The mean of values by keys and the hour, day or month of time."""
    return df.groupBy(*keys, F.date_trunc(unit, F.col(time)).alias(time)).agg(*(F.avg(v).alias(v) for v in values))


def backfill(df: DataFrame, keys: list[str], order: list[str], value: str, out: str | None = None) -> DataFrame:
    """Nulls take the next value in order; those after the last value stay null."""
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out or value, F.first(value, ignorenulls=True).over(ahead))


def interpolate(df: DataFrame, keys: list[str], order: list[str], value: str, limit: int, out: str | None = None) -> DataFrame:
    """Nulls at most limit rows from a value are filled, linearly by row position between two values and with the nearest value at the ends.

    Within a gap the line is that of the whole gap, so of a long one only the edges are filled.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_at", F.row_number().over(w))
    held = F.when(F.col(value).isNotNull(), F.col("_at"))
    df = df.withColumns({
        "_p": F.last(value, ignorenulls=True).over(back), "_n": F.first(value, ignorenulls=True).over(ahead),
        "_pa": F.last(held, ignorenulls=True).over(back), "_na": F.first(held, ignorenulls=True).over(ahead),
    })
    line = F.col("_p") + (F.col("_n") - F.col("_p")) * (F.col("_at") - F.col("_pa")) / (F.col("_na") - F.col("_pa"))
    filled = F.when(F.col("_p").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_p")).otherwise(line)
    gap = F.least(F.col("_at") - F.col("_pa"), F.col("_na") - F.col("_at"))
    return df.withColumn(out or value, F.when(F.col(value).isNotNull(), F.col(value)).when(gap <= limit, filled)).drop("_at", "_p", "_n", "_pa", "_na")


def nearest_match(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tolerance: float | None = None, rows: int = 1_000_000) -> DataFrame:
    """Each row of left with the row of right whose key is nearest; the smaller key wins a tie, then the other columns in order.

    Both sides are put on one line and each left row looks back and ahead along it, which takes one sort instead of a cross join. The
    line is cut into ranges of some rows each, at quantiles of both sides' keys, that are sorted each for itself; the last right row before and the first after each
    range are carried over to it. Left rows of one key are looked up once, however many they are.
    Beyond the tolerance, and for a null key, right's columns are null. Left rows come out once each, repeated ones too. One key
    with several right rows gives the least of them.
    """
    r_cols = right.columns
    best = right.where(F.col(right_on).isNotNull()).groupBy(F.col(right_on).cast("double").alias("_k")).agg(F.min(F.struct(*r_cols)).alias("_r"))
    asked = left.select(F.col(left_on).cast("double").alias("_k")).where("_k is not null").distinct()
    tagged = asked.withColumns({"_l": F.lit(True), "_r": F.lit(None).cast(best.schema["_r"].dataType)}).unionByName(best.withColumn("_l", F.lit(False)))
    ranges = max(1, min(10_000, -(-tagged.count() // rows)))
    cuts = sorted(set(tagged.approxQuantile("_k", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    keyed = tagged.withColumn("_p", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col("_k"))))
    # Between partitions only the edges pass: one row each.
    edges = keyed.where("_r is not null").groupBy("_p").agg(F.max_by(F.struct("_k", "_r"), "_k").alias("_hi"), F.min_by(F.struct("_k", "_r"), "_k").alias("_lo"))
    w = Window.partitionBy("_p").orderBy("_k", F.col("_r").isNull())
    here = F.when(F.col("_r").isNotNull(), F.struct("_k", "_r"))
    seen = keyed.withColumns({
        "_b": F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_a": F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    }).where("_l")
    parts = keyed.select("_p").distinct()
    order = Window.orderBy("_p")
    carried = parts.join(edges, "_p", "left").select(
        "_p",
        F.last("_hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    both = seen.join(F.broadcast(carried), "_p").select("_k", F.coalesce("_b", "_before").alias("_b"), F.coalesce("_a", "_after").alias("_a"))  # a row a range
    down, up = F.col("_k") - F.col("_b._k"), F.col("_a._k") - F.col("_k")
    take_down = F.when(up.isNull(), down.isNotNull()).when(down.isNull(), F.lit(False)).otherwise(down <= up)
    chosen = both.select("_k", F.when(take_down, F.col("_b._r")).otherwise(F.col("_a._r")).alias("_r"), F.when(take_down, down).otherwise(up).alias("_d"))
    if tolerance is not None:
        chosen = chosen.withColumn("_r", F.when(F.col("_d") <= tolerance, F.col("_r")))
    joined = left.select(F.struct(*left.columns).alias("_l"), F.col(left_on).cast("double").alias("_lk")).join(chosen, F.col("_lk") == F.col("_k"), "left")
    return joined.select("_l.*", *(F.col(f"_r.{c}").alias(c if c not in left.columns else f"{c}_right") for c in r_cols), F.col("_d").alias("distance"))
