"""Envelopes along the axis of a view: binning, running median, change points, segments and their confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.functions import geometry as g


def axial_bins(pixels: DataFrame, sizes: DataFrame, step: int = 3) -> DataFrame:
    """From edge pixels (view_id, x, y, kind 'od' or 'id') and sizes (view_id, height, axis_x): one row a bin of `step` rows.

    od_radius is the widest distance from the axis, id_radius the nearest of a bore's edges, 0 where there are none. Bins
    are dense: an equi-join on (view_id, bin) to the sequence of bins.
    """
    bins = sizes.withColumn("n", F.greatest(F.lit(1), (F.col("height") / step).cast("int"))).select("view_id", "axis_x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    found = pixels.join(sizes.select("view_id", "axis_x"), "view_id").select("view_id", "kind", F.floor(F.col("y") / step).cast("int").alias("bin"), F.abs(F.col("x") - F.col("axis_x")).alias("r"))
    found = found.groupBy("view_id", "bin").agg(F.max(F.when(F.col("kind") == "od", F.col("r"))).alias("od"), F.min(F.when(F.col("kind") == "id", F.col("r"))).alias("bore"))
    return bins.join(found, ["view_id", "bin"], "left").select("view_id", F.col("bin").cast("long").alias("bin"), (F.col("bin") * step + step / 2).alias("axial_position"), F.coalesce("od", F.lit(0.0)).alias("od_radius"), F.coalesce("bore", F.lit(0.0)).alias("id_radius"))


def running_median(series: DataFrame, value: str = "od_radius") -> DataFrame:
    """Adds n and smoothed: the median of a centred window, of width 1, 3 or 5 by the length of the series, cut at the ends."""
    by, whole = Window.partitionBy("view_id").orderBy("bin"), Window.partitionBy("view_id")
    half = F.floor(F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("n") / 10))) / 2)
    s = series.withColumn("n", F.count("*").over(whole))
    frame = lambda k: F.percentile(value, F.lit(0.5)).over(by.rowsBetween(-k, k))
    return s.withColumn("smoothed", F.when(half == 0, F.col(value).cast("double")).when(half == 1, frame(1)).otherwise(frame(2)))


def change_points(smoothed: DataFrame, least: float = 0.005) -> DataFrame:
    """view_id, bin: the ends, every bin where the smoothed value changes by more than `least`, and if there is none in a
    series of more than 10 the bin farthest from the mean, unless it lies in the outer tenths.
    """
    by, whole = Window.partitionBy("view_id").orderBy("bin"), Window.partitionBy("view_id")
    s = smoothed.where("n >= 2").select("*", F.lag("smoothed").over(by).alias("prev"), (F.row_number().over(by) - 1).alias("i"), F.avg("smoothed").over(whole).alias("mean"))
    v, w = F.col("smoothed"), F.col("prev")
    step = F.coalesce((v > 0) & (w > 0) & (F.abs(v - w) / F.when((v > 0) & (w > 0), F.greatest(v, w)) > least), F.lit(False))
    end = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    s = s.withColumn("point", step | end).withColumn("off", F.floor(F.abs(v - F.col("mean")) * 1e9 + 0.5))
    s = s.withColumn("far", F.min_by("i", F.struct(-F.col("off"), "i")).over(whole)).withColumn("points", F.count_if("point").over(whole))
    spare = (F.col("points") == 2) & (F.col("n") > 10) & (F.col("i") == F.col("far")) & (F.col("far") > F.col("n") * 0.1) & (F.col("far") < F.col("n") * 0.9)
    return s.where(F.col("point") | spare).select("view_id", "bin")


def view_segments(series: DataFrame, points: DataFrame, scale: float, has_bore: bool = True) -> DataFrame:
    """Segments between change points, bins of both ends included, with cleaned diameters and confidence.

    The change points of a view are few, so each bin finds its segments by equi-join on view_id with a range residual.
    """
    by = Window.partitionBy("view_id").orderBy("bin")
    ends = points.select("view_id", F.col("bin").alias("from"), F.lead("bin").over(by).alias("to")).where("to - from >= 1")
    inside = series.join(ends, "view_id").where("bin between from and to")
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    s = inside.groupBy("view_id", "from", "to").agg(
        F.median(pos("od_radius")).alias("od"), F.median(pos("id_radius")).alias("bore"), F.stddev_pop(pos("od_radius")).alias("sd"), F.avg(pos("od_radius")).alias("mean"),
        F.min("axial_position").alias("a"), F.max("axial_position").alias("b"),
    ).where("od is not null")
    inferred = F.lit(not has_bore) | F.col("bore").isNull()
    s = s.withColumn("inferred", inferred).withColumn("bore0", F.coalesce("bore", F.lit(0.0)))
    s = s.withColumn("big", F.greatest("od", "bore0") * 2 * scale).withColumn("small", F.least("od", "bore0") * 2 * scale)
    s = s.withColumn("clamped", (F.col("small") > 0) & ((F.col("small") < F.greatest(F.lit(0.01), 0.01 * F.col("big"))) | (F.col("small") < 0.001)))
    s = s.withColumn("id_diameter", F.when(F.col("clamped"), 0.0).otherwise(F.col("small")))
    sure = F.when(F.col("inferred"), F.when(F.col("id_diameter") == 0, 0.5).otherwise(0.6)).when(F.col("clamped"), 0.7).otherwise(0.85)
    s = s.withColumn("base", (1 - F.least(F.lit(1.0), F.coalesce("sd", F.lit(0.0)) / (F.col("mean") + 1e-6))) * 0.7 + sure * 0.3)
    s = s.withColumn("z_start", F.col("a") * scale).withColumn("z_end", F.col("b") * scale)
    whole = Window.partitionBy("view_id")
    rel = (F.col("z_end") - F.col("z_start")) / (F.max("z_end").over(whole) - F.min("z_start").over(whole))
    wall = (F.col("big") - F.col("id_diameter")) / 2
    cost = F.when(F.col("clamped"), 0.15).otherwise(0.0) + F.when((wall > 0) & (wall < 0.05), 0.10 * (1 - wall / 0.05)).otherwise(0.0) + F.when(rel < 0.02, 0.10 * (1 - rel / 0.02)).otherwise(0.0)
    return s.select("view_id", F.col("from").alias("from_bin"), F.col("to").alias("to_bin"), "z_start", "z_end", F.col("big").alias("od_diameter"), "id_diameter", "clamped", "inferred", "base", g.clamp(F.col("base") - cost).alias("confidence"))
