"""Part totals: one window pass for neighbours and one aggregate, both on part_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.functions import geometry as g


def segment_metrics(seg: DataFrame) -> DataFrame:
    """Each segment with its length, wall, volume and areas."""
    od, bore, length = F.col("od_diameter"), F.col("id_diameter"), F.col("z_end") - F.col("z_start")
    return seg.select("*", length.alias("length"), g.wall_thickness(od, bore).alias("wall_thickness"), g.volume(length, od, bore).alias("volume"), g.mantle(length, od).alias("od_area"), g.mantle(length, bore).alias("id_area"), g.ring(od, bore).alias("end_face_area"))


def part_totals(seg: DataFrame) -> DataFrame:
    """Nine totals, the z range and the feature counts of each part."""
    by = Window.partitionBy("part_id").orderBy("z_start", "seq")
    m = segment_metrics(seg)
    m = m.select("*", g.shoulder(F.col("od_diameter"), F.lead("od_diameter").over(by)).alias("od_step"), g.shoulder(F.col("id_diameter"), F.lead("id_diameter").over(by)).alias("id_step"), F.lag("seq").over(by).isNull().alias("first"), F.lead("seq").over(by).isNull().alias("last"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    t = m.groupBy("part_id").agg(
        F.count("*").alias("n_segments"), F.sum("volume").alias("volume"), F.sum("od_area").alias("od_area"), F.sum("id_area").alias("id_area"),
        F.max(F.when(F.col("first"), F.col("end_face_area"))).alias("end_start"), F.max(F.when(F.col("last"), F.col("end_face_area"))).alias("end_end"),
        zero("od_step").alias("od_shoulder"), zero("id_step").alias("id_shoulder"), F.min("z_start").alias("z_min"), F.max("z_end").alias("z_max"),
        F.count_if(F.col("id_diameter") > 0).alias("n_bores"),
    )
    t = t.withColumn("planar_ring", F.col("end_start") + F.col("end_end") + F.col("od_shoulder") + F.col("id_shoulder"))
    return t.withColumn("total_surface", F.col("od_area") + F.col("id_area") + F.col("planar_ring"))
