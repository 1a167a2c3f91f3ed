"""Validators as rows of (part_id, seq, code): each rule is a condition, and what fails is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.functions import geometry as g
from swarf.params import DEFAULT, Params


def listed(*rules: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in the order given."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in rules]), lambda x: x.isNotNull())


def row_rule(seg: DataFrame) -> DataFrame:
    """The first rule of the interface that a segment breaks, or null."""
    z0, z1, od, bore = (F.col(c) for c in ("z_start", "z_end", "od_diameter", "id_diameter"))
    return seg.withColumn("code", F.when(z0 >= z1, "Z_ORDER").when(od <= 0, "OD_NOT_POSITIVE").when(bore < 0, "ID_NEGATIVE").when(bore > od, "ID_OVER_OD"))


def stack_messages(seg: DataFrame, tolerance: float | None = None, p: Params = DEFAULT) -> DataFrame:
    """part_id, seq, level, code of a stack given by hand: the row rules, a warning of thin walls, and gaps to the next."""
    by = Window.partitionBy("part_id").orderBy("z_start", "seq")
    z0, z1, od, bore = (F.col(c) for c in ("z_start", "z_end", "od_diameter", "id_diameter"))
    rows = seg.withColumn("next", F.lead("z_start").over(by))
    off = F.abs(z1 - F.col("next")) > (p.contiguity if tolerance is None else tolerance)
    codes = listed((z0 >= z1, "Z_ORDER"), (od <= 0, "OD_NOT_POSITIVE"), (bore < 0, "ID_NEGATIVE"), (bore > od, "ID_OVER_OD"), ((od > 0) & (g.wall_thickness(od, bore) < p.thin_wall_warning), "THIN_WALL"), (off, "NOT_CONTIGUOUS"))
    rows = rows.select("part_id", "seq", F.explode(codes).alias("code"))
    return rows.withColumn("level", F.when(F.col("code") == "THIN_WALL", "warning").otherwise("error"))


def stack_validity(seg: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row a part: n_gaps, n_overlaps, n_bad_od, n_bad_id, first_is_min, last_is_max, ok."""
    by = Window.partitionBy("part_id").orderBy("z_start", "seq")
    rows = seg.withColumn("gap", F.lead("z_start").over(by) - F.col("z_end")).withColumn("k", F.row_number().over(by))
    t = rows.groupBy("part_id").agg(
        F.count_if(F.col("gap") > tolerance).alias("n_gaps"), F.count_if(F.col("gap") < -tolerance).alias("n_overlaps"), F.count_if(F.col("od_diameter") <= 0).alias("n_bad_od"),
        F.count_if(F.col("id_diameter") > F.col("od_diameter") + tolerance).alias("n_bad_id"), (F.min_by("z_start", "k") == F.min("z_start")).alias("first_is_min"), (F.max_by("z_end", "k") == F.max("z_end")).alias("last_is_max"),
    )
    return t.withColumn("ok", (F.col("n_gaps") + F.col("n_overlaps") + F.col("n_bad_od") + F.col("n_bad_id") == 0) & F.col("first_is_min") & F.col("last_is_max"))


def sanity_gates(totals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """From part_id, total_length, max_od: which gates pass, and their reasons."""
    length, od = F.col("total_length").between(*p.length_gate), F.col("max_od").between(*p.od_gate)
    return totals.select("part_id", length.alias("length_ok"), od.alias("od_ok"), (length & od).alias("passed"), F.array_join(listed((~length, "TOTAL_LENGTH"), (~od, "MAX_OD")), ",").alias("reasons"))


def step_gate(seg: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """approved or needs_review: overall confidence by length, segments of low confidence, segments flagged thin_wall.

    Segments without flags or without confidence count as sure.
    """
    seg = seg.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    length, thin = F.col("z_end") - F.col("z_start"), F.array_contains("flags", "thin_wall")
    t = seg.groupBy("part_id").agg(F.sum(length * F.col("confidence")).alias("w"), F.sum(length).alias("l"), F.avg("confidence").alias("mean"), F.count_if(F.col("confidence") < p.step_segment).alias("n_low"), F.count_if(thin).alias("n_thin"))
    t = t.withColumn("overall", F.floor(F.when(F.col("l") > 0, F.col("w") / F.col("l")).otherwise(F.col("mean")) * 1e6 + 0.5) / F.lit(1e6))
    reasons = listed((F.col("overall") < p.step_overall, "LOW_OVERALL"), (F.col("n_low") > 0, "LOW_SEGMENT"), (F.col("n_thin") > p.step_thin_walls, "THIN_WALLS"))
    return t.select("part_id", "overall", "n_low", "n_thin", F.when(F.size(reasons) == 0, "approved").otherwise("needs_review").alias("status"), F.array_join(reasons, ",").alias("reasons"))
