"""Registered queries of the smaller operators, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.functions import geometry as g
from swarf.operators import jobs as jb
from swarf.operators import profile as pr
from swarf.operators import totals, validate
from swarf.operators import views as vw
from swarf.plans.geometry_queries import CHECKS, GAPS, LINES, LOOP
from swarf.plans.other_queries import LISTED, LOG, PATHS, lines, log, paths
from swarf.plans.part_queries import Q6, WALL
from swarf.plans.registry import query
from swarf.sources.tables import r6, segments, segments_sql, table

SEG = segments_sql()


@query(f"""WITH {segments_sql(gaps=True)} SELECT part_id, seq, {Q6('lead(z_start) OVER w - z_end')} AS gap, {Q6('lead(od_diameter) OVER w - od_diameter')} AS od_step, {Q6('id_diameter - lag(id_diameter) OVER w')} AS id_step FROM segments WINDOW w AS (PARTITION BY part_id ORDER BY z_start, seq)""")
def w01_adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("part_id").orderBy("z_start", "seq")
    s = segments(spark, d, gaps=True)
    return s.select("part_id", "seq", r6(F.lead("z_start").over(by) - F.col("z_end")).alias("gap"), r6(F.lead("od_diameter").over(by) - F.col("od_diameter")).alias("od_step"), r6(F.col("id_diameter") - F.lag("id_diameter").over(by)).alias("id_step"))


@query(f"""WITH {SEG}, e AS (SELECT part_id, z_end - z_start AS l, CASE WHEN seq = 1 THEN od_diameter + 0.5 ELSE od_diameter END AS od, id_diameter AS bore FROM segments)
    SELECT part_id, {Q6('sum(pi() * l * (od / 2 * (od / 2) - bore / 2 * (bore / 2)))')} AS volume, {Q6('sum(pi() * od * l)')} AS od_area FROM e GROUP BY part_id""")
def a23_edited_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals again after the first segment was widened by half an inch."""
    s = segments(spark, d).withColumn("od_diameter", F.when(F.col("seq") == 1, F.col("od_diameter") + 0.5).otherwise(F.col("od_diameter")))
    m = totals.segment_metrics(s)
    return m.groupBy("part_id").agg(r6(F.sum("volume")).alias("volume"), r6(F.sum("od_area")).alias("od_area"))


@query(f"WITH {GAPS}, {LOOP}, {LINES}, {CHECKS.replace('<= 1e-6)', '<= 0.05)')} SELECT part_id, n_open, n >= 2 AND n_open = 0 AS closed FROM ck")
def r29_loosely_closed(spark: SparkSession, d: str) -> DataFrame:
    t = pr.loop_checks(pr.from_segments(segments(spark, d, gaps=True)), 0.05)
    return t.select("part_id", "n_open", "closed")


@query(f"""WITH {SEG} SELECT part_id, {Q6('2 * pi() * sum((od_diameter / 2 - id_diameter / 2) * (od_diameter / 2 + id_diameter / 2) * (z_end - z_start) / 2)')} AS volume_by_area, 0.0::DOUBLE AS axis_x, 0.0::DOUBLE AS axis_y, 1.0::DOUBLE AS axis_z, 1.0::DOUBLE AS plane_y FROM segments GROUP BY part_id""")
def r09_i07_revolved_volume(spark: SparkSession, d: str) -> DataFrame:
    """Volume about the z axis from areas and their centres, with the constants of the axis and the construction plane."""
    ro, ri, length = F.col("od_diameter") / 2, F.col("id_diameter") / 2, F.col("z_end") - F.col("z_start")
    v = r6(2 * math.pi * F.sum((ro - ri) * (ro + ri) * length / 2)).alias("volume_by_area")
    return segments(spark, d).groupBy("part_id").agg(v).withColumns({"axis_x": F.lit(0.0), "axis_y": F.lit(0.0), "axis_z": F.lit(1.0), "plane_y": F.lit(1.0)})


@query(f"""WITH {segments_sql(gaps=True, bad=True)}, s AS (SELECT *, lead(z_start) OVER (PARTITION BY part_id ORDER BY z_start, seq) AS nxt FROM segments),
    v AS (SELECT part_id, count(*) FILTER (z_start >= z_end OR od_diameter <= 0 OR id_diameter < 0 OR id_diameter > od_diameter OR coalesce(abs(z_end - nxt) > 1e-6, false)) AS bad, count(*) FILTER (od_diameter > 0 AND ({WALL}) < 0.001) AS warned, sum(pi() * (z_end - z_start) * (od_diameter / 2 * (od_diameter / 2) - id_diameter / 2 * (id_diameter / 2))) AS vol FROM s GROUP BY part_id)
    SELECT part_id, CASE WHEN bad > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, warned AS n_warnings, CASE WHEN bad = 0 THEN {Q6('vol')} END AS volume FROM v""")
def r21_manual_stack_run(spark: SparkSession, d: str) -> DataFrame:
    """Stacks given by hand: those with an error fail, the others get totals."""
    s = segments(spark, d, gaps=True, bad=True)
    msg = validate.stack_messages(s).groupBy("part_id").agg(F.count_if(F.col("level") == "error").alias("bad"), F.count_if(F.col("level") == "warning").alias("n_warnings"))
    t = totals.part_totals(s).join(msg, "part_id", "left")
    bad = F.coalesce("bad", F.lit(0)) > 0
    return t.select("part_id", F.when(bad, "FAILED").otherwise("COMPLETED").alias("status"), F.coalesce("n_warnings", F.lit(0)).cast("long").alias("n_warnings"), F.when(~bad, r6(F.col("volume"))).alias("volume"))


@query(f"WITH {LOG}, p AS (SELECT p_partkey % 150 AS job_id, ({LISTED})[(p_partkey % {len(PATHS)} + 1)::INT] AS path FROM part), f AS (SELECT job_id, count(*) FILTER (starts_with(path, 'inputs/')) AS n_inputs, count(*) FILTER (starts_with(path, 'outputs/')) AS n_outputs FROM (SELECT DISTINCT * FROM p) GROUP BY job_id) SELECT job_id, status, coalesce(n_inputs, 0) AS n_inputs, coalesce(n_outputs, 0) AS n_outputs FROM js LEFT JOIN f USING (job_id)")
def r14_jobs_with_files(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d).select((F.col("p_partkey") % 150).alias("job_id"), "path").distinct()
    f = p.groupBy("job_id").agg(F.count_if(F.col("path").startswith("inputs/")).alias("n_inputs"), F.count_if(F.col("path").startswith("outputs/")).alias("n_outputs"))
    return jb.latest(log(spark, d)).join(f, "job_id", "left").select("job_id", "status", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_inputs", "n_outputs")])


@query("""WITH l AS (SELECT user_id AS view_id, event_id AS i, event_id * 7 % 400 AS x1, event_id * 11 % 300 AS y1, event_id * 13 % 400 AS x2, event_id * 17 % 300 AS y2 FROM events),
    a AS (SELECT *, atan2(y2 - y1, x2 - x1) * 180 / pi() AS angle FROM l), t AS (SELECT *, CASE WHEN abs(angle) < 90 THEN 90 - angle ELSE -(90 + angle) END AS turn FROM a)
    SELECT i, """ + Q6("turn") + " AS rotation_angle, " + Q6("200 - ((cos(radians(turn)) * (x1 - 200) + sin(radians(turn)) * (y1 - 150) + 200) + (cos(radians(turn)) * (x2 - 200) + sin(radians(turn)) * (y2 - 150) + 200)) / 2 + 1e-10") + " AS translation_x FROM t")
def i04_axis_transform(spark: SparkSession, d: str) -> DataFrame:
    ls = lines(spark, d).withColumn("angle", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")) * 180 / F.pi()).withColumn("view_id", F.col("i"))
    return vw.normalised_axis(ls).select(F.col("view_id").alias("i"), r6(F.col("rotation_angle")).alias("rotation_angle"), r6(F.col("translation_x") + 1e-10).alias("translation_x"))


@query("""WITH c AS (SELECT user_id AS view_id, event_id AS i, value * value AS area, event_id % 400 AS cx FROM events), r AS (SELECT *, area / max(area) OVER (PARTITION BY view_id) AS ratio FROM c)
    SELECT i, coalesce(ratio > 0.05, false) AS is_od, coalesce(ratio < 0.01 AND area > 0 AND (cx < 200 OR abs(cx - 200) < 40), false) AS is_id FROM r""")
def i05_contour_roles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").select(F.col("user_id").alias("view_id"), F.col("event_id").alias("i"), (F.col("value") * F.col("value")).alias("area"), (F.col("event_id") % 400).alias("cx"), F.lit(400).alias("w"))
    return vw.contour_roles(c).drop("view_id")


@query(f"WITH {SEG}, b AS (SELECT part_id, max(od_diameter) AS w, max(z_end) - min(z_start) AS h FROM segments GROUP BY part_id) SELECT part_id, floor(least(greatest(1e-6 * sqrt(w * w + w * w + h * h), 1e-8), 1e-3) * 1e12 + 0.5) AS epsilon_12 FROM b")
def i09_epsilon(spark: SparkSession, d: str) -> DataFrame:
    """The distance for inside tests from the diagonal of a part's box, in units of 1e-12."""
    b = segments(spark, d).groupBy("part_id").agg(F.max("od_diameter").alias("w"), (F.max("z_end") - F.min("z_start")).alias("h"))
    eps = g.clamp(1e-6 * F.sqrt(F.col("w") * F.col("w") + F.col("w") * F.col("w") + F.col("h") * F.col("h")), 1e-8, 1e-3)
    return b.select("part_id", F.floor(eps * 1e12 + 0.5).cast("double").alias("epsilon_12"))


@query(f"WITH {LOG}, f AS (SELECT job_id, max(ts) FILTER (n % 2 = 0) AS glb, max(ts) FILTER (n % 2 = 1) AS step FROM jl GROUP BY job_id) SELECT job_id, coalesce(glb >= step, false) AS up_to_date FROM f")
def io18_conversion_cache(spark: SparkSession, d: str) -> DataFrame:
    """A converted model is up to date if it isn't older than its source."""
    f = log(spark, d).groupBy("job_id").agg(F.max(F.when(F.col("n") % 2 == 0, F.col("ts"))).alias("glb"), F.max(F.when(F.col("n") % 2 == 1, F.col("ts"))).alias("step"))
    return f.select("job_id", F.coalesce(F.col("glb") >= F.col("step"), F.lit(False)).alias("up_to_date"))
