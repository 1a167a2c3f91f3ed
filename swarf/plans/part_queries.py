"""Registered queries of segments, totals, validation, weighting and quotation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.functions import geometry as g
from swarf.operators import features as fe
from swarf.operators import rfq, totals, validate, weighted
from swarf.plans.registry import query
from swarf.sources.tables import PARTS_SQL, parts, r6, segments, segments_sql, table

SEG = segments_sql()
WALL = "CASE WHEN od_diameter > 0 AND id_diameter > 0 THEN (od_diameter - id_diameter) / 2 WHEN od_diameter > 0 THEN od_diameter / 2 ELSE 0 END"
Q6 = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6::DOUBLE"
RING = lambda o, i: f"pi() * ({o} / 2 * ({o} / 2) - {i} / 2 * ({i} / 2))"
SHOULDER = lambda a, b: f"pi() * abs({a} / 2 * ({a} / 2) - {b} / 2 * ({b} / 2))"


@query(f"""WITH {SEG}, m AS (SELECT *, z_end - z_start AS l, {RING("od_diameter", "id_diameter")} AS face,
      CASE WHEN od_diameter > 0 THEN pi() * od_diameter * (z_end - z_start) ELSE 0 END AS oa, CASE WHEN id_diameter > 0 THEN pi() * id_diameter * (z_end - z_start) ELSE 0 END AS ia,
      {SHOULDER("od_diameter", "lead(od_diameter) OVER w")} AS os, {SHOULDER("id_diameter", "lead(id_diameter) OVER w")} AS is_,
      row_number() OVER w AS k, count(*) OVER (PARTITION BY part_id) AS n FROM segments WINDOW w AS (PARTITION BY part_id ORDER BY z_start, seq)),
    t AS (SELECT part_id, count(*) AS n_segments, sum(face * l) AS volume, sum(oa) AS od_area, sum(ia) AS id_area, max(face) FILTER (k = 1) AS end_start, max(face) FILTER (k = n) AS end_end,
      coalesce(sum(os), 0) AS od_shoulder, coalesce(sum(is_), 0) AS id_shoulder, min(z_start) AS z_min, max(z_end) AS z_max, count(*) FILTER (id_diameter > 0) AS n_bores FROM m GROUP BY part_id)
    SELECT part_id, n_segments, z_min, z_max, n_bores, {", ".join(f"{Q6(c)} AS {c}" for c in ("volume", "od_area", "id_area", "end_start", "end_end", "od_shoulder", "id_shoulder"))},
      {Q6("end_start + end_end + od_shoulder + id_shoulder")} AS planar_ring, {Q6("od_area + id_area + end_start + end_end + od_shoulder + id_shoulder")} AS total_surface FROM t""")
def part_totals(spark: SparkSession, d: str) -> DataFrame:
    """A1-A6, W1, R5 over P1-P5."""
    t = totals.part_totals(segments(spark, d))
    sums = ("volume", "od_area", "id_area", "end_start", "end_end", "od_shoulder", "id_shoulder", "planar_ring", "total_surface")
    return t.select("part_id", "n_segments", "z_min", "z_max", "n_bores", *[r6(F.col(c)).alias(c) for c in sums])


@query(f"""WITH {SEG} SELECT part_id, seq, {Q6("z_end - z_start")} AS length, {Q6(WALL)} AS wall_thickness, {Q6("(z_end - z_start) * " + RING("od_diameter", "id_diameter"))} AS volume,
      {Q6("pi() * od_diameter * (z_end - z_start)")} AS od_area, {Q6("pi() * id_diameter * (z_end - z_start)")} AS id_area, {Q6(RING("od_diameter", "id_diameter"))} AS end_face_area FROM segments""")
def p01_p05_segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = totals.segment_metrics(segments(spark, d))
    return m.select("part_id", "seq", *[r6(F.col(c)).alias(c) for c in ("length", "wall_thickness", "volume", "od_area", "id_area", "end_face_area")])


@query(f"""WITH {PARTS_SQL}, x AS (SELECT part_id, units, (part_id % 977) / 100.0::DOUBLE AS v, CASE part_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE (part_id % 977)::VARCHAR || '.5' END AS raw FROM parts)
    SELECT part_id, {Q6("CASE WHEN units = 'mm' THEN v / 25.4 ELSE v END")} AS inches, {Q6("least(greatest(v - 1, 0), 1)")} AS clamped, try_cast(raw AS DOUBLE) AS number,
      (ceil(v::DECIMAL(18,6) * 20) / 20)::DOUBLE AS stepped, floor(v / 3 * 1000 + 0.5) / 1000.0::DOUBLE AS rounded FROM x""")
def p06_p10_scalars(spark: SparkSession, d: str) -> DataFrame:
    x = parts(spark, d).select("part_id", "units", ((F.col("part_id") % 977) / F.lit(100.0)).alias("v"), F.when(F.col("part_id") % 5 == 0, "n/a").when(F.col("part_id") % 5 == 1, "").otherwise(F.concat((F.col("part_id") % 977).cast("string"), F.lit(".5"))).alias("raw"))
    v = F.col("v")
    return x.select("part_id", r6(g.to_inches(v, F.col("units"))).alias("inches"), r6(g.clamp(v - 1)).alias("clamped"), g.as_number(F.col("raw")).alias("number"), g.ceil_to_step(v, 0.05).alias("stepped"), g.round3(v / 3).alias("rounded"))


@query(f"""WITH {SEG} SELECT part_id, seq, {Q6("(z_end - z_start) * " + RING("od_diameter", "id_diameter") + " * coalesce(CASE WHEN part_id % 3 = 0 THEN 0.284 END, CASE WHEN part_id % 3 = 1 THEN 7.85 END * 0.0361273)")} AS weight,
      od_diameter / 2 AS x3, 0.0::DOUBLE AS y3, z_start AS z3 FROM segments""")
def p11_p12_weight_and_axes(spark: SparkSession, d: str) -> DataFrame:
    """P11 with a density of steel in either unit, or none; P12 maps radius and axial place to X and Z."""
    m, k = totals.segment_metrics(segments(spark, d)), F.col("part_id") % 3
    return m.select("part_id", "seq", r6(g.weight(F.col("volume"), F.when(k == 1, F.lit(7.85)), F.when(k == 0, F.lit(0.284)))).alias("weight"), (F.col("od_diameter") / 2).alias("x3"), F.lit(0.0).alias("y3"), F.col("z_start").alias("z3"))


@query(f"""WITH {SEG}, s AS (SELECT part_id, seq, CASE WHEN seq % 7 = 0 THEN NULL ELSE confidence END AS c, ['auto_merged', 'thin_wall', 'low_confidence'][(seq % 4 + 1)::INT] AS flag FROM segments)
    SELECT part_id, seq, CASE WHEN c IS NULL THEN 'Unknown' WHEN c >= 0.8 THEN 'High' WHEN c >= 0.6 THEN 'Medium' ELSE 'Low' END AS label,
      CASE WHEN c IS NULL THEN 'Unknown' WHEN c >= 0.85 THEN 'High' WHEN c >= 0.65 THEN 'Medium' ELSE 'Low' END AS badge,
      CASE WHEN flag = 'low_confidence' OR c < 0.65 THEN 'bad' WHEN flag IS NOT NULL THEN 'warn' ELSE 'good' END AS cell,
      CASE WHEN c < 0.65 THEN true ELSE false END AS low_banner FROM s""")
def p13_p14_r31_labels(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("part_id", "seq", F.when(F.col("seq") % 7 == 0, None).otherwise(F.col("confidence")).alias("c"), F.get(F.array(*map(F.lit, ("auto_merged", "thin_wall", "low_confidence"))), (F.col("seq") % 4).cast("int")).alias("flag"))
    c = F.col("c")
    cell = F.when((F.col("flag") == "low_confidence") | (c < 0.65), "bad").when(F.col("flag").isNotNull(), "warn").otherwise("good")
    return s.select("part_id", "seq", g.confidence_label(c).alias("label"), g.confidence_label(c, 0.85, 0.65).alias("badge"), cell.alias("cell"), F.coalesce(c < 0.65, F.lit(False)).alias("low_banner"))


@query(f"""WITH {PARTS_SQL}, x AS (SELECT part_id, CASE WHEN method IN ('anchor_dimension', 'estimated') THEN method ELSE 'unknown' END AS scale_method,
      CASE WHEN part_id % 3 = 0 THEN true ELSE validation_passed END AS validation, CASE WHEN part_id % 4 = 0 THEN 0 WHEN part_id % 6 = 1 THEN 0.9 ELSE overall END AS o FROM parts)
    SELECT part_id, scale_method, validation, {Q6("least(greatest(CASE WHEN o <= 0 THEN 0.55 ELSE o END, 0), 1)")} AS overall FROM x""")
def p15_p16_scale_extraction(spark: SparkSession, d: str) -> DataFrame:
    """From JSON: a method that isn't known, a validation that isn't a boolean, and three places for the confidence."""
    k = F.col("part_id")
    j = parts(spark, d).select(k, F.concat(
        F.lit('{"scale_report":{"method":"'), F.col("method"), F.lit('","validation_passed":'), F.when(k % 3 == 0, F.lit('"yes"')).otherwise(F.col("validation_passed").cast("string")), F.lit("}"),
        F.when(k % 4 == 0, F.lit("")).when(k % 6 == 1, F.lit(',"overall_confidence":0.9')).otherwise(F.concat(F.lit(',"inference_metadata":{"overall_confidence":'), F.col("overall").cast("string"), F.lit('},"overall_confidence":0.1'))), F.lit("}"),
    ).alias("doc"))
    v = F.parse_json("doc")
    method = F.try_variant_get(v, "$.scale_report.method", "string")
    flag = F.when(F.get_json_object("doc", "$.scale_report.validation_passed").isin("true", "false"), F.get_json_object("doc", "$.scale_report.validation_passed").cast("boolean")).otherwise(F.lit(True))
    o = F.coalesce(F.try_variant_get(v, "$.inference_metadata.overall_confidence", "double"), F.try_variant_get(v, "$.overall_confidence", "double"), F.lit(0.0))
    return j.select(k, F.when(method.isin("anchor_dimension", "estimated"), method).otherwise("unknown").alias("scale_method"), flag.alias("validation"), r6(g.clamp(F.when(o <= 0, F.lit(0.55)).otherwise(o))).alias("overall"))


BAD = {"gaps": True, "bad": True}
CODE = "CASE WHEN z_start >= z_end THEN 'Z_ORDER' WHEN od_diameter <= 0 THEN 'OD_NOT_POSITIVE' WHEN id_diameter < 0 THEN 'ID_NEGATIVE' WHEN id_diameter > od_diameter THEN 'ID_OVER_OD' END"


@query(f"WITH {segments_sql(**BAD)} SELECT part_id, seq, {CODE} AS code FROM segments WHERE {CODE} IS NOT NULL")
def v01_interface_rules(spark: SparkSession, d: str) -> DataFrame:
    return validate.row_rule(segments(spark, d, **BAD)).where("code is not null").select("part_id", "seq", "code")


def _messages_sql(tolerance: str) -> str:
    rules = (("z_start >= z_end", "Z_ORDER"), ("od_diameter <= 0", "OD_NOT_POSITIVE"), ("id_diameter < 0", "ID_NEGATIVE"), ("id_diameter > od_diameter", "ID_OVER_OD"), (f"od_diameter > 0 AND ({WALL}) < 0.001", "THIN_WALL"), (f"abs(z_end - nxt) > {tolerance}", "NOT_CONTIGUOUS"))
    return f"WITH {segments_sql(**BAD)}, s AS (SELECT *, lead(z_start) OVER (PARTITION BY part_id ORDER BY z_start, seq) AS nxt FROM segments) " + " UNION ALL ".join(f"SELECT part_id, seq, '{'warning' if k == 'THIN_WALL' else 'error'}' AS level, '{k}' AS code FROM s WHERE {c}" for c, k in rules)


@query(_messages_sql("1e-6"))
def v02_manual_stack(spark: SparkSession, d: str) -> DataFrame:
    return validate.stack_messages(segments(spark, d, **BAD))


@query(_messages_sql("0.05"))
def v04_contiguity_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return validate.stack_messages(segments(spark, d, **BAD), 0.05)


@query(f"""WITH {segments_sql(**BAD)}, s AS (SELECT *, lead(z_start) OVER w - z_end AS gap, row_number() OVER w AS k, row_number() OVER (PARTITION BY part_id ORDER BY z_start DESC, seq DESC) AS b FROM segments WINDOW w AS (PARTITION BY part_id ORDER BY z_start, seq)),
    t AS (SELECT part_id, count(*) FILTER (gap > 1e-6) AS n_gaps, count(*) FILTER (gap < -1e-6) AS n_overlaps, count(*) FILTER (od_diameter <= 0) AS n_bad_od, count(*) FILTER (id_diameter > od_diameter + 1e-6) AS n_bad_id,
      max(z_start) FILTER (k = 1) = min(z_start) AS first_is_min, max(z_end) FILTER (b = 1) = max(z_end) AS last_is_max FROM s GROUP BY part_id)
    SELECT *, n_gaps + n_overlaps + n_bad_od + n_bad_id = 0 AND first_is_min AND last_is_max AS ok FROM t""")
def v03_stack_validity(spark: SparkSession, d: str) -> DataFrame:
    return validate.stack_validity(segments(spark, d, **BAD))


@query(f"""WITH {SEG}, t AS (SELECT part_id, max(z_end) - min(z_start) AS l, max(od_diameter) AS o FROM segments GROUP BY part_id)
    SELECT part_id, l BETWEEN 0.8 AND 2.0 AS length_ok, o BETWEEN 1.0 AND 3.0 AS od_ok, l BETWEEN 0.8 AND 2.0 AND o BETWEEN 1.0 AND 3.0 AS passed,
      concat_ws(',', CASE WHEN l NOT BETWEEN 0.8 AND 2.0 THEN 'TOTAL_LENGTH' END, CASE WHEN o NOT BETWEEN 1.0 AND 3.0 THEN 'MAX_OD' END) AS reasons FROM t""")
def v11_sanity_gates(spark: SparkSession, d: str) -> DataFrame:
    t = segments(spark, d).groupBy("part_id").agg((F.max("z_end") - F.min("z_start")).alias("total_length"), F.max("od_diameter").alias("max_od"))
    return validate.sanity_gates(t)


@query(f"""WITH {SEG}, t AS (SELECT part_id, {Q6("sum((z_end - z_start) * confidence) / sum(z_end - z_start)")} AS overall, count(*) FILTER (confidence < 0.5) AS n_low,
      count(*) FILTER (od_diameter - id_diameter < 0.1) AS n_thin FROM segments GROUP BY part_id),
    r AS (SELECT *, concat_ws(',', CASE WHEN overall < 0.75 THEN 'LOW_OVERALL' END, CASE WHEN n_low > 0 THEN 'LOW_SEGMENT' END, CASE WHEN n_thin > 1 THEN 'THIN_WALLS' END) AS reasons FROM t)
    SELECT part_id, overall, n_low, n_thin, CASE WHEN reasons = '' THEN 'approved' ELSE 'needs_review' END AS status, reasons FROM r""")
def v12_a14_step_gate(spark: SparkSession, d: str) -> DataFrame:
    """The flags are given with the segments, by a rule on diameters."""
    thin = F.when(F.col("od_diameter") - F.col("id_diameter") < 0.1, F.array(F.lit("thin_wall")))
    return validate.step_gate(segments(spark, d).withColumn("flags", thin))


def _percentile_sql(p: float, name: str) -> str:
    return f"""WITH {SEG}, s AS (SELECT part_id, od_diameter AS v, sum(round((z_end - z_start) * 1000)) OVER (PARTITION BY part_id ORDER BY od_diameter RANGE UNBOUNDED PRECEDING) AS run, sum(round((z_end - z_start) * 1000)) OVER (PARTITION BY part_id) AS total FROM segments WHERE z_end > z_start)
        SELECT part_id, min(v) AS {name} FROM s WHERE run >= {p} * total GROUP BY part_id"""


def _weighed(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).withColumn("mils", F.round((F.col("z_end") - F.col("z_start")) * 1000))


@query(_percentile_sql(0.85, "p85"))
def a08_weighted_p85(spark: SparkSession, d: str) -> DataFrame:
    return weighted.weighted_percentile(_weighed(spark, d), ["part_id"], "od_diameter", "mils", 0.85, "p85")


@query(_percentile_sql(0.5, "median"))
def a09_weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return weighted.weighted_percentile(_weighed(spark, d), ["part_id"], "od_diameter", "mils", 0.5, "median")


@query(f"""WITH {SEG}, s AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY part_id ORDER BY z_end - z_start DESC, seq) AS k FROM segments WINDOW w AS (PARTITION BY part_id))
    SELECT part_id, seq, {Q6("z_end - z_start")} AS length FROM s WHERE k = 1""")
def t04_longest_segment(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("part_id").orderBy((F.col("z_end") - F.col("z_start")).desc(), "seq")
    return segments(spark, d).withColumn("k", F.row_number().over(by)).where("k = 1").select("part_id", "seq", r6(F.col("z_end") - F.col("z_start")).alias("length"))


@query(f"WITH {SEG} SELECT part_id, seq, row_number() OVER (PARTITION BY part_id ORDER BY z_start, z_end) AS place FROM segments")
def t07_sorted_segments(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("part_id").orderBy("z_start", "z_end")
    return segments(spark, d).select("part_id", "seq", F.row_number().over(by).cast("long").alias("place"))


def rfq_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts, and segments that also carry the z range of their part; one in five has none."""
    part, ranged = Window.partitionBy("part_id"), F.col("part_id") % 5 != 0
    seg = segments(spark, d).withColumn("low_flag", F.col("confidence") < 0.6)
    seg = seg.select("*", F.when(ranged, F.min("z_start").over(part)).alias("z0"), F.when(ranged, F.max("z_end").over(part)).alias("z1"))
    null = F.lit(None).cast("double")
    return parts(spark, d).withColumn("rm_od_allowance", null).withColumn("rm_len_allowance", null), seg


@query(f"""WITH {SEG}, {PARTS_SQL}, span AS (SELECT part_id, min(z_start) AS z0, max(z_end) AS z1 FROM segments GROUP BY part_id),
    p AS (SELECT parts.*, CASE WHEN has_z_range THEN z0 END AS z0, CASE WHEN has_z_range THEN z1 END AS z1, CASE WHEN units = 'mm' THEN 25.4 ELSE 1 END::DOUBLE AS u FROM parts LEFT JOIN span USING (part_id)),
    s0 AS (SELECT p.*, seq, z_start / u AS a, z_end / u AS b, od_diameter / u AS od, id_diameter / u AS bore, confidence, coalesce(confidence < 0.6, false) AS low FROM p LEFT JOIN segments USING (part_id)),
    s1 AS (SELECT *, greatest(0, coalesce(b, 0) - coalesce(a, 0)) AS len, z0 IS NOT NULL AND z1 IS NOT NULL AS ranged, CASE WHEN z0 IS NOT NULL AND z1 IS NOT NULL THEN (z1 - z0) / u ELSE max(b) OVER w - min(a) OVER w END AS fl FROM s0 WINDOW w AS (PARTITION BY part_id)),
    s2 AS (SELECT *, len >= CASE WHEN fl > 0 THEN greatest(0.02, 0.01 * fl) ELSE 0.02 END AS lng FROM s1),
    s3 AS (SELECT *, seq IS NOT NULL AND (lng OR NOT bool_or(lng) OVER (PARTITION BY part_id)) AS pool0 FROM s2),
    s4 AS (SELECT *, pool0 AND (count(*) FILTER (pool0) OVER w < 2 OR NOT bool_or(pool0 AND NOT low) OVER w OR NOT low) AS pool FROM s3 WINDOW w AS (PARTITION BY part_id)),
    s5 AS (SELECT *, max(od) FILTER (pool AND od > 0) OVER (PARTITION BY part_id) AS mo, coalesce(fl > 0 AND len > 0 AND bore > 0 AND od > 0 AND bore < od AND bore >= greatest(0.02, 0.01 * od), false) AS isb FROM s4),
    s6 AS (SELECT *, coalesce(pool AND abs(od - mo) <= 1e-6, false) AS atm, CASE WHEN pool AND od > 0 THEN len ELSE 0 END AS wo, CASE WHEN isb THEN len ELSE 0 END AS wi FROM s5),
    s7 AS (SELECT *, sum(wo) OVER (w ORDER BY od RANGE UNBOUNDED PRECEDING) AS ro, sum(wi) OVER (w ORDER BY bore RANGE UNBOUNDED PRECEDING) AS ri, sum(wo) OVER w AS ao, sum(wi) OVER w AS ai FROM s6 WINDOW w AS (PARTITION BY part_id)),
    m AS (SELECT part_id, part_no, units, method = 'anchor_dimension' AS anchor, validation_passed AS valid, overall, crop_partial, ranged, fl, mo, count(seq) AS n, coalesce(max(confidence) FILTER (atm), 0) AS sc, coalesce(sum(len) FILTER (atm), 0) AS support,
      min(od) FILTER (wo > 0 AND ro >= 0.5 * ao - 1e-9) AS med, min(bore) FILTER (wi > 0 AND ri >= 0.85 * ai - 1e-9) AS p85, sum(wi) AS bl FROM s7 GROUP BY ALL),
    n AS (SELECT *, n = 0 AND NOT ranged AS none, NOT coalesce(fl > 0, false) AS bad_len, NOT coalesce(mo > 0, false) AS bad_od, coalesce(p85 > greatest(0, mo - 0.02), false) AS clamped, p85 IS NOT NULL AS hb FROM m),
    o AS (SELECT *, coalesce(CASE WHEN clamped THEN greatest(0, mo - 0.02) ELSE p85 END, 0) AS fid, CASE WHEN hb THEN least(greatest(100.0 * bl / fl, 0), 100) ELSE 0 END AS cov, coalesce(NOT bad_len AND mo > med + 0.2 AND support / fl < 0.05, false) AS spike FROM n),
    q AS (SELECT *, least(greatest(0.6::DOUBLE + CASE WHEN anchor THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN valid THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN sc > 0.85 THEN 0.05 ELSE 0 END::DOUBLE - CASE WHEN overall < 0.7 THEN 0.15 ELSE 0 END::DOUBLE - CASE WHEN spike THEN 0.1 ELSE 0 END::DOUBLE, 0), 1) AS oc,
      least(greatest(0.6::DOUBLE + CASE WHEN anchor THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN valid THEN 0.1 ELSE 0 END::DOUBLE - CASE WHEN crop_partial THEN 0.2 ELSE 0 END::DOUBLE, 0), 1) AS lc,
      least(greatest(0.35::DOUBLE + CASE WHEN hb THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN cov > 50 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN anchor THEN 0.15 ELSE 0 END::DOUBLE - CASE WHEN clamped THEN 0.2 ELSE 0 END::DOUBLE, 0), 1) AS ic, units NOT IN ('in', 'mm') AS unk FROM o)
    SELECT part_id, CASE WHEN NOT none THEN floor(mo * 1000 + 0.5) / 1000.0::DOUBLE END AS finish_od, CASE WHEN none OR mo IS NULL THEN 0 ELSE oc END AS finish_od_conf,
      CASE WHEN NOT none THEN floor(fl * 1000 + 0.5) / 1000.0::DOUBLE END AS finish_len, CASE WHEN none OR fl IS NULL THEN 0 ELSE lc END AS finish_len_conf,
      CASE WHEN none THEN 0 ELSE floor(fid * 1000 + 0.5) / 1000.0::DOUBLE END AS finish_id, CASE WHEN none THEN 0 ELSE ic END AS finish_id_conf,
      CASE WHEN NOT none THEN floor(ceil((mo + 0.1)::VARCHAR::DECIMAL(20,17) * 20)::DOUBLE / 20 * 1000 + 0.5) / 1000.0::DOUBLE END AS rm_od, CASE WHEN none OR mo IS NULL THEN 0 ELSE least(oc, 0.85) END AS rm_od_conf,
      CASE WHEN NOT none THEN floor(ceil((fl + 0.35)::VARCHAR::DECIMAL(20,17) * 10)::DOUBLE / 10 * 1000 + 0.5) / 1000.0::DOUBLE END AS rm_len, CASE WHEN none OR fl IS NULL THEN 0 ELSE least(lc, 0.85) END AS rm_len_conf,
      CASE WHEN NOT valid OR none OR bad_len OR bad_od OR oc < 0.65 OR lc < 0.65 THEN 'REJECTED' WHEN oc >= 0.85 AND lc >= 0.85 AND anchor AND NOT (fid > 0 AND ic < 0.65) AND NOT unk THEN 'AUTO_FILLED' ELSE 'NEEDS_REVIEW' END AS status,
      concat_ws(',', CASE WHEN trim(part_no) = '' THEN 'INVALID_PART_NO' END, CASE WHEN unk THEN 'UNKNOWN_UNITS' END, CASE WHEN none THEN 'INSUFFICIENT_GEOMETRY' END, CASE WHEN NOT valid THEN 'VALIDATION_FAILED' END,
        CASE WHEN bad_len AND NOT none THEN 'INVALID_FINISH_LEN' END, CASE WHEN bad_od AND NOT none THEN 'INVALID_FINISH_OD' END, CASE WHEN clamped THEN 'ID_AUTO_CLAMPED' END, CASE WHEN spike THEN 'OD_SPIKE_SUSPECT' END,
        CASE WHEN NOT ranged AND n > 0 THEN 'Z_RANGE_MISSING_FALLBACK' END, CASE WHEN NOT anchor AND NOT none THEN 'SCALE_ESTIMATED' END, CASE WHEN fid > 0 AND cov < 50 THEN 'LOW_BORE_COVERAGE' END, CASE WHEN fid > 0 AND ic < 0.65 THEN 'LOW_CONF_FINISH_ID' END) AS reasons,
      floor(cov * 1000 + 0.5) / 1000.0::DOUBLE AS coverage FROM q""")
def rfq_autofill(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: A8-A13, M10, M11, P6-P10, P15, P16."""
    return rfq.autofill(*rfq_input(spark, d))


@query(f"""WITH {SEG}, s AS (SELECT *, coalesce(confidence < 0.6, false) AS low, z_end - z_start AS l, max(z_end) OVER w - min(z_start) OVER w AS fl FROM segments WINDOW w AS (PARTITION BY part_id)),
    p AS (SELECT *, l >= greatest(0.02, 0.01 * fl) AS g FROM s), q AS (SELECT *, g AND (NOT low OR count(*) FILTER (g) OVER w < 2 OR NOT bool_or(g AND NOT low) OVER w) AS pool FROM p WINDOW w AS (PARTITION BY part_id)),
    m AS (SELECT *, max(od_diameter) FILTER (pool) OVER (PARTITION BY part_id) AS finish_od FROM q)
    SELECT part_id, finish_od, max(confidence) FILTER (pool AND abs(od_diameter - finish_od) <= 1e-6) AS seg_conf FROM m GROUP BY ALL""")
def a10_a11_robust_od(spark: SparkSession, d: str) -> DataFrame:
    p, seg = rfq_input(spark, d)
    out = rfq._measured(p.withColumn("units", F.lit("in")).withColumn("z0", F.lit(None).cast("double")), seg, rfq.DEFAULT)
    return out.where("n_segments > 0").select("part_id", F.col("max_od").alias("finish_od"), "seg_conf")


@query(f"""WITH {SEG}, s AS (SELECT *, z_end - z_start AS l, max(z_end) OVER w - min(z_start) OVER w AS fl FROM segments WINDOW w AS (PARTITION BY part_id)),
    b AS (SELECT * FROM s WHERE l > 0 AND id_diameter > 0 AND id_diameter < od_diameter AND id_diameter >= greatest(0.02, 0.01 * od_diameter))
    SELECT part_id, {Q6("least(100.0 * sum(l) / any_value(fl), 100)")} AS coverage, count(*) AS n FROM b GROUP BY part_id""")
def a12_bore_coverage(spark: SparkSession, d: str) -> DataFrame:
    part = Window.partitionBy("part_id")
    s = segments(spark, d).withColumn("l", F.col("z_end") - F.col("z_start")).withColumn("fl", F.max("z_end").over(part) - F.min("z_start").over(part))
    b = s.where("l > 0 and id_diameter > 0 and id_diameter < od_diameter and id_diameter >= greatest(0.02D, 0.01D * od_diameter)")
    return b.groupBy("part_id").agg(r6(F.least(100.0 * F.sum("l") / F.first("fl"), F.lit(100.0))).alias("coverage"), F.count("*").alias("n"))


@query(f"""WITH {segments_sql(small=True)}, d AS (SELECT part_id, seq, od_diameter, id_diameter FROM segments)
    SELECT part_id, median(od_diameter) FILTER (od_diameter > 0) AS od_median, {Q6("stddev_pop(od_diameter) FILTER (od_diameter > 0)")} AS od_std, {Q6("avg(od_diameter) FILTER (od_diameter > 0)")} AS od_mean,
      coalesce(median(id_diameter) FILTER (id_diameter > 0), 0) AS id_median FROM d GROUP BY part_id""")
def a19_robust_stats(spark: SparkSession, d: str) -> DataFrame:
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    return segments(spark, d, small=True).groupBy("part_id").agg(F.median(pos("od_diameter")).alias("od_median"), r6(F.stddev_pop(pos("od_diameter"))).alias("od_std"), r6(F.avg(pos("od_diameter"))).alias("od_mean"), F.coalesce(F.median(pos("id_diameter")), F.lit(0.0)).alias("id_median"))


@query("""SELECT user_id, count(*) FILTER (value <= 45) AS n_internal, count(*) FILTER (value > 55) AS n_external, count(*) FILTER (value <= 45) > count(*) FILTER (value > 55) AS is_internal
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 3 GROUP BY user_id""")
def a20_majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Three samples a face, ambiguous from 45 to 55; a tie is external."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("k", F.row_number().over(by)).where("k <= 3")
    return fe.majority_vote(e.select("user_id", F.when(F.col("value") <= 45, True).when(F.col("value") > 55, False).alias("internal")), "user_id")
