"""Quotation auto-fill for all parts at once: finish and raw-material dimensions with confidence, status and reasons.

Windows and the final aggregate are all on part_id, so the plan has one shuffle of the segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.functions import geometry as g
from swarf.operators.validate import listed
from swarf.params import DEFAULT, Params

#: Running lengths that reach a share exactly count, whatever the order of a sum leaves in the last bits.
TIE = 1e-9


def _measured(parts: DataFrame, seg: DataFrame, p: Params) -> DataFrame:
    """One row a part: what its segments say, in inches. Parts without segments stay."""
    more = [c for c in ("z0", "z1") if c not in parts.columns]
    s = parts.join(seg.select("part_id", "seq", "z_start", "z_end", "od_diameter", "id_diameter", "confidence", "low_flag", *more), "part_id", "left")
    inch = lambda c: g.to_inches(F.col(c), F.col("units"))
    part = Window.partitionBy("part_id")
    s = s.select("*", inch("z_start").alias("a"), inch("z_end").alias("b"), inch("od_diameter").alias("od"), inch("id_diameter").alias("bore"))
    s = s.withColumn("len", F.greatest(F.lit(0.0), F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))))
    s = s.withColumn("ranged", F.col("z0").isNotNull() & F.col("z1").isNotNull())
    s = s.withColumn("finish_len", F.when(F.col("ranged"), g.to_inches(F.col("z1") - F.col("z0"), F.col("units"))).otherwise(F.max("b").over(part) - F.min("a").over(part)))
    s = s.withColumn("gate", F.when(F.col("finish_len") > 0, F.greatest(F.lit(0.02), 0.01 * F.col("finish_len"))).otherwise(0.02))
    s = s.withColumn("long", F.col("len") >= F.col("gate"))
    s = s.withColumn("pool", F.when(F.max("long").over(part), F.col("long")).otherwise(F.lit(True)) & F.col("seq").isNotNull())
    low = F.coalesce("low_flag", F.lit(False))
    s = s.withColumn("pool", F.col("pool") & ((F.count_if("pool").over(part) < 2) | ~F.max(F.col("pool") & ~low).over(part) | ~low))
    s = s.withColumn("max_od", F.max(F.when(F.col("pool") & (F.col("od") > 0), F.col("od"))).over(part))
    s = s.withColumn("at_max", F.col("pool") & (F.abs(F.col("od") - F.col("max_od")) <= 1e-6))
    tiny = F.greatest(F.lit(0.02), 0.01 * F.col("od"))
    s = s.withColumn("is_bore", (F.col("finish_len") > 0) & (F.col("len") > 0) & (F.col("bore") > 0) & (F.col("od") > 0) & (F.col("bore") < F.col("od")) & (F.col("bore") >= tiny))
    s = s.withColumn("w_od", F.when(F.col("pool") & (F.col("od") > 0), F.col("len")).otherwise(0.0)).withColumn("w_id", F.when(F.col("is_bore"), F.col("len")).otherwise(0.0))
    run = lambda w, v: F.sum(w).over(part.orderBy(v).rangeBetween(Window.unboundedPreceding, 0))
    s = s.select("*", run("w_od", "od").alias("run_od"), run("w_id", "bore").alias("run_id"), F.sum("w_od").over(part).alias("all_od"), F.sum("w_id").over(part).alias("all_id"))
    keys = ["part_id", "part_no", "units", "method", "validation_passed", "overall", "crop_partial", "ranged", "rm_od_allowance", "rm_len_allowance", "finish_len", "max_od"]
    return s.groupBy(*keys).agg(
        F.count("seq").alias("n_segments"), F.coalesce(F.max(F.when(F.col("at_max"), F.col("confidence"))), F.lit(0.0)).alias("seg_conf"), F.coalesce(F.sum(F.when(F.col("at_max"), F.col("len"))), F.lit(0.0)).alias("support"),
        F.min(F.when((F.col("w_od") > 0) & (F.col("run_od") >= 0.5 * F.col("all_od") - TIE), F.col("od"))).alias("od_median"), F.min(F.when((F.col("w_id") > 0) & (F.col("run_id") >= 0.85 * F.col("all_id") - TIE), F.col("bore"))).alias("id_p85"), F.sum("w_id").alias("bore_len"),
    )


def autofill(parts: DataFrame, seg: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row a part: five fields with confidences, status, reasons, coverage.

    parts: part_id, part_no, units, method, validation_passed (null is true), overall, crop_partial, z0, z1 (nullable),
    rm_od_allowance, rm_len_allowance (null: defaults). seg: part_id, seq, z_start, z_end, od_diameter, id_diameter,
    confidence, low_flag, and z0, z1 where parts lack them. Null units are inches, a null method is no anchor, and a null part
    number is an empty one.
    """
    given = {"units": "in", "method": "unknown", "part_no": ""}
    m = _measured(parts.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in given.items()}), seg, p)
    c = F.col
    poor = lambda x: F.coalesce(x, F.lit(False))
    m = m.withColumn("valid", F.coalesce("validation_passed", F.lit(True))).withColumn("anchor", c("method") == "anchor_dimension")
    m = m.withColumn("none", (c("n_segments") == 0) & ~c("ranged")).withColumn("bad_len", ~poor(c("finish_len") > 0)).withColumn("bad_od", ~poor(c("max_od") > 0))
    m = m.withColumn("overall2", g.clamp(F.when(F.coalesce("overall", F.lit(0.0)) <= 0, F.lit(0.55)).otherwise(c("overall"))))
    m = m.withColumn("has_bore", c("id_p85").isNotNull()).withColumn("room", F.greatest(F.lit(0.0), c("max_od") - 0.02))
    m = m.withColumn("clamped", poor(c("id_p85") > c("room"))).withColumn("finish_id", F.coalesce(F.when(c("clamped"), c("room")).otherwise(c("id_p85")), F.lit(0.0)))
    m = m.withColumn("coverage", F.when(c("has_bore"), g.clamp(100.0 * c("bore_len") / c("finish_len"), 0.0, 100.0)).otherwise(0.0))
    m = m.withColumn("spike", poor(~c("bad_len") & (c("max_od") > c("od_median") + 0.20) & (c("support") / c("finish_len") < 0.05)))
    plus = lambda cond, x: F.when(cond, F.lit(x)).otherwise(0.0)
    od = 0.60 + plus(c("anchor"), 0.25) + plus(c("valid"), 0.10) + plus(c("seg_conf") > 0.85, 0.05) - plus(c("overall2") < 0.70, 0.15) - plus(c("spike"), 0.10)
    length = 0.60 + plus(c("anchor"), 0.25) + plus(c("valid"), 0.10) - plus(poor(c("crop_partial")), 0.20)
    bore = 0.35 + plus(c("has_bore"), 0.20) + plus(c("coverage") > 50, 0.10) + plus(c("anchor"), 0.15) - plus(c("clamped"), 0.20)
    m = m.withColumn("od_c", g.clamp(od)).withColumn("len_c", g.clamp(length)).withColumn("id_c", g.clamp(bore))
    low_id = (c("finish_id") > 0) & (c("id_c") < 0.65)
    unknown = ~c("units").isin("in", "mm")
    fallback = ~c("ranged") & (c("n_segments") > 0)
    head = ((F.trim("part_no") == "", "INVALID_PART_NO"), (unknown, "UNKNOWN_UNITS"), (c("none"), "INSUFFICIENT_GEOMETRY"), (~c("valid"), "VALIDATION_FAILED"))
    rest = ((c("bad_len"), "INVALID_FINISH_LEN"), (c("bad_od"), "INVALID_FINISH_OD"), (c("clamped"), "ID_AUTO_CLAMPED"), (c("spike"), "OD_SPIKE_SUSPECT"), (fallback, "Z_RANGE_MISSING_FALLBACK"), (~c("anchor"), "SCALE_ESTIMATED"), ((c("finish_id") > 0) & (c("coverage") < 50), "LOW_BORE_COVERAGE"), (low_id, "LOW_CONF_FINISH_ID"))
    status = (
        F.when(~c("valid") | c("none") | c("bad_len") | c("bad_od") | (c("od_c") < 0.65) | (c("len_c") < 0.65), "REJECTED")
        .when((c("od_c") >= 0.85) & (c("len_c") >= 0.85) & c("anchor") & ~low_id & ~unknown, "AUTO_FILLED").otherwise("NEEDS_REVIEW")
    )
    field = lambda x: F.when(~c("none"), g.round3(x))
    conf = lambda value, x: F.when(c("none") | value.isNull(), 0.0).otherwise(x)
    rm_od = g.ceil_to_step(c("max_od") + F.coalesce("rm_od_allowance", F.lit(p.rm_od_allowance)), p.rm_od_step)
    rm_len = g.ceil_to_step(c("finish_len") + F.coalesce("rm_len_allowance", F.lit(p.rm_len_allowance)), p.rm_len_step)
    return m.select(
        "part_id", field(c("max_od")).alias("finish_od"), conf(c("max_od"), c("od_c")).alias("finish_od_conf"), field(c("finish_len")).alias("finish_len"), conf(c("finish_len"), c("len_c")).alias("finish_len_conf"),
        F.when(c("none"), 0.0).otherwise(g.round3(c("finish_id"))).alias("finish_id"), F.when(c("none"), 0.0).otherwise(c("id_c")).alias("finish_id_conf"),
        field(rm_od).alias("rm_od"), conf(c("max_od"), F.least(c("od_c"), F.lit(0.85))).alias("rm_od_conf"), field(rm_len).alias("rm_len"), conf(c("finish_len"), F.least(c("len_c"), F.lit(0.85))).alias("rm_len_conf"),
        status.alias("status"), F.array_join(F.when(c("none"), listed(*head)).otherwise(listed(*head, *rest)), ",").alias("reasons"), g.round3(c("coverage")).alias("coverage"),
    )
