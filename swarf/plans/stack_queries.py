"""Registered queries of the normaliser and of envelopes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarf.operators import normalize, signal
from swarf.plans.part_queries import Q6, WALL
from swarf.plans.registry import query
from swarf.sources.tables import r6, segments, segments_sql, table

CLOSE = {"short": True, "small": True, "gaps": True}
SNAP = """sn0 AS (SELECT *, max(z_end) OVER p - min(z_start) OVER p AS range, min(z_start) OVER p AS low, lead(z_start) OVER w AS nxt, lag(z_end) OVER w AS prv FROM segments WINDOW p AS (PARTITION BY part_id), w AS (PARTITION BY part_id ORDER BY z_start, seq)),
    sn1 AS (SELECT *, CASE WHEN range > 0 THEN greatest(0.02, 0.005 * range) ELSE -1 END AS eps FROM sn0),
    sn AS (SELECT *, CASE WHEN coalesce(abs(z_start - prv) < eps, false) THEN (prv + z_start) / 2 ELSE z_start END - CASE WHEN range > 0 THEN low ELSE 0 END AS z0,
      CASE WHEN coalesce(abs(nxt - z_end) < eps, false) THEN (z_end + nxt) / 2 ELSE z_end END - CASE WHEN range > 0 THEN low ELSE 0 END AS z1,
      coalesce(abs(nxt - z_end) < eps, false) OR coalesce(abs(z_start - prv) < eps, false) AS snapped FROM sn1)"""


@query(f"WITH {segments_sql(gaps=True)}, {SNAP} SELECT part_id, seq, {Q6('z0')} AS z0, {Q6('z1')} AS z1, snapped FROM sn")
def w02_w03_snap_and_shift(spark: SparkSession, d: str) -> DataFrame:
    return normalize.snap(segments(spark, d, gaps=True)).select("part_id", "seq", r6(F.col("z0")).alias("z0"), r6(F.col("z1")).alias("z1"), "snapped")


SNAPPED = "SELECT part_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY part_id) AS n, z0, z1, od_diameter AS od, id_diameter AS bore, 1 AS k, snapped, confidence AS base, range FROM sn WINDOW w AS (PARTITION BY part_id ORDER BY z_start, seq)"


def _fold(short: bool, similar: bool, of: str = SNAPPED) -> str:
    """The same pass as a recursion: one row for each state of the last merged segment."""
    mean = lambda c: f"CASE WHEN (a.z1 - a.z0) + (b.z1 - b.z0) > 0 THEN (a.{c} * (a.z1 - a.z0) + b.{c} * (b.z1 - b.z0)) / ((a.z1 - a.z0) + (b.z1 - b.z0)) ELSE a.{c} END"
    both = lambda: f"a.z0, b.z1, {mean('od')} AS od, {mean('bore')} AS bore, a.k + b.k AS k, a.snapped OR b.snapped AS snapped, a.base + b.base AS base"
    brief = f"{'true' if short else 'false'} AND b.i < b.n AND b.z1 - b.z0 < greatest(0.005, 0.002 * b.range)"
    return f"""s AS ({of}),
    pairs AS (SELECT a.part_id, a.i, {both()} FROM s a JOIN s b ON a.part_id = b.part_id AND b.i = a.i + 1),
    f AS (SELECT part_id, 0::BIGINT AS step, 1::BIGINT AS next, 0::BIGINT AS grp, 0::DOUBLE AS z0, 0::DOUBLE AS z1, 0::DOUBLE AS od, 0::DOUBLE AS bore, 0 AS k, false AS snapped, 0::DOUBLE AS base FROM s WHERE i = 1
      UNION ALL
      SELECT * FROM (SELECT b.part_id, a.step + 1 AS step, CASE WHEN {brief} THEN a.next + 2 ELSE a.next + 1 END AS next,
        CASE WHEN NOT ({brief}) AND alike THEN a.grp ELSE a.grp + 1 END AS grp,
        CASE WHEN {brief} THEN p.z0 WHEN alike THEN a.z0 ELSE b.z0 END AS z0, CASE WHEN {brief} THEN p.z1 ELSE b.z1 END AS z1,
        CASE WHEN {brief} THEN p.od WHEN alike THEN {mean('od')} ELSE b.od END AS od, CASE WHEN {brief} THEN p.bore WHEN alike THEN {mean('bore')} ELSE b.bore END AS bore,
        CASE WHEN {brief} THEN p.k WHEN alike THEN a.k + b.k ELSE b.k END AS k, CASE WHEN {brief} THEN p.snapped WHEN alike THEN a.snapped OR b.snapped ELSE b.snapped END AS snapped,
        CASE WHEN {brief} THEN p.base WHEN alike THEN a.base + b.base ELSE b.base END AS base
        FROM (SELECT f.*, s2.od AS bod, s2.bore AS bbore, {'true' if similar else 'false'} AND f.grp > 0 AND abs(f.od - s2.od) < greatest(0.02, 0.01 * ((f.od + s2.od) / 2)) AND abs(f.bore - s2.bore) < greatest(0.02, 0.01 * ((f.od + s2.od) / 2)) AS alike FROM f JOIN s s2 ON s2.part_id = f.part_id AND s2.i = f.next) a
        JOIN s b ON b.part_id = a.part_id AND b.i = a.next LEFT JOIN pairs p ON p.part_id = a.part_id AND p.i = a.next)),
    m AS (SELECT part_id, grp AS place, arg_max(z0, step) AS z0, arg_max(z1, step) AS z1, arg_max(od, step) AS od, arg_max(bore, step) AS bore, arg_max(k, step) AS k, arg_max(snapped, step) AS snapped, arg_max(base, step) AS base FROM f WHERE grp > 0 GROUP BY part_id, grp)"""


MERGED = f"WITH RECURSIVE {segments_sql(**CLOSE)}, {SNAP}, {_fold(True, True)}"


@query(f"{MERGED} SELECT part_id, place, {Q6('z0')} AS z0, {Q6('z1')} AS z1, {Q6('od')} AS od, {Q6('bore')} AS bore, k::BIGINT AS k, snapped FROM m")
def w04_w06_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Short and similar segments merged in one pass, with how many each came from."""
    m = normalize.normalise(segments(spark, d, **CLOSE))
    return m.select("part_id", "place", *[r6(F.col(c)).alias(c) for c in ("z0", "z1", "od", "bore")], F.col("k").cast("long").alias("k"), "snapped")


TWICE = _fold(False, True, "SELECT part_id, place AS i, count(*) OVER (PARTITION BY part_id) AS n, z0, z1, od, bore, k, snapped, base, range FROM one JOIN (SELECT part_id, any_value(range) AS range FROM sn GROUP BY part_id) USING (part_id)")


@query(f"WITH RECURSIVE {segments_sql(**CLOSE)}, {SNAP}, one AS (WITH RECURSIVE {_fold(True, False)} SELECT * FROM m), {TWICE} SELECT part_id, place, {Q6('z0')} AS z0, {Q6('z1')} AS z1, {Q6('od')} AS od, {Q6('bore')} AS bore, k::BIGINT AS k, snapped FROM m")
def w04_w06_two_pass(spark: SparkSession, d: str) -> DataFrame:
    """The variant that merges short segments first."""
    m = normalize.normalise(segments(spark, d, **CLOSE), two_pass=True)
    return m.select("part_id", "place", *[r6(F.col(c)).alias(c) for c in ("z0", "z1", "od", "bore")], F.col("k").cast("long").alias("k"), "snapped")


MW = WALL.replace("od_diameter", "od").replace("id_diameter", "bore")


PENALISED = f"""{MERGED}, r AS (SELECT m.*, range, {MW} AS wall, (z1 - z0) / range AS rel FROM m JOIN (SELECT part_id, any_value(range) AS range FROM sn GROUP BY part_id) USING (part_id)),
    c AS (SELECT *, least(greatest(base / k - (CASE WHEN k > 1 THEN least(0.2::DOUBLE, 0.05::DOUBLE * (k - 1)) ELSE 0 END + CASE WHEN snapped THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN wall > 0 AND wall < 0.05 THEN 0.1::DOUBLE * (1 - wall / 0.05::DOUBLE) ELSE 0 END
      + CASE WHEN rel < 0.02 THEN 0.1::DOUBLE * (1 - rel / 0.02::DOUBLE) ELSE 0 END), 0), 1) AS conf FROM r)"""


@query(f"""{PENALISED}
    SELECT part_id, place, {Q6('conf')} AS confidence, concat_ws(',', CASE WHEN k > 1 THEN 'auto_merged' END, CASE WHEN wall > 0 AND wall < 0.05 THEN 'thin_wall' END, CASE WHEN rel < 0.02 THEN 'short_segment' END, CASE WHEN floor(conf * 1e6 + 0.5) / 1e6 < 0.6 THEN 'low_confidence' END) AS flags FROM c""")
def m03_m04_merged_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Penalties and flags; the last flag compares six decimals, so that both engines agree at the limit."""
    m = normalize.confidence(normalize.normalise(segments(spark, d, **CLOSE)))
    conf = r6(F.col("confidence"))
    flags = F.concat(F.filter("flags", lambda f: f != "low_confidence"), F.when(conf < 0.6, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>")))
    return m.select("part_id", "place", conf.alias("confidence"), F.array_join(flags, ",").alias("flags"))


@query(f"""{PENALISED} SELECT part_id, {Q6('CASE WHEN sum(z1 - z0) > 0 THEN sum((z1 - z0) * conf) / sum(z1 - z0) ELSE avg(conf) END + 1e-10')} AS overall, {Q6('sum(z1 - z0)')} AS total_length FROM c GROUP BY part_id""")
def a14_overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    # the nudge keeps exact ties of the sixth decimal alike in both engines
    t = normalize.overall(normalize.confidence(normalize.normalise(segments(spark, d, **CLOSE))))
    return t.select("part_id", r6(F.col("overall") + 1e-10).alias("overall"), r6(F.col("total_length")).alias("total_length"))


def series(spark: SparkSession, d: str) -> DataFrame:
    """Users as views, their days as bins: the largest value is the outside, the smallest the bore."""
    e = table(spark, d, "events").withColumn("day", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400))
    s = e.groupBy(F.col("user_id").alias("view_id"), F.col("day").alias("bin")).agg(F.max("value").alias("od_radius"), F.min("value").alias("id_radius"))
    return s.withColumn("axial_position", F.col("bin") * 3 + 1.5)


SERIES = "series AS (SELECT user_id AS view_id, floor(epoch(ts) / 86400)::BIGINT AS bin, max(value) AS od_radius, min(value) AS id_radius, floor(epoch(ts) / 86400)::BIGINT * 3 + 1.5::DOUBLE AS axial_position FROM events GROUP BY ALL)"
MEDIAN = """sm0 AS (SELECT *, count(*) OVER (PARTITION BY view_id) AS n FROM series),
    sm AS (SELECT *, CASE WHEN n < 20 THEN od_radius WHEN n < 40 THEN quantile_cont(od_radius, 0.5) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE quantile_cont(od_radius, 0.5) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS smoothed FROM sm0 WINDOW w AS (PARTITION BY view_id ORDER BY bin))"""
POINTS = """cp0 AS (SELECT *, lag(smoothed) OVER w AS prv, row_number() OVER w - 1 AS i, avg(smoothed) OVER (PARTITION BY view_id) AS mean FROM sm WHERE n >= 2 WINDOW w AS (PARTITION BY view_id ORDER BY bin)),
    cp1 AS (SELECT *, i = 0 OR i = n - 1 OR coalesce(smoothed > 0 AND prv > 0 AND abs(smoothed - prv) / greatest(smoothed, prv) > 0.005, false) AS point, floor(abs(smoothed - mean) * 1e9 + 0.5) AS off FROM cp0),
    cp2 AS (SELECT *, first_value(i) OVER (PARTITION BY view_id ORDER BY off DESC, i) AS far, count(*) FILTER (point) OVER (PARTITION BY view_id) AS points FROM cp1),
    cp AS (SELECT view_id, bin FROM cp2 WHERE point OR points = 2 AND n > 10 AND i = far AND far > n * 0.1 AND far < n * 0.9)"""


@query(f"WITH {SERIES}, {MEDIAN} SELECT view_id, bin, {Q6('smoothed')} AS smoothed FROM sm")
def w09_running_median(spark: SparkSession, d: str) -> DataFrame:
    return signal.running_median(series(spark, d)).select("view_id", "bin", r6(F.col("smoothed")).alias("smoothed"))


@query(f"WITH {SERIES}, {MEDIAN}, {POINTS} SELECT view_id, bin FROM cp")
def w10_change_points(spark: SparkSession, d: str) -> DataFrame:
    return signal.change_points(signal.running_median(series(spark, d)))


@query(f"""WITH {SERIES}, {MEDIAN}, {POINTS}, e AS (SELECT * FROM (SELECT view_id, bin AS f, lead(bin) OVER (PARTITION BY view_id ORDER BY bin) AS t FROM cp) WHERE t - f >= 1),
    g AS (SELECT view_id, f, t, median(od_radius) FILTER (od_radius > 0) AS od, median(id_radius) FILTER (id_radius > 0) AS bore, coalesce(stddev_pop(od_radius) FILTER (od_radius > 0), 0) AS sd, avg(od_radius) FILTER (od_radius > 0) AS mean, min(axial_position) * 0.01::DOUBLE AS z0, max(axial_position) * 0.01::DOUBLE AS z1
      FROM series JOIN e USING (view_id) WHERE bin BETWEEN f AND t GROUP BY ALL HAVING od IS NOT NULL),
    h AS (SELECT *, greatest(od, coalesce(bore, 0)) * 2 * 0.01::DOUBLE AS big, least(od, coalesce(bore, 0)) * 2 * 0.01::DOUBLE AS small FROM g),
    k AS (SELECT *, small > 0 AND (small < greatest(0.01, 0.01 * big) OR small < 0.001) AS clamped FROM h),
    l AS (SELECT *, CASE WHEN clamped THEN 0 ELSE small END AS idd, (z1 - z0) / (max(z1) OVER w - min(z0) OVER w) AS rel FROM k WINDOW w AS (PARTITION BY view_id)),
    n AS (SELECT *, (big - idd) / 2 AS wall, (1 - least(1.0::DOUBLE, sd / (mean + 1e-6::DOUBLE))) * 0.7::DOUBLE + CASE WHEN bore IS NULL THEN CASE WHEN idd = 0 THEN 0.5 ELSE 0.6 END WHEN clamped THEN 0.7 ELSE 0.85 END::DOUBLE * 0.3::DOUBLE AS base FROM l)
    SELECT view_id, f AS from_bin, t AS to_bin, {Q6('z0')} AS z_start, {Q6('z1')} AS z_end, {Q6('big')} AS od_diameter, {Q6('idd')} AS id_diameter, clamped, bore IS NULL AS inferred, {Q6('base')} AS base,
      {Q6('least(greatest(base - (CASE WHEN clamped THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN wall > 0 AND wall < 0.05 THEN 0.1::DOUBLE * (1 - wall / 0.05::DOUBLE) ELSE 0 END + CASE WHEN rel < 0.02 THEN 0.1::DOUBLE * (1 - rel / 0.02::DOUBLE) ELSE 0 END), 0), 1)')} AS confidence FROM n""")
def w11_m01_m02_m05_view_segments(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d)
    out = signal.view_segments(s, signal.change_points(signal.running_median(s)), 0.01)
    six = ("z_start", "z_end", "od_diameter", "id_diameter", "base", "confidence")
    return out.select("view_id", "from_bin", "to_bin", "clamped", "inferred", *[r6(F.col(c)).alias(c) for c in six])


def pixels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("user_id").alias("view_id"), (F.col("event_id") % 200).alias("x"), (F.col("event_id") % 97).alias("y"), F.when(F.col("event_id") % 3 == 0, "id").otherwise("od").alias("kind"))
    return e, e.groupBy("view_id").agg((F.max("y") + 1).alias("height"), F.lit(100.0).alias("axis_x"))


@query("""WITH e AS (SELECT user_id AS view_id, event_id % 200 AS x, event_id % 97 AS y, event_id % 3 = 0 AS bore FROM events), h AS (SELECT view_id, max(y) + 1 AS height FROM e GROUP BY view_id),
    b AS (SELECT view_id, unnest(range(0, greatest(1, (height // 3)::BIGINT))) AS bin FROM h),
    f AS (SELECT view_id, (y // 3)::BIGINT AS bin, max(abs(x - 100.0::DOUBLE)) FILTER (NOT bore) AS od, min(abs(x - 100.0::DOUBLE)) FILTER (bore) AS idr FROM e GROUP BY ALL)
    SELECT view_id, bin, bin * 3 + 1.5::DOUBLE AS axial_position, coalesce(od, 0) AS od_radius, coalesce(idr, 0) AS id_radius FROM b LEFT JOIN f USING (view_id, bin)""")
def w07_w08_axial_bins(spark: SparkSession, d: str) -> DataFrame:
    return signal.axial_bins(*pixels(spark, d))
