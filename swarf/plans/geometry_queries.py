"""Registered queries of features and profiles, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.operators import features as fe
from swarf.operators import profile as pr
from swarf.plans.part_queries import Q6
from swarf.plans.registry import query
from swarf.sources.tables import r6, segments, segments_sql, table

SEG = segments_sql()


def features(spark: SparkSession, d: str) -> DataFrame:
    """Two cylinders a segment: the outside, which reaches on into the next inch for every third, and a bore."""
    s = segments(spark, d)
    one = lambda ext, r, more: F.struct((F.col("seq") * 2 + (0 if ext else 1)).alias("id"), F.lit(ext).alias("is_external"), r.alias("radius"), F.col("z_start").alias("t_min"), (F.col("z_end") + more).alias("t_max"))
    f = F.array(one(True, F.col("od_diameter") / 2, F.when(F.col("seq") % 3 == 0, 1.0).otherwise(0.0)), one(False, F.col("id_diameter") / 2, F.lit(0.0)))
    return s.select("part_id", F.explode(f).alias("f")).select("part_id", "f.*").where("radius > 0")


FEAT = f"""{SEG}, feat AS (SELECT part_id, seq * 2 AS id, true AS is_external, od_diameter / 2 AS radius, z_start AS t_min, z_end + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS t_max FROM segments WHERE od_diameter > 0
    UNION ALL SELECT part_id, seq * 2 + 1, false, id_diameter / 2, z_start, z_end FROM segments WHERE id_diameter > 0)"""
SWEEP = "ends AS (SELECT DISTINCT part_id, unnest([t_min, t_max]) AS z0 FROM feat), iv AS (SELECT * FROM (SELECT part_id, row_number() OVER w AS i, z0, lead(z0) OVER w AS z1 FROM ends WINDOW w AS (PARTITION BY part_id ORDER BY z0)) WHERE z1 IS NOT NULL)"


@query(f"WITH {FEAT}, {SWEEP} SELECT * FROM iv")
def w12_boundary_sweep(spark: SparkSession, d: str) -> DataFrame:
    return fe.sweep(features(spark, d))


@query(f"""WITH {FEAT}, {SWEEP} SELECT part_id, i, z0, z1, 2 * coalesce(max(radius) FILTER (is_external AND t_min <= z0 + 1e-6 AND t_max >= z1 - 1e-6), 0) AS od_diameter,
    2 * coalesce(max(radius) FILTER (NOT is_external AND t_min <= z0 + 1e-6 AND t_max >= z1 - 1e-6), 0) AS id_diameter FROM iv LEFT JOIN feat USING (part_id) GROUP BY ALL""")
def j01_w15_interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Also what W15 intends: of overlapping features the widest holds."""
    return fe.cover(features(spark, d))


def axes(spark: SparkSession, d: str) -> DataFrame:
    """Ten vectors a part: rounded origins and one of a few directions, as unit axes."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") / 10).cast("long").alias("part_id"), F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(6)])
    r = lambda c: F.floor(F.col(c) * 2) / F.lit(2.0)
    e = e.withColumn("a", fe.standard_axis(F.when(F.col("id") % 3 == 0, F.col("e3")).otherwise(0.0), F.when(F.col("id") % 3 == 1, F.col("e4")).otherwise(0.0), F.when(F.col("id") % 3 == 2, F.col("e5")).otherwise(0.0)))
    return e.select("part_id", "id", r("e0").alias("ox"), r("e1").alias("oy"), r("e2").alias("oz"), F.col("a.x").alias("dx"), F.col("a.y").alias("dy"), F.col("a.z").alias("dz"), (F.floor(F.abs("e0") * 4) / F.lit(4.0)).alias("radius"), F.abs("e1").alias("area"))


AXES = """ax0 AS (SELECT vec_id // 10 AS part_id, vec_id AS id, floor(embedding[1]::DOUBLE * 2) / 2.0::DOUBLE AS ox, floor(embedding[2]::DOUBLE * 2) / 2.0::DOUBLE AS oy, floor(embedding[3]::DOUBLE * 2) / 2.0::DOUBLE AS oz,
      CASE WHEN vec_id % 3 = 0 THEN embedding[4]::DOUBLE ELSE 0 END AS x, CASE WHEN vec_id % 3 = 1 THEN embedding[5]::DOUBLE ELSE 0 END AS y, CASE WHEN vec_id % 3 = 2 THEN embedding[6]::DOUBLE ELSE 0 END AS z, floor(abs(embedding[1]::DOUBLE) * 4) / 4.0::DOUBLE AS radius, abs(embedding[2]::DOUBLE) AS area FROM embeddings),
    ax1 AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM ax0), ax2 AS (SELECT *, CASE WHEN n < 1e-9 THEN 1 WHEN abs(z / n) > 0.9 AND z < 0 THEN -1 WHEN abs(z / n) < 0.1 AND x < 0 THEN -1 ELSE 1 END AS f FROM ax1),
    axes AS (SELECT part_id, id, ox, oy, oz, CASE WHEN n < 1e-9 THEN 0 ELSE x / n * f END AS dx, CASE WHEN n < 1e-9 THEN 0 ELSE y / n * f END AS dy, CASE WHEN n < 1e-9 THEN 1 ELSE z / n * f END AS dz, radius, area FROM ax2)"""
DOT = "abs(a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) >= 0.999"
ALONG = "((b.ox - a.ox) * a.dx + (b.oy - a.oy) * a.dy + (b.oz - a.oz) * a.dz)"
APART = f"sqrt(greatest(0, (b.ox - a.ox) ** 2 + (b.oy - a.oy) ** 2 + (b.oz - a.oz) ** 2 - {ALONG} ** 2))"


@query(f"WITH {AXES} SELECT part_id, id, {Q6('dx')} AS dx, {Q6('dy')} AS dy, {Q6('dz')} AS dz FROM axes")
def c11_standard_axis(spark: SparkSession, d: str) -> DataFrame:
    return axes(spark, d).select("part_id", "id", *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "dz")])


@query(f"WITH {AXES} SELECT a.part_id, a.id AS a, b.id AS b FROM axes a JOIN axes b ON a.part_id = b.part_id AND a.id < b.id AND {DOT} AND {APART} <= 0.75")
def j02_coaxial_pairs(spark: SparkSession, d: str) -> DataFrame:
    return fe.coaxial_pairs(axes(spark, d), distance=0.75)


@query(f"WITH {AXES} SELECT a.part_id, a.id AS a, b.id AS b FROM axes a JOIN axes b ON a.part_id = b.part_id AND a.id < b.id AND {DOT} AND abs({ALONG}) <= 0.25")
def j03_coplanar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return fe.coplanar_pairs(axes(spark, d), distance=0.25)


FACES = f"ends AS (SELECT a.part_id, a.id AS axis, b.id AS plane, {ALONG} AS t FROM axes a JOIN axes b ON a.part_id = b.part_id AND {DOT} AND {APART} <= 0.75)"


@query(f"WITH {AXES}, {FACES} SELECT part_id, axis, plane, {Q6('t')} AS t FROM ends")
def j08_r06_end_faces(spark: SparkSession, d: str) -> DataFrame:
    a = axes(spark, d)
    return fe.end_faces(a, a, distance=0.75).select("part_id", "axis", "plane", r6(F.col("t")).alias("t"))


@query(f"""WITH {AXES}, {FACES}, g AS (SELECT part_id, axis AS id, count(*) AS n, min(t) AS lo, max(t) AS hi, min(plane) AS bottom FROM ends WHERE axis <> plane GROUP BY ALL)
    SELECT part_id, id, coalesce(n, 0) AS n_end_faces, {Q6('CASE WHEN n >= 2 THEN hi - lo WHEN n = 1 THEN abs(lo) ELSE -1 END')} AS depth,
      CASE WHEN bottom IS NULL THEN 'NONE' WHEN bottom % 4 = 0 THEN 'FLAT' WHEN bottom % 4 = 1 THEN 'CONICAL' WHEN bottom % 4 = 2 THEN 'SPHERICAL' ELSE 'UNKNOWN' END AS bottom_type FROM axes LEFT JOIN g USING (part_id, id)""")
def c14_hole_depth(spark: SparkSession, d: str) -> DataFrame:
    """Endless depth is given as -1 here; surfaces of the faces follow their ids."""
    a = axes(spark, d)
    k = F.col("plane") % 4
    ends = fe.end_faces(a, a, distance=0.75).where("axis <> plane").withColumn("surface", F.when(k == 0, "PLANE").when(k == 1, "CONE").when(k == 2, "SPHERE").otherwise("TORUS"))
    h = fe.hole_shape(ends, a)
    return h.withColumn("depth", r6(F.when(F.col("depth") == float("inf"), -1.0).otherwise(F.col("depth"))))


def _greedy(name: str, alike: str) -> str:
    """The fold over a part's axes as a recursion that carries the seeds found so far; `alike` is between a seed a and a row r."""
    one = ", ".join(f"'{k}': r.{k}" for k in ("ox", "oy", "oz", "dx", "dy", "dz", "radius"))
    return f"""{name}(part_id, k, id, seeds, seed) AS (SELECT part_id, 0::BIGINT, 0::BIGINT, []::STRUCT(id BIGINT, ox DOUBLE, oy DOUBLE, oz DOUBLE, dx DOUBLE, dy DOUBLE, dz DOUBLE, radius DOUBLE)[], 0::BIGINT FROM (SELECT DISTINCT part_id FROM axes)
      UNION ALL SELECT part_id, k, id, CASE WHEN seed IS NULL THEN list_append(seeds, one) ELSE seeds END, coalesce(seed, id)
      FROM (SELECT s.part_id, r.k, r.id, s.seeds, {{'id': r.id, {one}}} AS one, list_filter(s.seeds, lambda a: {alike.replace("b.", "r.")})[1].id AS seed FROM {name} s JOIN (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY id) AS k FROM axes) r ON r.part_id = s.part_id AND r.k = s.k + 1))"""


COAXIAL, COPLANAR = _greedy("ga", f"{DOT} AND {APART} <= 0.75"), f"{DOT} AND abs({ALONG}) <= "


@query(f"WITH RECURSIVE {AXES}, {COAXIAL} SELECT part_id, id, seed FROM ga WHERE k > 0")
def c01_c03_coaxial_groups(spark: SparkSession, d: str) -> DataFrame:
    return fe.greedy_groups(axes(spark, d), fe.same_axis(distance=0.75))


@query(f"WITH RECURSIVE {AXES}, {_greedy('gr', 'abs(b.radius - a.radius) <= 0.25')} SELECT part_id, id, seed FROM gr WHERE k > 0")
def c02_radius_groups(spark: SparkSession, d: str) -> DataFrame:
    return fe.greedy_groups(axes(spark, d), fe.same_radius(0.25))


@query(f"WITH RECURSIVE {AXES}, {_greedy('gp', COPLANAR + '0.25')} SELECT part_id, id, seed FROM gp WHERE k > 0")
def c04_coplanar_groups(spark: SparkSession, d: str) -> DataFrame:
    return fe.greedy_groups(axes(spark, d), fe.same_plane(distance=0.25))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Axes with what the merging of holes, cylinders and planes looks at."""
    k = F.col("id") % 4
    depth = F.when(k == 0, float("inf")).otherwise(F.col("area"))
    return axes(spark, d).select(
        "*", depth.alias("depth"), (depth * 100).alias("height"), (F.col("id") % 5).alias("n_faces"), F.when(k >= 2, F.col("id")).alias("bottom_face"), F.when(k == 2, "CONICAL").when(k == 3, "FLAT").otherwise("NONE").alias("bottom_type"),
        (k != 1).alias("is_external"), F.slice(F.array(F.col("id") * 10, F.col("id") * 10 + 1, F.col("id") * 10 + 2), F.lit(1), (F.col("id") % 3).cast("int")).alias("end_faces"),
    )


def seeded(spark: SparkSession, d: str) -> DataFrame:
    """Groups that SQL can follow: the seed is the first of the same area in twentieths."""
    a = members(spark, d).withColumn("r", F.floor(F.col("area") * 20))
    return a.join(a.groupBy("part_id", "r").agg(F.min("id").alias("seed")), ["part_id", "r"])


SEEDED = f"""{AXES}, s AS (SELECT *, min(id) OVER (PARTITION BY part_id, floor(area * 20)) AS seed, CASE WHEN id % 4 = 0 THEN NULL ELSE area END AS depth, id % 5 AS n_faces, id % 4 >= 2 AS has_bottom,
    CASE id % 4 WHEN 2 THEN 'CONICAL' WHEN 3 THEN 'FLAT' ELSE 'NONE' END AS bottom_type, id % 4 <> 1 AS is_external, id % 3 AS n_ends FROM axes)"""


@query(f"""WITH {SEEDED}, g AS (SELECT part_id, seed, avg(2 * radius) AS diameter, max(depth) AS deepest, bool_or(has_bottom) AS blind, arg_min(bottom_type, id) FILTER (has_bottom) AS bottom, string_agg(id::VARCHAR, ',' ORDER BY id) AS sources,
      sum(n_faces) AS n_faces, count(*) AS n, 2 * (max(radius) - min(radius)) AS spread FROM s GROUP BY part_id, seed)
    SELECT part_id, seed, 'normalized_hole_' || (row_number() OVER (PARTITION BY part_id ORDER BY seed) - 1) AS normal_id, {Q6('diameter')} AS diameter, {Q6('CASE WHEN blind THEN coalesce(deepest, -1) ELSE -1 END')} AS depth,
      CASE WHEN blind THEN 'BLIND' ELSE 'THROUGH' END AS hole_type, CASE WHEN blind THEN bottom ELSE 'NONE' END AS bottom_type, sources, CASE WHEN n_faces > 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS completeness,
      CASE WHEN n = 1 AND (blind OR deepest IS NULL) OR n > 1 AND spread < 1e-6 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM g""")
def c06_c09_merged_holes(spark: SparkSession, d: str) -> DataFrame:
    """Endless depth is given as -1 here."""
    m = fe.numbered(fe.merge_holes(seeded(spark, d)), "hole")
    return m.withColumn("diameter", r6(F.col("diameter"))).withColumn("depth", r6(F.when(F.col("depth") == float("inf"), -1.0).otherwise(F.col("depth"))))


@query(f"""WITH {SEEDED}, e AS (SELECT part_id, seed, string_agg(face::VARCHAR, ',' ORDER BY face) AS end_faces FROM (SELECT part_id, seed, face, row_number() OVER (PARTITION BY part_id, seed ORDER BY face) AS k
        FROM (SELECT part_id, seed, unnest(range(id * 10, id * 10 + n_ends)) AS face FROM s)) WHERE k <= 2 GROUP BY part_id, seed),
    g AS (SELECT part_id, seed, avg(radius) AS radius, max(depth) * 100 AS h, arg_min(dz, id) AS dz, arg_min(is_external, id) AS is_external, arg_min(n_ends, id) AS n_ends, count(*) AS n, max(radius) - min(radius) AS spread,
      string_agg(id::VARCHAR, ',' ORDER BY id) AS sources FROM s GROUP BY part_id, seed)
    SELECT part_id, seed, 'normalized_cylinder_' || (row_number() OVER (PARTITION BY part_id ORDER BY seed) - 1) AS normal_id, {Q6('radius')} AS radius, {Q6('coalesce(h, -1)')} AS height,
      CASE WHEN h IS NULL OR h > 50 THEN 'SHAFT' WHEN abs(dz) > 0.9 THEN 'PILLAR' ELSE 'BOSS' END AS cylinder_type, sources, is_external, CASE WHEN abs(dz) > 0.9 THEN 'VERTICAL' ELSE 'HORIZONTAL' END AS orientation,
      coalesce(end_faces, '') AS end_faces, CASE WHEN n_ends >= 2 OR n_ends = 0 AND h IS NULL THEN 'COMPLETE' WHEN n_ends = 1 THEN 'PARTIAL' ELSE 'INCOMPLETE' END AS completeness,
      CASE WHEN n = 1 OR spread < 1e-6 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM g LEFT JOIN e USING (part_id, seed)""")
def c07_c10_merged_cylinders(spark: SparkSession, d: str) -> DataFrame:
    """Endless height is given as -1 here."""
    m = fe.numbered(fe.merge_cylinders(seeded(spark, d)), "cylinder")
    return m.withColumn("radius", r6(F.col("radius"))).withColumn("height", r6(F.when(F.col("height") == float("inf"), -1.0).otherwise(F.col("height"))))


@query(f"""WITH {SEEDED}, g AS (SELECT part_id, seed, sum(area) AS area, arg_min(dz, id) AS dz, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS sources FROM s GROUP BY part_id, seed)
    SELECT part_id, seed, 'normalized_planar_' || (row_number() OVER (PARTITION BY part_id ORDER BY seed) - 1) AS normal_id, {Q6('area')} AS area, CASE WHEN dz > 0.9 THEN 'TOP' WHEN dz < -0.9 THEN 'BOTTOM' ELSE 'SIDE' END AS orientation,
      n, sources, 'COMPLETE' AS completeness, CASE WHEN n = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM g""")
def c08_c13_merged_planes(spark: SparkSession, d: str) -> DataFrame:
    return fe.numbered(fe.merge_planes(seeded(spark, d)), "planar").withColumn("area", r6(F.col("area")))


def _normal(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d)
    return fe.normalise(m, m, m, distance=0.75)


#: Merged groups of all three kinds; the limit on angles doesn't tell these axes apart, which are parallel or far from it.
NORMAL = f"""WITH RECURSIVE {AXES}, {COAXIAL}, {_greedy('gp', COPLANAR + '0.75')},
    mb AS (SELECT a.*, ga.seed AS axis_seed, gp.seed AS plane_seed, CASE WHEN a.id % 4 = 0 THEN NULL ELSE area END AS depth, a.id % 4 >= 2 AS has_bottom FROM axes a JOIN ga USING (part_id, id) JOIN gp USING (part_id, id) WHERE ga.k > 0 AND gp.k > 0),
    mg AS (SELECT part_id, axis_seed AS seed, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS sources, max(radius) - min(radius) AS spread, max(depth) AS deepest, bool_or(has_bottom) AS blind, sum(id % 5) AS n_faces, arg_min(id % 3, id) AS n_ends FROM mb GROUP BY ALL),
    nm AS (SELECT part_id, seed, n, 'hole' AS kind, sources, CASE WHEN n_faces > 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS completeness, CASE WHEN n = 1 AND (blind OR deepest IS NULL) OR n > 1 AND 2 * spread < 1e-6 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM mg
      UNION ALL SELECT part_id, seed, n, 'cylinder', sources, CASE WHEN n_ends >= 2 OR n_ends = 0 AND deepest IS NULL THEN 'COMPLETE' WHEN n_ends = 1 THEN 'PARTIAL' ELSE 'INCOMPLETE' END, CASE WHEN n = 1 OR spread < 1e-6 THEN 'HIGH' ELSE 'MEDIUM' END FROM mg
      UNION ALL SELECT part_id, plane_seed, count(*), 'planar', string_agg(id::VARCHAR, ',' ORDER BY id), 'COMPLETE', CASE WHEN count(*) = 1 THEN 'HIGH' ELSE 'MEDIUM' END FROM mb GROUP BY part_id, plane_seed)"""


@query(f"{NORMAL} SELECT part_id, 'normalized_' || kind || '_' || (row_number() OVER (PARTITION BY part_id, kind ORDER BY seed) - 1) AS normal_id, kind, sources, completeness, confidence FROM nm")
def r10_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d)


@query(f"{NORMAL} SELECT part_id, count(*) AS total_features, (sum(n) - count(*))::BIGINT AS merged_count FROM nm GROUP BY part_id")
def r10_normalised_counts(spark: SparkSession, d: str) -> DataFrame:
    return fe.normaliser_counts(_normal(spark, d))


@query(f"WITH {SEEDED} SELECT part_id, count(DISTINCT seed) AS total_features, count(*) - count(DISTINCT seed) AS merged_count FROM s GROUP BY part_id")
def c12_r10_normaliser_counts(spark: SparkSession, d: str) -> DataFrame:
    return fe.normaliser_counts(fe.merge_planes(seeded(spark, d)))


@query(f"""WITH {FEAT}, m AS (SELECT *, max(radius) OVER (PARTITION BY part_id) AS top FROM feat)
    SELECT part_id, id, CASE WHEN radius >= top - 1e-4 THEN 'OD' ELSE 'ID' END AS kind, row_number() OVER (PARTITION BY part_id ORDER BY radius DESC, t_min, id) AS place FROM m""")
def c05_r03_unified_order(spark: SparkSession, d: str) -> DataFrame:
    part = Window.partitionBy("part_id")
    f = features(spark, d).withColumn("top", F.max("radius").over(part))
    return f.select("part_id", "id", F.when(F.col("radius") >= F.col("top") - 1e-4, "OD").otherwise("ID").alias("kind"), F.row_number().over(part.orderBy(F.col("radius").desc(), "t_min", "id")).cast("long").alias("place"))


@query(f"""WITH {FEAT}, r AS (SELECT DISTINCT part_id, radius FROM feat), t AS (SELECT *, max(radius) OVER (PARTITION BY part_id) AS top FROM r),
    n AS (SELECT a.*, (SELECT min(b.radius) FROM t b WHERE b.part_id = a.part_id AND b.radius > a.radius AND b.radius < a.top - 1e-6) AS m FROM t a)
    SELECT part_id, radius, CASE WHEN abs(radius - top) < 1e-6 THEN 'EXTERNAL' WHEN radius / top >= 0.85 THEN 'EXTERNAL' WHEN radius / top >= 0.65 THEN 'INTERNAL' WHEN m IS NULL THEN 'EXTERNAL'
      WHEN radius / m > 0.85 THEN CASE WHEN m / top > 0.85 THEN 'EXTERNAL' ELSE 'INTERNAL' END WHEN radius / m < 0.7 THEN 'INTERNAL' WHEN radius / top > 0.45 AND m / top < 0.75 THEN 'EXTERNAL' WHEN m / top > 0.85 THEN 'EXTERNAL' ELSE 'INTERNAL' END AS kind FROM n""")
def c15_classified_radii(spark: SparkSession, d: str) -> DataFrame:
    return fe.classify_radii(features(spark, d).select("part_id", "radius").distinct())


@query(f"""WITH {FEAT}, e AS (SELECT part_id, unnest([t_min, t_max]) AS z, is_external, radius FROM feat), g AS (SELECT *, CASE WHEN z - lag(z) OVER w > 1e-5 THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY part_id ORDER BY z, is_external, radius)),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY part_id ORDER BY z, is_external, radius ROWS UNBOUNDED PRECEDING) AS island FROM g), s AS (SELECT part_id, avg(z) AS z, count(DISTINCT (is_external, radius)) AS n FROM i GROUP BY part_id, island)
    SELECT part_id, row_number() OVER (PARTITION BY part_id ORDER BY z) AS station, {Q6('z')} AS z, n FROM s WHERE n >= 2""")
def r01_step_stations(spark: SparkSession, d: str) -> DataFrame:
    return fe.step_stations(features(spark, d)).withColumn("z", r6(F.col("z")))


@query(f"""WITH {FEAT}, c AS (SELECT part_id, count(*) AS n, count(*) FILTER (is_external) AS ext, count(*) FILTER (NOT is_external) AS bores, count(DISTINCT t_min) + 1 AS planar FROM feat GROUP BY part_id)
    SELECT part_id, ext AS external_cylinders, bores AS internal_bores, planar AS planar_faces, ext + bores + planar AS total_faces, CASE WHEN n = 4 AND ext = 2 AND bores = 2 THEN 'OK' ELSE 'WARNING' END AS expected FROM c""")
def a07_a17_r02_feature_counts(spark: SparkSession, d: str) -> DataFrame:
    c = features(spark, d).groupBy("part_id").agg(F.count("*").alias("n"), F.count_if("is_external").alias("external_cylinders"), F.count_if(~F.col("is_external")).alias("internal_bores"), (F.count_distinct("t_min") + 1).alias("planar_faces"))
    ok = (F.col("n") == 4) & (F.col("external_cylinders") == 2) & (F.col("internal_bores") == 2)
    return c.select("part_id", "external_cylinders", "internal_bores", "planar_faces", (F.col("external_cylinders") + F.col("internal_bores") + F.col("planar_faces")).alias("total_faces"), F.when(ok, "OK").otherwise("WARNING").alias("expected"))


@query(f"WITH {AXES}, p AS (SELECT a.part_id, a.id, {ALONG} AS t FROM axes a JOIN axes b USING (part_id)) SELECT part_id, id, {Q6('min(t)')} AS t_min, {Q6('max(t)')} AS t_max FROM p GROUP BY ALL")
def a21_r04_axial_extent(spark: SparkSession, d: str) -> DataFrame:
    """The extent of a part's points along each of its axes."""
    a, b = axes(spark, d).alias("a"), axes(spark, d).alias("b")
    t = sum(((F.col(f"b.o{k}") - F.col(f"a.o{k}")) * F.col(f"a.d{k}") for k in "xyz"), F.lit(0.0))
    return a.join(b, F.col("a.part_id") == F.col("b.part_id")).groupBy("a.part_id", "a.id").agg(r6(F.min(t)).alias("t_min"), r6(F.max(t)).alias("t_max"))


@query(f"""WITH {AXES}, {FACES}, bx AS (SELECT part_id, id, ox + 0.5::DOUBLE * k - radius AS x0, ox + 0.5::DOUBLE * k + radius AS x1, oy - radius AS y0, oy + radius + k AS y1, oz - area AS z0, oz + 2 * area AS z1 FROM axes, (SELECT unnest([0, 1]) AS k) WHERE id % 5 <> 1 AND (k = 0 OR id % 3 = 0)),
    bt AS (SELECT part_id, id, min(t) AS lo, max(t) AS hi FROM (SELECT part_id, id, (CASE WHEN m % 2 = 0 THEN x0 ELSE x1 END - ox) * dx + (CASE WHEN m // 2 % 2 = 0 THEN y0 ELSE y1 END - oy) * dy + (CASE WHEN m // 4 = 0 THEN z0 ELSE z1 END - oz) * dz AS t FROM axes JOIN bx USING (part_id, id), (SELECT unnest(range(8)) AS m)) GROUP BY part_id, id),
    et AS (SELECT part_id, axis AS id, min(t) AS lo, max(t) AS hi FROM ends WHERE axis <> plane GROUP BY ALL)
    SELECT part_id, id, {Q6('coalesce(CASE WHEN id % 2 = 1 THEN et.lo END, bt.lo, 0)')} AS t_min, {Q6('coalesce(CASE WHEN id % 2 = 1 THEN et.hi END, bt.hi, 0)')} AS t_max FROM axes LEFT JOIN bt USING (part_id, id) LEFT JOIN et USING (part_id, id)""")
def r04_axial_extents(spark: SparkSession, d: str) -> DataFrame:
    """Even ids are holes; some have no box, some two."""
    a, c = axes(spark, d), F.col
    two = a.withColumn("k", F.explode(F.filter(F.array(F.lit(0), F.lit(1)), lambda k: (c("id") % 5 != 1) & ((k == 0) | (c("id") % 3 == 0)))))
    boxes = two.select("part_id", "id", (c("ox") + 0.5 * c("k") - c("radius")).alias("x0"), (c("ox") + 0.5 * c("k") + c("radius")).alias("x1"), (c("oy") - c("radius")).alias("y0"), (c("oy") + c("radius") + c("k")).alias("y1"), (c("oz") - c("area")).alias("z0"), (c("oz") + 2 * c("area")).alias("z1"))
    t = fe.axial_extent(a.withColumn("from_hole", c("id") % 2 == 0), boxes, fe.end_faces(a, a, distance=0.75).where("axis <> plane"))
    return t.select("part_id", "id", r6(c("t_min")).alias("t_min"), r6(c("t_max")).alias("t_max"))


LOOP = """l0 AS (SELECT part_id, row_number() OVER w AS k, z_start AS a, z_end AS b, od_diameter / 2 AS ro, id_diameter / 2 AS ri, lag(z_end) OVER w AS pz, lead(z_start) OVER w AS nz, lag(od_diameter) OVER w / 2 AS po, lead(id_diameter) OVER w / 2 AS ni FROM segments WINDOW w AS (PARTITION BY part_id ORDER BY z_start, seq)),
    l1 AS (SELECT part_id, 0 AS leg, k AS key, 0 AS sub, greatest(ri, 0) AS sx, a AS sy, ro AS ex, a AS ey FROM l0 WHERE pz IS NULL
      UNION ALL SELECT part_id, 1, k, 0, po, pz, ro, a FROM l0 WHERE abs(ro - po) > 1e-6 UNION ALL SELECT part_id, 1, k, 1, ro, a, ro, b FROM l0
      UNION ALL SELECT part_id, 2, k, 0, ro, b, greatest(ri, 0), b FROM l0 WHERE nz IS NULL
      UNION ALL SELECT part_id, 3, -k, 0, ni, nz, ri, b FROM l0 WHERE abs(ri - ni) > 1e-6 UNION ALL SELECT part_id, 3, -k, 1, greatest(ri, 0), b, greatest(ri, 0), a FROM l0),
    lp AS (SELECT part_id, row_number() OVER (PARTITION BY part_id ORDER BY leg, key, sub) AS i, sx, sy, ex, ey FROM l1)"""
GAPS = segments_sql(gaps=True)


@query(f"WITH {GAPS}, {LOOP} SELECT part_id, i, {Q6('sx')} AS sx, {Q6('sy')} AS sy, {Q6('ex')} AS ex, {Q6('ey')} AS ey FROM lp")
def w14_profile_loop(spark: SparkSession, d: str) -> DataFrame:
    return pr.from_segments(segments(spark, d, gaps=True)).select("part_id", "i", *[r6(F.col(c)).alias(c) for c in ("sx", "sy", "ex", "ey")])


#: From a loop `lp` of lines: the primitives `pm`, without arcs.
LINES = "pm AS (SELECT part_id, i, sx, sy, ex, ey, NULL::DOUBLE AS cx, NULL::DOUBLE AS cy, NULL::DOUBLE AS r, NULL::DOUBLE AS a0, NULL::DOUBLE AS a1, NULL::BOOLEAN AS cw FROM lp)"
TURN = lambda x: f"({x} - 2 * pi() * floor({x} / (2 * pi())))"
SWEPT = lambda a, b, cw: f"CASE WHEN {cw} THEN {TURN(f'({a} - {b})')} ELSE {TURN(f'({b} - {a})')} END"
CHECKS = f"""ck0 AS (SELECT *, r IS NULL AS line, {SWEPT("a0", "a1", "cw")} AS swept, i = max(i) OVER w2 AS last, coalesce(lead(sx) OVER w, first_value(sx) OVER w) AS nx, coalesce(lead(sy) OVER w, first_value(sy) OVER w) AS ny FROM pm WINDOW w AS (PARTITION BY part_id ORDER BY i), w2 AS (PARTITION BY part_id)),
    ck AS (SELECT part_id, count(*) AS n, count(*) FILTER (CASE WHEN line THEN sqrt((sx - ex) ** 2 + (sy - ey) ** 2) <= 1e-6 ELSE r <= 0 OR swept < 1e-9 END) AS n_degenerate, count(*) FILTER (NOT sqrt((ex - nx) ** 2 + (ey - ny) ** 2) <= 1e-6) AS n_open,
      CASE WHEN count(*) < 3 THEN 0 ELSE sum(CASE WHEN last THEN sx * ey - ex * sy + ex * ny - nx * ey ELSE sx * ny - nx * sy END) / 2 END AS area, sum(CASE WHEN line THEN sx * ey - ex * sy ELSE 0 END) / 2 AS line_area,
      sum(CASE WHEN line THEN sqrt((ex - sx) ** 2 + (ey - sy) ** 2) ELSE r * swept END) AS perimeter, min(least(sx, ex)) AS least_radius,
      count(*) FILTER (line AND sx * ex < -1e-6 AND NOT (abs(sx) < 1e-6 OR abs(ex) < 1e-6)) AS n_across FROM ck0 GROUP BY part_id)"""
CHECKED = f"SELECT part_id, n, n_degenerate, n_open, {Q6('area + 1e-10')} AS area, {Q6('perimeter')} AS perimeter, {Q6('least_radius')} AS least_radius, n >= 2 AND n_open = 0 AS closed, n >= 3 AND area > 0 AS counterclockwise FROM ck"


def checked(loop: DataFrame) -> DataFrame:
    t = pr.loop_checks(loop)
    return t.select("part_id", "n", "n_degenerate", "n_open", r6(F.col("area") + 1e-10).alias("area"), *[r6(F.col(c)).alias(c) for c in ("perimeter", "least_radius")], "closed", "counterclockwise")


@query(f"WITH {GAPS}, {LOOP}, {LINES}, {CHECKS} {CHECKED}")
def v05_v07_a22_loop_checks(spark: SparkSession, d: str) -> DataFrame:
    return checked(pr.from_segments(segments(spark, d, gaps=True)))


def _crossing_sql(tolerance: str, touches: bool = False, arcs: bool = True) -> str:
    """cr (part_id, i, j) from pm: pairs that aren't neighbours, by the kinds of both."""
    close = lambda ax, ay, bx, by: f"sqrt(({ax} - {bx}) ** 2 + ({ay} - {by}) ** 2) <= {tolerance}"
    shared = " OR ".join(close(f"a.{p}x", f"a.{p}y", f"b.{q}x", f"b.{q}y") for p in "se" for q in "se")
    of = lambda c, kind: f"CASE WHEN a.r IS NULL THEN {'a' if kind == 'l' else 'b'}.{c} ELSE {'b' if kind == 'l' else 'a'}.{c} END AS {kind}{c}"
    end = " OR ".join(close("px", "py", f"{p}{q}x", f"{p}{q}y") for p in ("a_", "b_") for q in "se")
    on = lambda t: f"CASE WHEN {t} BETWEEN 0 AND 1 AND {SWEPT('aa0', f'atan2(lsy - acy + {t} * ldy, lsx - acx + {t} * ldx)', 'acw')} <= {SWEPT('aa0', 'aa1', 'acw')} THEN {t} END"
    return f"""x0 AS (SELECT a.part_id, a.i, b.i AS j, a.r IS NULL AS a_line, b.r IS NULL AS b_line, {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in ("sx", "sy", "ex", "ey", "cx", "cy", "r"))}, {", ".join(of(c, "l") for c in ("sx", "sy", "ex", "ey"))}, {", ".join(of(c, "a") for c in ("cx", "cy", "r", "a0", "a1", "cw"))}, {shared} AS shared
        FROM pm a JOIN (SELECT *, count(*) OVER (PARTITION BY part_id) AS n FROM pm) b ON a.part_id = b.part_id AND a.i < b.i - 1 AND NOT (a.i = 1 AND b.i = b.n) AND b.n >= 3),
    x1 AS (SELECT *, lex - lsx AS ldx, ley - lsy AS ldy, (a_ex - a_sx) * (b_ey - b_sy) - (a_ey - a_sy) * (b_ex - b_sx) AS det, b_sx - a_sx AS dx3, b_sy - a_sy AS dy3, sqrt((a_cx - b_cx) ** 2 + (a_cy - b_cy) ** 2) AS apart FROM x0),
    x2 AS (SELECT *, ldx * ldx + ldy * ldy AS qa, 2 * (ldx * (lsx - acx) + ldy * (lsy - acy)) AS qb, (lsx - acx) * (lsx - acx) + (lsy - acy) * (lsy - acy) - ar * ar AS qc,
      CASE WHEN abs(det) >= {tolerance} THEN (dx3 * (b_ey - b_sy) - dy3 * (b_ex - b_sx)) / det END AS t, CASE WHEN abs(det) >= {tolerance} THEN (dx3 * (a_ey - a_sy) - dy3 * (a_ex - a_sx)) / det END AS u FROM x1),
    x3 AS (SELECT *, CASE WHEN a_line <> b_line AND qb * qb - 4 * qa * qc >= 0 AND abs(qa) >= {tolerance} THEN sqrt(qb * qb - 4 * qa * qc) END AS root FROM x2),
    x4 AS (SELECT *, (-qb - root) / (2 * qa) AS t1, (-qb + root) / (2 * qa) AS t2 FROM x3),
    x5 AS (SELECT *, CASE WHEN a_line AND b_line THEN CASE WHEN NOT shared AND t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN t END {f"WHEN a_line <> b_line THEN coalesce({on('t1')}, {on('t2')})" if arcs else ""} END AS hit FROM x4),
    x6 AS (SELECT *, lsx + hit * ldx AS px, lsy + hit * ldy AS py FROM x5),
    cr AS (SELECT part_id, i, j FROM x6 WHERE (hit IS NOT NULL{"" if touches else f" AND NOT ({end})"}){" OR (NOT a_line AND NOT b_line AND apart > abs(a_r - b_r) AND apart < (a_r + b_r) * 0.9)" if arcs else ""})"""


@query(f"WITH {GAPS}, {LOOP}, {LINES}, {_crossing_sql('1e-9')} SELECT * FROM cr")
def v08_j04_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Bores over the outside make the loops of some parts cross themselves."""
    return pr.crossings(pr.from_segments(segments(spark, d, gaps=True))).select("part_id", "i", "j")


STAGE = "SELECT ck.part_id, n, coalesce(c, 0) AS n_crossings, {case} AS stage FROM ck LEFT JOIN (SELECT part_id, count(*) AS c FROM cr GROUP BY part_id) USING (part_id)"
LOOSE = STAGE.format(case="CASE WHEN n_degenerate > 0 THEN 'DEGENERATE' WHEN n < 2 OR n_open > 0 THEN 'OPEN' WHEN n < 3 OR abs(area) < 1e-6 THEN 'NO_AREA' WHEN c > 0 THEN 'CROSSING' ELSE 'OK' END")
STRICT = STAGE.format(case="CASE WHEN least_radius < -1e-6 THEN 'NEGATIVE_RADIUS' WHEN n_across > 0 THEN 'AXIS' WHEN n_open > 0 THEN 'OPEN' WHEN c > 0 THEN 'CROSSING' WHEN abs(line_area) < 1e-6 THEN 'NO_AREA' ELSE 'OK' END")


@query(f"WITH {GAPS}, {LOOP}, {LINES}, {CHECKS}, {_crossing_sql('1e-6')} {LOOSE}")
def v09_topology(spark: SparkSession, d: str) -> DataFrame:
    return pr.topology(pr.from_segments(segments(spark, d, gaps=True)))


@query(f"WITH {GAPS}, {LOOP}, {LINES}, {CHECKS}, {_crossing_sql('1e-6', touches=True, arcs=False)} {STRICT}")
def v10_strict_profile(spark: SparkSession, d: str) -> DataFrame:
    return pr.topology(pr.from_segments(segments(spark, d, gaps=True)), strict=True)


#: Half the angle of the arcs below: their cosine is 0.6.
WIDE = "0.9272952180016122"


def mixed_loops(spark: SparkSession, d: str) -> DataFrame:
    """Every third line of the profiles, if it runs up the outside, as an arc: bulging outward, or with the clock inward; some without radius."""
    lines, c = pr.from_segments(segments(spark, d, gaps=True)), F.col
    arc, inward, n = (c("sx") == c("ex")) & (c("ey") > c("sy")) & (c("i") % 3 == 0), c("i") % 6 == 0, c("ey") - c("sy")
    theta, only = F.lit(float(WIDE)), lambda x: F.when(arc, x)
    return lines.select(
        "part_id", "i", *[F.when(~arc, c(x)).alias(x) for x in pr.ENDS], only(c("sx") + F.when(inward, 0.375).otherwise(-0.375) * n).alias("cx"), only((c("sy") + c("ey")) / 2).alias("cy"),
        only(F.when(F.round(n * 1000) % 700 == 0, 0.0).otherwise(0.625 * n)).alias("radius"), only(F.when(inward, F.pi() + theta).otherwise(-theta)).alias("a0"), only(F.when(inward, F.pi() - theta).otherwise(theta)).alias("a1"), only(inward).alias("clockwise"),
    )


MIXED = f"""mx AS (SELECT *, sx = ex AND ey > sy AND i % 3 = 0 AS arc, i % 6 = 0 AS inward, ey - sy AS n FROM lp),
    my AS (SELECT part_id, i, sx, sy, ex, ey, arc, CASE WHEN arc THEN sx + CASE WHEN inward THEN 0.375::DOUBLE ELSE -0.375::DOUBLE END * n END AS cx, CASE WHEN arc THEN (sy + ey) / 2 END AS cy, CASE WHEN arc THEN CASE WHEN round(n * 1000) % 700 = 0 THEN 0 ELSE 0.625::DOUBLE * n END END AS r,
      CASE WHEN arc THEN CASE WHEN inward THEN pi() + {WIDE}::DOUBLE ELSE -{WIDE}::DOUBLE END END AS a0, CASE WHEN arc THEN CASE WHEN inward THEN pi() - {WIDE}::DOUBLE ELSE {WIDE}::DOUBLE END END AS a1, CASE WHEN arc THEN inward END AS cw FROM mx),
    pm AS (SELECT part_id, i, CASE WHEN arc THEN cx + r * cos(a0) ELSE sx END AS sx, CASE WHEN arc THEN cy + r * sin(a0) ELSE sy END AS sy, CASE WHEN arc THEN cx + r * cos(a1) ELSE ex END AS ex, CASE WHEN arc THEN cy + r * sin(a1) ELSE ey END AS ey, cx, cy, r, a0, a1, cw FROM my)"""


@query(f"WITH {GAPS}, {LOOP}, {MIXED}, {CHECKS} {CHECKED}")
def v05_v06_a22_mixed_checks(spark: SparkSession, d: str) -> DataFrame:
    return checked(mixed_loops(spark, d))


@query(f"WITH {GAPS}, {LOOP}, {MIXED}, {_crossing_sql('1e-9')} SELECT * FROM cr")
def v08_j04_mixed_crossings(spark: SparkSession, d: str) -> DataFrame:
    return pr.crossings(mixed_loops(spark, d)).select("part_id", "i", "j")


@query(f"WITH {GAPS}, {LOOP}, {MIXED}, {CHECKS}, {_crossing_sql('1e-6')} {LOOSE}")
def v09_mixed_topology(spark: SparkSession, d: str) -> DataFrame:
    return pr.topology(mixed_loops(spark, d))


@query(f"WITH {GAPS}, {LOOP}, {MIXED}, {CHECKS}, {_crossing_sql('1e-6', touches=True, arcs=False)} {STRICT}")
def v10_mixed_strict_profile(spark: SparkSession, d: str) -> DataFrame:
    return pr.topology(mixed_loops(spark, d), strict=True)


def arcs(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    a0, a1 = (F.col("seq") % 5) * (math.pi / 4), (F.col("part_id") % 7) * (math.pi / 3)
    return s.select("part_id", F.col("seq").alias("i"), (F.col("od_diameter") / 2).alias("cx"), F.col("z_start").alias("cy"), (F.col("od_diameter") / 4).alias("radius"), a0.alias("a0"), a1.alias("a1"), (F.col("seq") % 2 == 0).alias("clockwise"))


@query(f"""WITH {SEG}, a AS (SELECT part_id, seq, od_diameter / 4 AS r, (seq % 5) * (pi() / 4) AS a0, fmod((part_id % 7) * (pi() / 3), 2 * pi()) AS a1, seq % 2 = 0 AS cw FROM segments),
    t AS (SELECT *, CASE WHEN cw THEN a0 - a1 ELSE a1 - a0 END AS w FROM a) SELECT part_id, seq, {Q6('r * CASE WHEN w < 0 THEN w + 2 * pi() ELSE w END')} AS length FROM t""")
def a22_arc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return arcs(spark, d).select("part_id", F.col("i").alias("seq"), r6(F.col("radius") * pr.sweep_angle(F.col("a0"), F.col("a1"), F.col("clockwise"))).alias("length"))


ARC_LINE = lambda t: f"CASE WHEN {t} BETWEEN 0 AND 1 AND {SWEPT('a0', f'atan2(fy + {t} * dy, fx + {t} * dx)', 'cw')} <= {SWEPT('a0', 'a1', 'cw')} THEN 1 ELSE 0 END"


@query(f"""WITH {SEG}, {LOOP}, a AS (SELECT part_id, seq AS i, od_diameter / 2 + 0.0137::DOUBLE AS cx, z_start + 0.0071::DOUBLE AS cy, od_diameter / 4 AS r, (seq % 5) * (pi() / 4) AS a0, (part_id % 7) * (pi() / 3) AS a1, seq % 2 = 0 AS cw FROM segments),
    p AS (SELECT a.*, l.i AS line, ex - sx AS dx, ey - sy AS dy, sx - cx AS fx, sy - cy AS fy FROM a JOIN lp l USING (part_id)), q AS (SELECT *, dx * dx + dy * dy AS qa, 2 * (dx * fx + dy * fy) AS qb, fx * fx + fy * fy - r * r AS qc FROM p),
    s AS (SELECT *, (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS t1, (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS t2 FROM q WHERE qb * qb - 4 * qa * qc >= 0 AND abs(qa) >= 1e-9)
    SELECT * FROM (SELECT part_id, i AS arc, line, {ARC_LINE("t1")} + {ARC_LINE("t2")} AS n FROM s) WHERE n > 0""")
def j04_arc_line_hits(spark: SparkSession, d: str) -> DataFrame:
    """Arcs against the lines of the part's profile; moved off the lattice, where a hit would hang on the last bit."""
    return pr.arc_line_hits(arcs(spark, d).withColumn("cx", F.col("cx") + 0.0137).withColumn("cy", F.col("cy") + 0.0071), pr.from_segments(segments(spark, d)))


@query(f"""WITH {SEG}, a AS (SELECT part_id, seq AS i, od_diameter / 2 AS cx, z_start AS cy, od_diameter / 4 AS r FROM segments), p AS (SELECT a.part_id, a.i, b.i AS j, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS q, a.r AS r, b.r AS s FROM a JOIN a b ON a.part_id = b.part_id AND a.i < b.i - 1)
    SELECT part_id, i, j FROM p WHERE q > abs(r - s) AND q < (r + s) * 0.9""")
def j04_arc_arc_hits(spark: SparkSession, d: str) -> DataFrame:
    return pr.arc_arc_hits(arcs(spark, d))


@query(f"WITH {SEG} SELECT part_id, seq, greatest(od_diameter, lead(od_diameter) OVER w) AS disc_od, greatest(id_diameter, lead(id_diameter) OVER w) AS disc_id FROM segments WINDOW w AS (PARTITION BY part_id ORDER BY z_start, seq)")
def w17_boundary_discs(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("part_id").orderBy("z_start", "seq")
    return segments(spark, d).select("part_id", "seq", F.greatest("od_diameter", F.lead("od_diameter").over(by)).alias("disc_od"), F.greatest("id_diameter", F.lead("id_diameter").over(by)).alias("disc_id"))
