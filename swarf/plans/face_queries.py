"""Registered queries of profiles with overlaps, and of features found from faces, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarf.operators import features as fe
from swarf.operators import profile as pr
from swarf.plans.geometry_queries import GAPS, LOOP
from swarf.plans.part_queries import Q6
from swarf.plans.registry import query
from swarf.sources.tables import r6, segments


def overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Segments of which some begin late, and every third reaches an inch into what follows."""
    return segments(spark, d, gaps=True).withColumn("z_end", F.col("z_end") + F.when(F.col("seq") % 3 == 0, 1.0).otherwise(0.0))


def _profile_sql(by_ends: bool) -> str:
    """rk (part_id, k, z, ro, ri), from 0: of each place the radii that the interval up to it and the one down to it have; then the points."""
    weight = "CASE WHEN abs(z - a) < 1e-9 OR abs(z - b) < 1e-9 THEN 1000 + b ELSE b END" if by_ends else "b"
    places = "SELECT part_id, k, z FROM zk" if by_ends else "SELECT part_id, k, (z + lead(z) OVER (PARTITION BY part_id ORDER BY k)) / 2 AS z FROM zk"
    carry = "last_value({c} IGNORE NULLS) OVER (PARTITION BY part_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ends = "CASE WHEN k = 0 THEN {c}_first WHEN k = m THEN {c}_last ELSE {c}0 END AS {c}" if by_ends else "{c}0 AS {c}"
    return f"""ov AS (SELECT part_id, seq, z_start AS a, z_end + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS b, od_diameter / 2 AS ro, id_diameter / 2 AS ri FROM segments), os AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY a, b, seq) AS o FROM ov),
    zk AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY z) - 1 AS k FROM (SELECT DISTINCT part_id, unnest([a, b]) AS z FROM ov)),
    pl AS ({places}), bs AS (SELECT pl.part_id, k, ro, ri FROM pl JOIN os ON os.part_id = pl.part_id AND a <= z AND b >= z QUALIFY row_number() OVER (PARTITION BY pl.part_id, k ORDER BY {weight} DESC, o) = 1),
    cr AS (SELECT zk.part_id, k, z, max(k) OVER (PARTITION BY part_id) AS m, {carry.format(c="ro")} AS ro0, {carry.format(c="ri")} AS ri0 FROM zk LEFT JOIN bs USING (part_id, k)),
    fl AS (SELECT part_id, arg_min(ro, o) AS ro_first, arg_min(ri, o) AS ri_first, arg_max(ro, o) AS ro_last, arg_max(ri, o) AS ri_last FROM os GROUP BY part_id),
    rk AS (SELECT part_id, k, z, m, {ends.format(c="ro")}, {ends.format(c="ri")} FROM cr JOIN fl USING (part_id)),
    up AS (SELECT part_id, k, m, z, lag(z) OVER w AS z0, {"ro" if by_ends else "lag(ro) OVER w"} AS ro, {"lag(ro) OVER w" if by_ends else "coalesce(lag(ro, 2) OVER w, lag(ro) OVER w)"} AS po FROM rk WINDOW w AS (PARTITION BY part_id ORDER BY k)),
    dn AS (SELECT part_id, k, m, z, lead(z) OVER w AS z1, ri, {"CASE WHEN k = m - 1 THEN CASE WHEN lead(ri) OVER w > 1e-6 THEN lead(ri) OVER w ELSE 0 END ELSE lead(ri) OVER w END" if by_ends else "CASE WHEN k = m - 1 THEN CASE WHEN ri > 1e-6 THEN ri ELSE 0 END ELSE lead(ri) OVER w END"} AS ni FROM rk WINDOW w AS (PARTITION BY part_id ORDER BY k)),
    pt AS (SELECT part_id, 0 AS leg, 0 AS key, 0 AS sub, CASE WHEN ri > 1e-6 THEN ri ELSE 0 END AS x, z AS y FROM rk WHERE k = 0 UNION ALL SELECT part_id, 0, 0, 1, ro, z FROM rk WHERE k = 0
      UNION ALL SELECT part_id, 1, k, 0, ro, z0 FROM up WHERE k > 0 AND abs(ro - po) > 1e-6 UNION ALL SELECT part_id, 1, k, 1, ro, z FROM up WHERE k > 0
      UNION ALL SELECT part_id, 2, 0, 0, CASE WHEN ri > 1e-6 THEN ri ELSE 0 END, max_z FROM (SELECT part_id, ri, k, m, max(z) OVER (PARTITION BY part_id) AS max_z FROM rk) WHERE k = m{"" if by_ends else " - 1"}
      UNION ALL SELECT part_id, 3, -k, 0, CASE WHEN ri > 1e-6 THEN ri ELSE 0 END, z1 FROM dn WHERE k < m AND abs(ri - ni) > 1e-6 UNION ALL SELECT part_id, 3, -k, 1, CASE WHEN ri > 1e-6 THEN ri ELSE 0 END, z FROM dn WHERE k < m),
    ln AS (SELECT part_id, row_number() OVER w AS i, x AS sx, y AS sy, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM pt WINDOW w AS (PARTITION BY part_id ORDER BY leg, key, sub))
    SELECT part_id, i, {", ".join(f"{Q6(c)} AS {c}" for c in pr.ENDS)} FROM ln WHERE ex IS NOT NULL"""


def _rounded(lines: DataFrame) -> DataFrame:
    return lines.select("part_id", "i", *[r6(F.col(c)).alias(c) for c in pr.ENDS])


@query(f"WITH {GAPS}, {_profile_sql(False)}")
def w15_profile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pr.from_overlapping(overlapping(spark, d)))


@query(f"WITH {GAPS}, {_profile_sql(True)}")
def w15_profile_by_ends(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pr.from_overlapping(overlapping(spark, d), by_ends=True))


def faces(spark: SparkSession, d: str) -> DataFrame:
    """Faces of the turned profiles; a segment without a bore has a cross hole of an eighth of its outside, of thin ones with a flat bottom."""
    s, c = segments(spark, d, gaps=True), F.col
    turned = pr.revolved_faces(pr.from_segments(s))
    middle = (c("z_start") + c("z_end")) / 2
    cross = s.where("id_diameter = 0").select("part_id", "seq", middle.alias("z"), (c("od_diameter") / 8).alias("r"))
    common = lambda face, surface, radius, area: F.struct(face.alias("face"), F.lit(surface).alias("surface"), F.lit(True).alias("internal"), radius.alias("radius"), *[F.lit(0.0).alias(x) for x in ("ox", "oy")], c("z").alias("oz"), F.lit(1.0).alias("dx"), *[F.lit(0.0).alias(x) for x in ("dy", "dz")], (c("z") - c("r")).alias("t_min"), (c("z") + c("r")).alias("t_max"), area.alias("area"))
    none = F.lit(None).cast("double")
    made = F.array(common(1000 + 2 * c("seq"), "CYLINDER", c("r"), none), F.when(c("r") < 0.2, common(1001 + 2 * c("seq"), "PLANE", none, F.lit(1.0))))
    return turned.unionByName(cross.select("part_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("f")).select("part_id", "f.*"))


FACES = f"""{LOOP}, rv AS (SELECT *, abs(sx - ex) <= 1e-6 AS along, abs(sy - ey) <= 1e-6 AS across FROM lp), xh AS (SELECT part_id, seq, (z_start + z_end) / 2 AS z, od_diameter / 8 AS r FROM segments WHERE id_diameter = 0),
    fc AS (SELECT part_id, i AS face, CASE WHEN along THEN 'CYLINDER' WHEN across THEN 'PLANE' ELSE 'CONE' END AS surface, along AND ey < sy AS internal, CASE WHEN along THEN sx END AS radius, CASE WHEN NOT along AND across THEN sy ELSE 0 END AS oz, 0::DOUBLE AS dx, CASE WHEN NOT along AND across AND ex > sx THEN -1 ELSE 1 END::DOUBLE AS dz,
        least(sy, ey) AS t_min, greatest(sy, ey) AS t_max, CASE WHEN NOT along AND across THEN abs(ex * ex - sx * sx) * pi() END AS area FROM rv WHERE NOT (along AND greatest(sx, ex) <= 1e-6) AND NOT (along AND across)
      UNION ALL SELECT part_id, 1000 + 2 * seq, 'CYLINDER', true, r, z, 1, 0, z - r, z + r, NULL FROM xh UNION ALL SELECT part_id, 1001 + 2 * seq, 'PLANE', true, NULL, z, 1, 0, z - r, z + r, 1 FROM xh WHERE r < 0.2)"""
#: The fold as a recursion over a part's cylinders; all points lie on the part's axis, so that axes along it are one, and others by their height.
FOUND = f"""{FACES}, cy AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY face) AS k FROM fc WHERE surface = 'CYLINDER'),
    st AS (SELECT part_id, 0::BIGINT AS k, []::STRUCT(internal BOOLEAN, dx DOUBLE, oz DOUBLE)[] AS gs, []::STRUCT(grp BIGINT, radius DOUBLE)[] AS cs, 0::BIGINT AS grp, 0::BIGINT AS cl FROM (SELECT DISTINCT part_id FROM cy)
      UNION ALL SELECT part_id, k, CASE WHEN g > len(gs) THEN list_append(gs, one) ELSE gs END, CASE WHEN coalesce(c, 0) = 0 THEN list_append(cs, {{'grp': g, 'radius': radius}}) ELSE cs END, g, CASE WHEN coalesce(c, 0) = 0 THEN len(cs) + 1 ELSE c END
      FROM (SELECT *, list_position(list_transform(cs, lambda x: x.grp = g AND abs(x.radius - radius) <= 1e-3), true) AS c
        FROM (SELECT s.part_id, f.k, s.gs, s.cs, f.radius, {{'internal': f.internal, 'dx': f.dx, 'oz': f.oz}} AS one, coalesce(nullif(list_position(list_transform(s.gs, lambda x: x.internal = f.internal AND x.dx = f.dx AND (f.dx = 0 OR abs(x.oz - f.oz) <= 1e-3)), true), 0), len(s.gs) + 1) AS g FROM st s JOIN cy f ON f.part_id = s.part_id AND f.k = s.k + 1))),
    cl AS (SELECT part_id, cl, any_value(grp) AS grp, arg_min(cy.internal, face) AS internal, arg_min(radius, face) AS radius, arg_min(dx, face) AS dx, arg_min(oz, face) AS oz, min(face) AS first_face, count(*) AS n_faces, min(t_min) AS t_min, max(t_max) AS t_max FROM st JOIN cy USING (part_id, k) GROUP BY part_id, cl),
    en AS (SELECT cl.part_id, cl, count(p.face) AS n, min(CASE WHEN cl.dx = 0 THEN p.oz - cl.oz ELSE 0 END) AS low, max(CASE WHEN cl.dx = 0 THEN p.oz - cl.oz ELSE 0 END) AS high FROM cl LEFT JOIN (SELECT * FROM fc WHERE surface = 'PLANE') p ON p.part_id = cl.part_id AND (p.dx = 0) = (cl.dx = 0) AND (cl.dx = 0 OR abs(p.oz - cl.oz) < 1e-3) GROUP BY ALL),
    fo AS (SELECT part_id, CASE WHEN internal THEN 'HOLE' ELSE 'CYLINDER' END AS kind, CASE WHEN internal THEN 'hole_' ELSE 'cylinder_' END || (row_number() OVER (PARTITION BY part_id, internal ORDER BY grp, first_face) - 1) AS id, radius, n_faces, n AS n_end_faces,
      CASE WHEN n < CASE WHEN internal THEN 1 ELSE 2 END THEN 'Infinity'::DOUBLE WHEN n = 1 THEN abs(low) ELSE high - low END AS depth, CASE WHEN internal THEN CASE WHEN n > 0 THEN 'FLAT' ELSE 'NONE' END END AS bottom_type, t_min, t_max FROM cl JOIN en USING (part_id, cl))"""
FOUND = FOUND.replace(" st AS (SELECT", " st(part_id, k, gs, cs, grp, cl) AS (SELECT")


@query(f"WITH RECURSIVE {GAPS}, {FOUND} SELECT part_id, kind, id, radius, n_faces, n_end_faces, CASE WHEN isinf(depth) THEN depth ELSE {Q6('depth')} END AS depth, bottom_type, {Q6('t_min')} AS t_min, {Q6('t_max')} AS t_max FROM fo")
def i10_features_from_faces(spark: SparkSession, d: str) -> DataFrame:
    f = fe.from_faces(faces(spark, d), unmeasured=True)
    return f.withColumns({"depth": F.when(F.col("depth") == float("inf"), F.col("depth")).otherwise(r6(F.col("depth"))), "t_min": r6(F.col("t_min")), "t_max": r6(F.col("t_max"))})


PLANES = "pf AS (SELECT part_id, 'planar_face_' || (row_number() OVER (PARTITION BY part_id ORDER BY face) - 1) AS id, CASE WHEN dz > 0.9 THEN 'TOP' WHEN dz < -0.9 THEN 'BOTTOM' ELSE 'SIDE' END AS orientation, area FROM fc WHERE surface = 'PLANE')"


@query(f"WITH {GAPS}, {FACES}, {PLANES} SELECT part_id, id, orientation, {Q6('area')} AS area FROM pf")
def i11_planar_features(spark: SparkSession, d: str) -> DataFrame:
    return fe.planar_features(faces(spark, d)).withColumn("area", r6(F.col("area")))


@query(f"""WITH RECURSIVE {GAPS}, {FOUND}, {PLANES}, h AS (SELECT part_id, count(*) AS n_faces, count(*) FILTER (surface = 'PLANE') AS n_plane, count(*) FILTER (surface = 'CYLINDER') AS n_cylinder, count(*) FILTER (surface = 'CONE') AS n_cone, 0::BIGINT AS n_sphere, 0::BIGINT AS n_other FROM fc GROUP BY part_id),
    g AS (SELECT part_id, count(*) FILTER (kind = 'HOLE') AS n_holes, count(*) FILTER (kind = 'CYLINDER') AS n_cylinders FROM fo GROUP BY part_id), p AS (SELECT part_id, count(*) AS n_planar FROM pf GROUP BY part_id)
    SELECT h.*, coalesce(n_holes, 0) AS n_holes, coalesce(n_cylinders, 0) AS n_cylinders, coalesce(n_planar, 0) AS n_planar FROM h LEFT JOIN g USING (part_id) LEFT JOIN p USING (part_id)""")
def a17_r02_face_summary(spark: SparkSession, d: str) -> DataFrame:
    return fe.feature_summary(faces(spark, d), unmeasured=True)
