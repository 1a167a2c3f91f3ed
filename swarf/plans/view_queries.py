"""Registered queries of the choice of views, their normalised points, and the conventions of space, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarf.functions import geometry as g
from swarf.operators import views as vw
from swarf.plans.other_queries import SCORED, lines, scored
from swarf.plans.part_queries import Q6
from swarf.plans.registry import ORACLE, query
from swarf.sources.tables import r6, segments, segments_sql


@query(f"""WITH {SCORED}, pv AS (SELECT *, row_number() OVER (PARTITION BY job_id, page ORDER BY view_index) - 1 AS k FROM scored), pg AS (SELECT job_id, page, CASE WHEN page % 6 = 5 THEN 0 ELSE count(*) END AS n FROM scored GROUP BY job_id, page),
    best AS (SELECT job_id, page, CASE WHEN job_id % 9 <> 4 THEN view_index END AS view_index FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY view_conf DESC, page, view_index) AS place FROM scored) WHERE place = 1 AND view_conf >= 0.65),
    ask AS (SELECT job_id, CASE WHEN a = 0 THEN NULL WHEN a = 5 THEN page + 1000 ELSE page END AS page, CASE a WHEN 2 THEN ' 12 ' WHEN 3 THEN '-1' WHEN 4 THEN 'one' WHEN 0 THEN NULL WHEN 6 THEN NULL ELSE view_index::VARCHAR END AS idx FROM (SELECT *, (page * 10 + view_index) % 8 AS a FROM scored)),
    j AS (SELECT ask.job_id, CASE WHEN ask.idx IS NOT NULL THEN 'given' WHEN best.job_id IS NOT NULL THEN 'best' END AS source, CASE WHEN ask.idx IS NOT NULL THEN ask.page ELSE best.page END AS page, coalesce(ask.idx, best.view_index::VARCHAR) AS idx FROM ask LEFT JOIN best USING (job_id)),
    v AS (SELECT j.*, try_cast(trim(idx) AS BIGINT) AS i FROM j),
    e AS (SELECT v.job_id, v.page, v.i AS view_index, source, coalesce(source = 'given', false) AND s.job_id IS NOT NULL AS ranked, pv.page || '/' || pv.view_index AS box, pv.angle AS area, CASE WHEN source IS NULL THEN 'NO_BEST_VIEW' WHEN v.page IS NULL OR idx IS NULL THEN 'MISSING_SELECTION'
        WHEN pg.n IS NULL THEN 'MISSING_PAGE' WHEN pg.n = 0 THEN 'NO_VIEWS' WHEN v.i IS NULL THEN 'INDEX_NOT_INTEGER' WHEN v.i < 0 OR v.i >= pg.n THEN 'INDEX_OUT_OF_RANGE' WHEN pv.n_v = 0 THEN 'MISSING_BOX' END AS error
      FROM v LEFT JOIN pg ON pg.job_id = v.job_id AND pg.page = v.page LEFT JOIN pv ON pv.job_id = v.job_id AND pv.page = v.page AND pv.k = v.i LEFT JOIN scored s ON s.job_id = v.job_id AND s.page = v.page AND s.view_index = v.i)
    SELECT job_id, page, view_index, source, ranked, CASE WHEN error IS NULL THEN box END AS box, CASE WHEN error IS NULL THEN area::DOUBLE END AS area, error FROM e""")
def j07_v17_select_view(spark: SparkSession, d: str) -> DataFrame:
    """A request for each scored view: with nothing, with a page alone, or with both, some of them wrong."""
    s, c = scored(spark, d), F.col
    a = (c("page") * 10 + c("view_index")) % 8
    index = F.when(a == 2, " 12 ").when(a == 3, "-1").when(a == 4, "one").when(a.isin(0, 6), None).otherwise(c("view_index").cast("string"))
    asked = s.select("job_id", F.when(a == 5, c("page") + 1000).when(a != 0, c("page")).alias("page"), index.alias("view_index"))
    best = F.struct("page", F.when(c("job_id") % 9 != 4, c("view_index")).alias("view_index"))
    results = vw.ranked_views(s).groupBy("job_id").agg(F.collect_list(F.struct("page", "view_index")).alias("ranked_views"), F.max(F.when(c("selected"), best)).alias("best_view"))
    view = F.struct(F.concat_ws("/", "page", "view_index").alias("box"), F.when(c("n_v") > 0, F.array("n_h", "n_v")).alias("box_pixels"), c("angle").alias("area"))
    pages = s.groupBy("job_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("view_index", view.alias("v")))), lambda x: x["v"]).alias("views"))
    pages = pages.withColumns({"views": F.when(c("page") % 6 == 5, F.slice("views", 1, 0)).otherwise(c("views")), "image_size": F.lit("400x300")})
    return vw.select_view(asked, results, pages).select("job_id", "page", c("view_index").cast("long").alias("view_index"), "source", "ranked", "box", "area", "error")


@query(f"""WITH best AS ({ORACLE['m07_t06_best_axis']}), l AS (SELECT user_id AS view_id, event_id AS i, event_id * 7 % 400 AS x1, event_id * 11 % 300 AS y1, event_id * 13 % 400 AS x2, event_id * 17 % 300 AS y2 FROM events),
    a AS (SELECT view_id, x1, y1, x2, y2, atan2(y2 - y1, x2 - x1) * 180 / pi() AS angle FROM l JOIN best ON best.view_id = l.view_id AND best.line = l.i), t AS (SELECT *, radians(CASE WHEN abs(angle) < 90 THEN 90 - angle ELSE -(90 + angle) END) AS turn FROM a),
    m AS (SELECT view_id, turn, 200 - (cos(turn) * ((x1 + x2) / 2 - 200) + sin(turn) * ((y1 + y2) / 2 - 150) + 200) AS shift FROM t),
    n AS (SELECT l.view_id, i, coalesce(cos(turn) * (x1 - 200) + sin(turn) * (y1 - 150) + 200 + shift, x1) AS x, coalesce(cos(turn) * (y1 - 150) - sin(turn) * (x1 - 200) + 150, y1) AS y, turn FROM l LEFT JOIN m USING (view_id))
    SELECT view_id, i, {Q6('x + 1e-10')} AS x, {Q6('y + 1e-10')} AS y, CASE WHEN turn IS NOT NULL THEN x >= -1e-6 AND x <= 399.000001 AND y >= -1e-6 AND y <= 299.000001 END AS inside FROM n""".replace("SELECT view_id, x1", "SELECT l.view_id, x1"))
def i04_normalised_points(spark: SparkSession, d: str) -> DataFrame:
    """The first ends of all lines of a view, after its best axis was made vertical and centred."""
    ls, c = lines(spark, d), F.col
    best = vw.best_axis(ls).select("view_id", c("line").alias("i"), "angle")
    points = ls.select("view_id", "i", c("x1").alias("x"), c("y1").alias("y"))
    return vw.normalised_points(points, vw.normalised_axis(ls.join(best, ["view_id", "i"]))).select("view_id", "i", r6(c("x") + 1e-10).alias("x"), r6(c("y") + 1e-10).alias("y"), "inside")


@query(f"WITH {segments_sql()}, c AS (SELECT part_id, seq, unnest([od_diameter / 2, id_diameter / 2]) AS radius, z_end AS axial FROM segments) SELECT part_id, seq, radius AS x, 0::DOUBLE AS y, axial AS z, radius, axial FROM c")
def p12_profile_and_solid(spark: SparkSession, d: str) -> DataFrame:
    """The upper corners of each segment in space, and from there back."""
    s = segments(spark, d).select("part_id", "seq", F.explode(F.array(F.col("od_diameter") / 2, F.col("id_diameter") / 2)).alias("r"), "z_end")
    s = s.select("part_id", "seq", g.to_solid(F.col("r"), F.col("z_end")).alias("p"))
    return s.select("part_id", "seq", "p.*", g.to_profile(F.col("p.x"), F.col("p.z")).alias("q")).select("part_id", "seq", "x", "y", "z", "q.*")
