"""Registered queries of views, texts, jobs and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.functions import geometry as g
from swarf.functions import text as tx
from swarf.operators import jobs as jb
from swarf.operators import normalize
from swarf.operators import views as vw
from swarf.plans.part_queries import Q6
from swarf.plans.registry import query
from swarf.sources import documents as dc
from swarf.sources import files as fl
from swarf.sources.tables import PARTS_SQL, parts, r6, segments, segments_sql, table

SEG = segments_sql()

# ---- views ----


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k / 20).cast("long").alias("page"), (k % 20).alias("view_index"), (F.col("p_size") * 40).cast("long").alias("w"), (k % 37 * 30).alias("h"), F.lit(2000).alias("page_w"), F.lit(1500).alias("page_h"))


BOXES = """boxes AS (SELECT p_partkey // 20 AS page, p_partkey % 20 AS view_index, (p_size * 40)::BIGINT AS w, p_partkey % 37 * 30 AS h FROM part),
    cand AS (SELECT *, w * h AS area, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, view_index) AS place FROM boxes WHERE w * h >= 30000 AND h > 0 AND w / h BETWEEN 0.1 AND 10)"""


@query(f"WITH {BOXES} SELECT page, view_index, area, place FROM cand WHERE place <= 10")
def v13_t01_view_candidates(spark: SparkSession, d: str) -> DataFrame:
    return vw.candidates(boxes(spark, d)).select("page", "view_index", "area", "place")


@query(f"WITH {BOXES} SELECT page, count(*) AS n FROM cand WHERE place <= 10 GROUP BY page UNION ALL SELECT -1, count(*) FROM cand WHERE place <= 10")
def a16_view_totals(spark: SparkSession, d: str) -> DataFrame:
    return vw.candidates(boxes(spark, d)).rollup("page").agg(F.count("*").alias("n")).select(F.coalesce("page", F.lit(-1)).alias("page"), "n")


@query(f"WITH {BOXES} SELECT page, view_index, area FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY area DESC, view_index) AS k FROM cand) WHERE k = 1")
def t05_largest_contour(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).withColumn("area", F.col("w") * F.col("h")).where("area >= 30000 and h > 0 and w / h between 0.1 and 10")
    m = b.groupBy("page").agg(F.max_by(F.struct("view_index", "area"), F.struct("area", -F.col("view_index"))).alias("m"))
    return m.select("page", "m.view_index", "m.area")


def scored(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    v = lambda m: (k % m) / F.lit(float(m - 1))
    s = table(spark, d, "part").select((k / 40).cast("long").alias("job_id"), (k / 10).cast("long").alias("page"), (k % 10).alias("view_index"), (k % 180 - 90).cast("double").alias("angle"), (k % 6).alias("n_h"), (k % 5).alias("n_v"), v(11).alias("fill"), (F.col("p_size") / F.lit(10.0)).alias("aspect"), v(101).alias("axis_conf"), v(97).alias("sym_conf"), v(13).alias("dia"), v(17).alias("section"))
    s = s.withColumn("profile", r6(vw.profile_score(F.col("angle"), F.col("n_h"), F.col("fill"), F.col("n_v"), F.col("aspect"))))
    return s.withColumn("view_conf", r6(vw.view_confidence(*map(F.col, ("axis_conf", "sym_conf", "profile", "dia", "section")))))


SCORED = f"""sc0 AS (SELECT p_partkey // 40 AS job_id, p_partkey // 10 AS page, p_partkey % 10 AS view_index, p_partkey % 180 - 90 AS angle, p_partkey % 6 AS n_h, p_partkey % 5 AS n_v, p_partkey % 11 / 10.0::DOUBLE AS fill, p_size / 10.0::DOUBLE AS aspect,
      p_partkey % 101 / 100.0::DOUBLE AS axis_conf, p_partkey % 97 / 96.0::DOUBLE AS sym_conf, p_partkey % 13 / 12.0::DOUBLE AS dia, p_partkey % 17 / 16.0::DOUBLE AS section FROM part),
    sc1 AS (SELECT *, {Q6('least(1, greatest(0, 0.3::DOUBLE + CASE WHEN abs(angle) > 75 AND abs(angle) < 105 THEN least(0.3::DOUBLE, n_h * 0.08::DOUBLE) ELSE 0 END + CASE WHEN fill > 0.2 THEN 0.2 ELSE 0 END::DOUBLE + least(0.2::DOUBLE, n_v * 0.05::DOUBLE) + CASE WHEN aspect > 1 AND aspect < 6 THEN 0.2 ELSE 0 END::DOUBLE))')} AS profile FROM sc0),
    scored AS (SELECT *, {Q6('axis_conf * 0.35::DOUBLE + sym_conf * 0.35::DOUBLE + profile * 0.2::DOUBLE + dia * 0.05::DOUBLE + section * 0.05::DOUBLE')} AS view_conf FROM sc1)"""


@query(f"WITH {SCORED} SELECT job_id, page, view_index, profile, view_conf FROM scored")
def m06_m09_view_confidence(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("job_id", "page", "view_index", "profile", "view_conf")


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY view_conf DESC, page, view_index) AS place FROM scored) SELECT job_id, page, view_index, place, place = 1 AND view_conf >= 0.65 AS selected FROM r")
def t02_v16_ranked_views(spark: SparkSession, d: str) -> DataFrame:
    return vw.ranked_views(scored(spark, d)).select("job_id", "page", "view_index", "place", "selected")


@query(f"""WITH {SCORED}, want AS (SELECT DISTINCT job_id, job_id * 4 AS page, CASE WHEN job_id % 3 = 0 THEN 99 ELSE job_id % 10 END AS view_index FROM scored)
    SELECT job_id, w.page, w.view_index, coalesce(s.view_conf, 0) AS view_conf, CASE WHEN s.view_conf IS NOT NULL THEN 'ranked' WHEN w.view_index BETWEEN 0 AND 9 THEN 'views' ELSE 'OUT_OF_RANGE' END AS found FROM want w LEFT JOIN scored s USING (job_id, page, view_index)""")
def j07_v17_view_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    want = s.select("job_id").distinct().select("job_id", (F.col("job_id") * 4).alias("page"), F.when(F.col("job_id") % 3 == 0, F.lit(99)).otherwise(F.col("job_id") % 10).cast("long").alias("view_index"))
    out = want.join(s.select("job_id", "page", "view_index", "view_conf"), ["job_id", "page", "view_index"], "left")
    found = F.when(F.col("view_conf").isNotNull(), "ranked").when(F.col("view_index").between(0, 9), "views").otherwise("OUT_OF_RANGE")
    return out.select("job_id", "page", "view_index", F.coalesce("view_conf", F.lit(0.0)).alias("view_conf"), found.alias("found"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("view_id"), k.alias("i"), (k * 7 % 400).alias("x1"), (k * 11 % 300).alias("y1"), (k * 13 % 400).alias("x2"), (k * 17 % 300).alias("y2"), F.lit(400).alias("w"), F.lit(300).alias("h"))


@query(f"""WITH l0 AS (SELECT user_id AS view_id, event_id AS i, event_id * 7 % 400 AS x1, event_id * 11 % 300 AS y1, event_id * 13 % 400 AS x2, event_id * 17 % 300 AS y2 FROM events),
    l1 AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len, atan2(y2 - y1, x2 - x1) * 180 / pi() AS angle FROM l0), l2 AS (SELECT *, CASE WHEN abs(angle) > 90 THEN 180 - abs(angle) ELSE abs(angle) END AS st FROM l1 WHERE len > 0),
    l3 AS (SELECT *, len / 400 * 0.4::DOUBLE + (1 - least(st, 90 - st) / 45) * 0.4::DOUBLE + greatest(0, 1 - sqrt(((x1 + x2) / 2 - 200) ** 2 + ((y1 + y2) / 2 - 150) ** 2) / (400 * 0.3::DOUBLE)) * 0.2::DOUBLE AS score FROM l2),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY floor(score * 1e9 + 0.5) DESC, i) AS k FROM l3) WHERE k = 1),
    c AS (SELECT t.view_id, count(*) FILTER (abs(l3.angle - t.angle) < 5 AND abs(l3.len - t.len) / t.len < 0.3) AS n FROM l3 JOIN t ON l3.view_id = t.view_id GROUP BY ALL)
    SELECT view_id, i AS line, {Q6('angle')} AS angle, {Q6('len')} AS length, {Q6('least(1, greatest(0, score + least(0.2::DOUBLE, n * 0.05::DOUBLE)))')} AS axis_conf FROM t JOIN c USING (view_id)""")
def m07_t06_best_axis(spark: SparkSession, d: str) -> DataFrame:
    b = vw.best_axis(lines(spark, d))
    return b.select("view_id", "line", *[r6(F.col(c)).alias(c) for c in ("angle", "length", "axis_conf")])


def crops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pixels by hashing events into a small grid, one value a cell."""
    k = F.col("event_id")
    p = table(spark, d, "events").select(F.col("user_id").alias("view_id"), (k % 16).alias("x"), (k / 16 % 8).cast("long").alias("y"), (k * 37 % 256).alias("v"))
    p = p.groupBy("view_id", "x", "y").agg(F.max("v").cast("double").alias("v")).withColumn("edge", F.col("v") > 200)
    return p, p.select("view_id").distinct().withColumn("w", F.lit(16))


@query(f"""WITH p0 AS (SELECT user_id AS view_id, event_id % 16 AS x, event_id // 16 % 8 AS y, max(event_id * 37 % 256)::DOUBLE AS v FROM events GROUP BY ALL), p AS (SELECT *, v > 200 AS edge FROM p0),
    j AS (SELECT a.view_id, a.v AS a, b.v AS b, a.edge AS ea, b.edge AS eb FROM p a JOIN p b ON a.view_id = b.view_id AND a.y = b.y AND b.x = 15 - a.x WHERE a.x < 7.5),
    t AS (SELECT view_id, count(*) AS n, CASE WHEN count(*) > 1 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS c, avg((a - b) ** 2) AS mse, count(*) FILTER (ea AND eb) AS bo, count(*) FILTER (ea OR eb) AS an FROM j GROUP BY view_id)
    SELECT view_id, n, {Q6('least(1, greatest(0, 0.5 * (coalesce(c, 0) + 1) / 2 + 0.3 * (1 - mse / 65025) + 0.2 * CASE WHEN an > 0 THEN bo / an ELSE 0 END))')} AS symmetry FROM t""")
def m08_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return vw.symmetry(*crops(spark, d)).withColumn("symmetry", r6(F.col("symmetry")))


def dims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    k = F.col("event_id")
    value = F.when(k % 9 == 0, 1.245 + (k % 11) / 1000).when(k % 9 == 1, 1.654 + (k % 7) / 1000).otherwise(F.col("value"))
    rows = e.select(F.col("user_id").alias("view_id"), k.alias("i"), value.alias("value"), F.when(k % 5 == 0, "mm").otherwise("in").alias("unit"), ((k % 50) / F.lit(100.0) + 0.5).alias("confidence"))
    return rows, e.groupBy(F.col("user_id").alias("view_id")).agg((F.max("value") * 3).alias("length_px"), F.max("value").alias("od_px"))


DIMS = """dm AS (SELECT user_id AS view_id, event_id AS i, CASE event_id % 9 WHEN 0 THEN 1.245::DOUBLE + event_id % 11 / 1000::DOUBLE WHEN 1 THEN 1.654::DOUBLE + event_id % 7 / 1000::DOUBLE ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN 'mm' ELSE 'in' END AS unit, event_id % 50 / 100.0::DOUBLE + 0.5::DOUBLE AS confidence FROM events),
    me AS (SELECT user_id AS view_id, max(value) * 3 AS lp, max(value) AS op FROM events GROUP BY 1),
    an0 AS (SELECT view_id, i, value, confidence, unnest([{'k': 0, 'name': 'overall_length', 'px': lp}, {'k': 1, 'name': 'max_od_diameter', 'px': op}]) AS way FROM dm JOIN me USING (view_id) WHERE unit = 'in' AND (value BETWEEN 1.245::DOUBLE AND 1.255::DOUBLE OR value BETWEEN 1.654::DOUBLE AND 1.66::DOUBLE)),
    an1 AS (SELECT *, value / way.px AS scale FROM an0 WHERE way.px > 0), an2 AS (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY confidence DESC, i, way.k) AS rn FROM an1 WHERE scale > 0.0001 AND scale < 0.1),
    an AS (SELECT view_id, way.name AS name, value, way.px AS pixel_length, scale AS inch_per_pixel, confidence FROM an2 WHERE rn = 1)"""


@query(f"WITH {DIMS} SELECT view_id, name, {Q6('value')} AS value, {Q6('pixel_length')} AS pixel_length, {Q6('inch_per_pixel')} AS inch_per_pixel, confidence FROM an")
def j05_t03_anchor(spark: SparkSession, d: str) -> DataFrame:
    return vw.anchors(*dims(spark, d)).select("view_id", "name", "confidence", *[r6(F.col(c)).alias(c) for c in ("value", "pixel_length", "inch_per_pixel")])


@query(f"WITH {DIMS} SELECT view_id, CASE WHEN name IS NULL THEN 'estimated' ELSE 'anchor_dimension' END AS method, {Q6('coalesce(inch_per_pixel, 1.25::DOUBLE / (view_id * 10 * 0.7::DOUBLE), 0.01)')} AS inch_per_pixel FROM me LEFT JOIN an USING (view_id)")
def m12_scale(spark: SparkSession, d: str) -> DataFrame:
    rows, measured = dims(spark, d)
    return vw.scales(measured.select("view_id", (F.col("view_id") * 10).alias("h")), vw.anchors(rows, measured)).withColumn("inch_per_pixel", r6(F.col("inch_per_pixel")))


# ---- texts ----

NUM = r"(\d+\.\d+)"


@query(rf"""WITH t AS (SELECT doc_id, text FROM documents), m AS (
      SELECT doc_id, 0 AS pattern, unnest(regexp_extract_all(text, '(?i){NUM}\s*["'']', 0)) AS match FROM t UNION ALL SELECT doc_id, 1, unnest(regexp_extract_all(text, '(?i){NUM}\s*in', 0)) FROM t
      UNION ALL SELECT doc_id, 2, unnest(regexp_extract_all(text, '{NUM}', 0)) FROM t)
    SELECT doc_id AS key, pattern::BIGINT AS pattern, regexp_extract(match, '{NUM}', 1)::DOUBLE AS value, match FROM m""")
def x01_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """All four patterns; the SQL has no brackets and no fractions, which no given document has. The tests have both."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return tx.dimensions(t).select("key", "pattern", "value", "match")


@query(r"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE (p_partkey % 5)::VARCHAR || CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '–' END || (p_partkey % 7)::VARCHAR || '/' || (p_partkey % 8)::VARCHAR END AS t FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 8 = 0 THEN NULL ELSE p_partkey % 5 + (p_partkey % 7) / (p_partkey % 8)::DOUBLE END AS value FROM x""")
def x02_fractions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, "none").otherwise(F.concat((k % 5).cast("string"), F.when(k % 2 == 0, "-").otherwise("–"), (k % 7).cast("string"), F.lit("/"), (k % 8).cast("string")))
    return table(spark, d, "part").select(k, tx.fraction(t).alias("value"))


@query("""WITH t AS (SELECT doc_id % 50 AS view_id, lower(text) AS t, (doc_id % 10) / 10.0::DOUBLE AS c FROM documents)
    SELECT view_id, coalesce(max(c) FILTER (t LIKE '%ø%' OR t LIKE '%dia%'), 0) AS dia_conf, coalesce(max(c) FILTER (t LIKE '%section%' OR t LIKE '%view%' OR t LIKE '%a-a%'), 0) AS section_conf, coalesce(max(c) FILTER (c >= 0.5), 0) AS kept FROM t GROUP BY view_id""")
def x03_v15_text_hints(spark: SparkSession, d: str) -> DataFrame:
    """A box of text is a document, searched whole; those under 0.5 aren't kept."""
    t = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("view_id"), F.lower("text").alias("t"), ((F.col("doc_id") % 10) / F.lit(10.0)).alias("c"))
    has = lambda *ws: F.coalesce(F.max(F.when(F.lit(False) | sum((F.col("t").contains(w).cast("int") for w in ws), F.lit(0)).cast("boolean"), F.col("c"))), F.lit(0.0))
    return t.groupBy("view_id").agg(has("ø", "dia").alias("dia_conf"), has("section", "view", "a-a").alias("section_conf"), F.coalesce(F.max(F.when(F.col("c") >= 0.5, F.col("c"))), F.lit(0.0)).alias("kept"))


def _listed(list_: str, one: str, many: str) -> str:
    """A sentence about the sections of a list, in words for one and for several; null if there are none."""
    return f"CASE WHEN {list_}.n = 1 THEN {one} ELSE {many} END".replace("{}", f"' || {list_}.said || '").replace("{n}", f"' || {list_}.n || '")


X04 = f"""WITH {SEG}, o AS (SELECT part_id, row_number() OVER (PARTITION BY part_id ORDER BY seq) AS i, z_end - z_start AS l, od_diameter, id_diameter, confidence, CASE WHEN part_id % 5 <> 0 THEN (part_id % 50 + 50) / 100.0::DOUBLE END AS overall FROM segments),
    k AS (SELECT part_id, i, 'thin' AS list FROM o WHERE (od_diameter - id_diameter) / 2 > 0 AND (od_diameter - id_diameter) / 2 < 0.05 UNION ALL SELECT part_id, i, 'bore' FROM o WHERE id_diameter > 0 UNION ALL SELECT part_id, i, 'low' FROM o WHERE overall IS NOT NULL AND confidence < 0.65
      UNION ALL SELECT part_id, i, 'thin_wall' FROM o WHERE od_diameter - id_diameter < 0.1 UNION ALL SELECT part_id, i, 'low_confidence' FROM o WHERE confidence < 0.6),
    r AS (SELECT part_id, list, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY part_id, list ORDER BY i) AS run FROM k) GROUP BY part_id, list, run),
    q AS (SELECT part_id, list, sum(n)::BIGINT AS n, min(a) AS first, list(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END ORDER BY a) AS runs FROM r GROUP BY part_id, list),
    t AS (SELECT part_id, list, n, first, CASE len(runs) WHEN 1 THEN runs[1] WHEN 2 THEN runs[1] || ' and ' || runs[2] ELSE array_to_string(runs[:len(runs) - 1], ', ') || ', and ' || runs[len(runs)] END AS said FROM q),
    p AS (SELECT part_id, count(*) AS n, any_value(overall) AS overall, max(l) AS l FROM o GROUP BY part_id), g AS (SELECT part_id, min(i) AS i FROM o JOIN p USING (part_id, l) GROUP BY part_id),
    f AS (SELECT p.part_id, fa.first AS first_a, fb.first AS first_b, {_listed("fa", "'Section {} has thin walls.'", "'Sections {} have thin walls.'")} AS a, {_listed("fb", "'Section {} has low confidence.'", "'Sections {} have low confidence.'")} AS b
      FROM p LEFT JOIN t fa ON fa.part_id = p.part_id AND fa.list = 'thin_wall' LEFT JOIN t fb ON fb.part_id = p.part_id AND fb.list = 'low_confidence')
    SELECT p.part_id, trim(regexp_replace(concat_ws(' ', 'This part has ' || p.n || CASE WHEN p.n = 1 THEN ' turned section.' ELSE ' turned sections.' END, CASE WHEN l > 0 THEN 'The longest section is ' || printf('%.2f', l) || ' in (section ' || g.i || ').' END,
      {_listed("th", "'One thin-wall area was detected in section {} and needs review.'", "'{n} thin-wall areas were detected in sections {} and need review.'")},
      CASE WHEN bo.n IS NULL THEN 'No internal bore detected (solid part).' WHEN bo.n = p.n THEN 'Internal bore is present throughout all sections.' ELSE {_listed("bo", "'Internal bore appears only in section {}.'", "'Internal bore appears in sections {}.'")} END,
      {_listed("lo", "'Section {} has low confidence and may need manual review.'", "'Sections {} have low confidence and may need manual review.'")},
      CASE WHEN first_b < first_a THEN concat_ws(' ', b, a) ELSE concat_ws(' ', a, b) END,
      CASE WHEN overall IS NOT NULL THEN 'Overall detection confidence is ' || CASE WHEN overall >= 0.85 THEN 'high' WHEN overall >= 0.65 THEN 'medium' ELSE 'low' END || ' (' || printf('%.0f', overall * 100) || '%).' END), '  +', ' ', 'g')) AS explanation
    FROM p JOIN g USING (part_id) JOIN f USING (part_id) LEFT JOIN t th ON th.part_id = p.part_id AND th.list = 'thin' LEFT JOIN t bo ON bo.part_id = p.part_id AND bo.list = 'bore' LEFT JOIN t lo ON lo.part_id = p.part_id AND lo.list = 'low'"""


@query(X04)
def x04_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs about all parts; a model in Python follows them in the tests too."""
    flags = F.filter(F.array(F.when(F.col("od_diameter") - F.col("id_diameter") < 0.1, "thin_wall"), F.when(F.col("confidence") < 0.6, "low_confidence")), lambda x: x.isNotNull())
    s = F.struct("seq", "z_start", "z_end", F.col("od_diameter").alias("od"), F.col("id_diameter").alias("bore"), "confidence", flags.alias("flags"))
    stacks = segments(spark, d).groupBy("part_id").agg(F.sort_array(F.collect_list(s)).alias("seg")).withColumn("overall", F.when(F.col("part_id") % 5 != 0, (F.col("part_id") % 50 + 50) / F.lit(100.0)))
    return tx.explanation(stacks)


@query(r"""SELECT p_partkey, lower(trim('  PN-' || p_partkey || ' ')) AS key, trim(CASE WHEN p_partkey % 9 = 0 THEN '   ' ELSE 'PN' END) = '' AS rejected, regexp_matches(lower(n), '\.(pdf|zip)$') AS upload, try_cast(regexp_extract('page_' || p_partkey || '.png', '^page_(\d+)\.png$', 1) AS BIGINT) AS page
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.zip' WHEN 2 THEN 'c.png' ELSE 'pdf' END AS n FROM part)""")
def x05_x07_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    n = F.when(k % 4 == 0, "a.PDF").when(k % 4 == 1, "b.zip").when(k % 4 == 2, "c.png").otherwise("pdf")
    return table(spark, d, "part").select(k, F.lower(F.trim(F.concat(F.lit("  PN-"), k.cast("string"), F.lit(" ")))).alias("key"), (F.trim(F.when(k % 9 == 0, "   ").otherwise("PN")) == "").alias("rejected"), fl.is_upload(n).alias("upload"), F.regexp_extract(F.concat(F.lit("page_"), k.cast("string"), F.lit(".png")), r"^page_(\d+)\.png$", 1).try_cast("bigint").alias("page"))


@query(f"""WITH {SEG} SELECT part_id, string_agg(printf('Ø%.3f', od_diameter) || CASE WHEN abs(z_start) < 0.01 THEN printf(' up to %.3f', z_end) ELSE printf(' from %.3f to %.3f', z_start, z_end) END, ', ' ORDER BY od_diameter DESC, z_start) AS steps FROM segments GROUP BY part_id""")
def x08_step_summary(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("part_id", F.struct((-F.col("od_diameter")).alias("r"), "z_start", tx.step_label(F.col("od_diameter") / 2, F.col("z_start"), F.col("z_end")).alias("t")).alias("x"))
    return s.groupBy("part_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), ", ").alias("steps"))


@query(f"""WITH {SEG}, f AS (SELECT part_id, seq, seq - row_number() OVER (PARTITION BY part_id ORDER BY seq) AS g FROM segments WHERE id_diameter > 0),
    r AS (SELECT part_id, min(seq) AS a, CASE WHEN count(*) = 1 THEN min(seq)::VARCHAR ELSE min(seq) || '-' || max(seq) END AS t FROM f GROUP BY part_id, g), l AS (SELECT part_id, list(t ORDER BY a) AS l FROM r GROUP BY part_id)
    SELECT part_id, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END AS sections FROM l""")
def w13_a18_section_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).where("id_diameter > 0").groupBy("part_id").agg(F.sort_array(F.collect_list("seq")).alias("l"))
    return s.select("part_id", tx.ranges(F.col("l")).alias("sections"))


@query(f"WITH {SEG}, f AS (SELECT part_id, seq, unnest(list_filter([CASE WHEN od_diameter - id_diameter < 0.1 THEN 'thin_wall' END, CASE WHEN confidence < 0.6 THEN 'low_confidence' END], lambda x: x IS NOT NULL)) AS flag FROM segments) SELECT part_id, flag, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS sections FROM f GROUP BY ALL")
def a18_flag_sections(spark: SparkSession, d: str) -> DataFrame:
    flags = F.filter(F.array(F.when(F.col("od_diameter") - F.col("id_diameter") < 0.1, "thin_wall"), F.when(F.col("confidence") < 0.6, "low_confidence")), lambda x: x.isNotNull())
    s = segments(spark, d).select("part_id", "seq", F.explode(flags).alias("flag"))
    return s.groupBy("part_id", "flag").agg(F.array_join(F.sort_array(F.collect_list("seq")), ",").alias("sections"))


@query(f"WITH {SEG}, o AS (SELECT part_id, seq, confidence AS inferred FROM segments WHERE seq % 3 <> 0) SELECT s.part_id, s.seq, coalesce(inferred, 0.5) AS confidence FROM segments s LEFT JOIN o USING (part_id, seq)")
def j06_j09_positional_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    o = s.where("seq % 3 <> 0").select("part_id", "seq", F.col("confidence").alias("inferred"))
    return s.select("part_id", "seq").join(o, ["part_id", "seq"], "left").select("part_id", "seq", F.coalesce("inferred", F.lit(0.5)).alias("confidence"))


@query(f"""WITH {segments_sql(bad=True)}, {PARTS_SQL}, s AS (SELECT s.*, overall AS axis, od_diameter > 0 AND id_diameter >= 0 AND id_diameter <= od_diameter AND z_end > z_start AS valid FROM segments s LEFT JOIN parts USING (part_id)),
    t AS (SELECT part_id, 0.6::DOUBLE * avg(0.4::DOUBLE * confidence + 0.3::DOUBLE * (((od_diameter > 0)::INT + (id_diameter >= 0)::INT + (z_end > z_start)::INT) / 3::DOUBLE) + 0.3::DOUBLE * (id_diameter <= od_diameter)::INT) + 0.2::DOUBLE * coalesce(max(axis), 0) + 0.2::DOUBLE * (count(*) FILTER (valid)) / count(*) AS overall, count(*) FILTER (valid) AS n_valid, count(*) AS n FROM s GROUP BY part_id)
    SELECT part_id, {Q6('overall + 1e-10')} AS overall, n_valid, n, CASE WHEN {Q6('overall + 1e-10')} >= 0.85 AND n_valid = n THEN 'auto_use' WHEN {Q6('overall + 1e-10')} >= 0.6 AND n_valid > 0 THEN 'manual_review' ELSE 'fallback_to_manual' END AS action FROM t""")
def m13_designed_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Completeness is the share of a segment's three measures that make sense, consistency whether its bore fits, the axis what the part's inference says."""
    c, one = F.col, lambda x: F.when(x, 1.0).otherwise(0.0)
    s = segments(spark, d, bad=True).join(parts(spark, d).select("part_id", c("overall").alias("axis")), "part_id", "left")
    long, out, bore, fits = c("z_end") > c("z_start"), c("od_diameter") > 0, c("id_diameter") >= 0, c("id_diameter") <= c("od_diameter")
    s = s.select("part_id", c("confidence").alias("dimension"), ((one(out) + one(bore) + one(long)) / 3).alias("completeness"), one(fits).alias("consistency"), (long & out & bore & fits).alias("valid"), "axis")
    return normalize.decide(s).withColumn("overall", r6(c("overall") + 1e-10))


# ---- jobs ----


def log(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_type")
    status = F.when(k == "signup", "CREATED").when(k == "click", "PROCESSING").when(k == "purchase", "COMPLETED").when(k == "error", "FAILED")
    mode = F.when((k == "view") & (F.col("event_id") % 2 == 0), F.when(F.col("event_id") % 3 == 0, "stack").otherwise("auto_convert"))
    return e.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("n"), status.alias("status"), mode.alias("mode"))


LOG = """jl AS (SELECT user_id AS job_id, ts, event_id AS n, CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS status,
      CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'stack' ELSE 'auto_convert' END END AS mode FROM events),
    js AS (SELECT job_id, min(ts) AS created_at, max(ts) AS updated_at, arg_max(status, n) FILTER (status IS NOT NULL) AS status, arg_max(mode, n) FILTER (mode IS NOT NULL) AS mode FROM jl GROUP BY job_id)"""


@query(f"WITH {LOG} SELECT job_id, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us, status, mode, CASE WHEN status = 'COMPLETED' THEN 100 ELSE 0 END::BIGINT AS progress FROM js")
def io05_io08_p18_job_states(spark: SparkSession, d: str) -> DataFrame:
    """Inserts and updates are appended; the state is the latest event."""
    s = jb.latest(log(spark, d))
    return s.select("job_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"), "status", "mode", jb.progress(F.col("status")).cast("long").alias("progress"))


@query(f"WITH {LOG} SELECT job_id, epoch_us(created_at) AS created_us FROM js ORDER BY created_at DESC, job_id")
def io07_newest_first(spark: SparkSession, d: str) -> DataFrame:
    """A range-partitioned sort of one row a job."""
    return jb.latest(log(spark, d)).select("job_id", F.unix_micros("created_at").alias("created_us")).orderBy(F.col("created_us").desc(), "job_id")


@query(f"WITH {LOG} SELECT job_id, status FROM js WHERE job_id = 8")
def io06_job_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The filter on job_id reaches the scan, below the aggregate."""
    return jb.latest(log(spark, d)).where("job_id = 8").select("job_id", "status")


@query(f"WITH {LOG} SELECT job_id, count(*) AS n FROM jl WHERE job_id % 3 <> 0 GROUP BY job_id")
def io09_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)
    return jb.delete(rows, rows.where("job_id % 3 = 0").select("job_id").distinct()).groupBy("job_id").agg(F.count("*").alias("n"))


def stages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 2 == 0, "completed").otherwise("running")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("n"), F.col("event_type").alias("name"), status.alias("status"), ts.alias("started_at"), (ts + F.expr("make_interval(0,0,0,0,0,0,value)")).alias("finished_at"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))


@query("""WITH s AS (SELECT user_id AS job_id, event_type AS name, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 2 = 0 THEN 'completed' ELSE 'running' END AS status, CASE WHEN event_type = 'error' THEN props END AS error FROM events WHERE user_id % 10 <> 3),
    g AS (SELECT job_id, count(*) AS stage_count, count(DISTINCT name) AS distinct_stages, count(*) FILTER (status = 'completed') AS completed_stages, count(*) FILTER (status = 'failed') AS failed_stages, count(error) AS error_count FROM s GROUP BY job_id)
    SELECT job_id, stage_count IS NOT NULL AS has_report, coalesce(stage_count, 0) AS stage_count, coalesce(distinct_stages, 0) AS distinct_stages, coalesce(completed_stages, 0) AS completed_stages, coalesce(failed_stages, 0) AS failed_stages, coalesce(error_count, 0) AS error_count
    FROM (SELECT DISTINCT user_id AS job_id FROM events) LEFT JOIN g USING (job_id)""")
def a15_r13_r17_report_summary(spark: SparkSession, d: str) -> DataFrame:
    reported = stages(spark, d).where("job_id % 10 <> 3")  # the other jobs have no report
    return jb.report_summary(log(spark, d).select("job_id").distinct(), reported)


@query("""WITH s AS (SELECT event_id AS n, round(value * 1e6)::BIGINT / 1000.0::DOUBLE AS ms FROM events)
    SELECT n, floor(ms + 0.5) AS duration_ms, CASE WHEN ms < 1000 THEN printf('%.0fms', ms) ELSE printf('%.2fs', ms / 1000) END AS said FROM s""")
def w16_p17_durations(spark: SparkSession, d: str) -> DataFrame:
    s = jb.with_durations(stages(spark, d))
    return s.select("n", F.floor(F.col("duration_ms") + 0.5).cast("double").alias("duration_ms"), g.duration_text(F.col("duration_ms")).alias("said"))


@query("SELECT event_id, m, coalesce(m IN ('auto_convert', 'assisted_manual', 'stack'), false) AS ok FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'stack' WHEN 1 THEN 'auto_convert' WHEN 2 THEN 'STACK' END AS m FROM events)")
def v14_mode_membership(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    m = F.when(k == 0, "stack").when(k == 1, "auto_convert").when(k == 2, "STACK")
    return table(spark, d, "events").select("event_id", m.alias("m")).withColumn("ok", F.coalesce(jb.valid_mode(F.col("m")), F.lit(False)))


@query(f"WITH {LOG}, a AS (SELECT job_id, n, ts, n % 2 = 0 AS approved FROM jl WHERE status IS NOT NULL) SELECT job_id, arg_max(n, n) AS selected, arg_max(approved, n) AS approved FROM a GROUP BY job_id")
def r19_r20_latest_choice(spark: SparkSession, d: str) -> DataFrame:
    """The view selected last, and the last approval."""
    a = log(spark, d).where("status is not null")
    return a.groupBy("job_id").agg(F.max("n").alias("selected"), F.max_by(F.col("n") % 2 == 0, "n").alias("approved"))


@query("SELECT o_orderkey % 6 AS k, CASE o_orderkey % 6 WHEN 0 THEN 'math_stack_only' WHEN 1 THEN 'reference_only_step' WHEN 2 THEN 'auto_convert_step' ELSE 'unknown' END AS source, CASE WHEN o_orderkey % 6 = 0 THEN 'OK' WHEN o_orderkey % 6 = 1 THEN 'FAILED' ELSE 'UNAVAILABLE' END AS step_status, count(*) AS n FROM orders GROUP BY ALL")
def r22_r23_tags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    source = F.when(k == 0, "math_stack_only").when(k == 1, "reference_only_step").when(k == 2, "auto_convert_step").otherwise("unknown")
    return table(spark, d, "orders").groupBy(k.alias("k"), source.alias("source"), F.when(k == 0, "OK").when(k == 1, "FAILED").otherwise("UNAVAILABLE").alias("step_status")).agg(F.count("*").alias("n"))


# ---- files ----

PATHS = ("inputs/file.pdf", "outputs/result.json", "outputs/part_summary.json", "outputs/pdf_pages/page_1.PNG", "outputs/pdf_views/page_1_views.json", "outputs/model.step", "../etc/passwd", "..\\windows\\system32", "inputs/../../../etc/passwd", "/etc/passwd", "C:\\windows\\system32", "inputs/sub/file.pdf", "other/x.bin", "a..b/x.glb")


def paths(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % len(PATHS)).cast("int")
    return table(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, PATHS)), k).alias("path"))


LISTED = "[" + ", ".join(f"'{p}'" for p in PATHS) + "]"
PATH_SQL = f"SELECT p_partkey, ({LISTED})[(p_partkey % {len(PATHS)} + 1)::INT] AS path FROM part"


@query(rf"""WITH p AS ({PATH_SQL}) SELECT p_partkey, NOT (contains(path, '..') OR starts_with(path, '/') OR contains(path, '/etc/') OR contains(path, 'C:\') OR contains(path, 'D:\')) AS safe,
    replace(replace(regexp_extract(path, '[^/]*$', 0), '..', '_'), '\', '_') AS name FROM p""")
def io11_io12_r16_path_rules(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("p_partkey", fl.safe_path(F.col("path")).alias("safe"), fl.clean_name(F.col("path")).alias("name"))


@query(rf"""WITH p AS ({PATH_SQL}), n AS (SELECT *, regexp_extract(path, '[^/]*$', 0) AS name FROM p)
    SELECT p_partkey, CASE WHEN starts_with(path, 'inputs/') THEN 'ALLOWED' WHEN starts_with(path, 'outputs/') THEN CASE WHEN starts_with(path, 'outputs/pdf_pages/') AND regexp_matches(lower(name), '\.(png|jpg|jpeg)$') OR starts_with(path, 'outputs/pdf_views/') AND lower(name) LIKE '%.json'
      OR name IN ({", ".join(f"'{a}'" for a in fl.ARTIFACTS)}) THEN 'ALLOWED' ELSE 'FORBIDDEN' END ELSE 'INVALID' END AS rule,
      CASE WHEN lower(path) LIKE '%.step' THEN 'application/step' WHEN lower(path) LIKE '%.json' THEN 'application/json' WHEN lower(path) LIKE '%.glb' THEN 'model/gltf-binary' WHEN lower(path) LIKE '%.pdf' THEN 'application/pdf' WHEN lower(path) LIKE '%.png' THEN 'image/png' ELSE 'application/octet-stream' END AS media FROM n""")
def io14_downloads(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("p_partkey", fl.downloadable(F.col("path")).alias("rule"), fl.media_type(F.col("path")).alias("media"))


@query(f"""WITH p AS ({PATH_SQL}), f AS (SELECT DISTINCT p_partkey % 100 AS job_id, regexp_extract(path, '^outputs/([^/]+)$', 1) AS name, 10 * (p_partkey % 100) AS size FROM p), j AS (SELECT DISTINCT p_partkey % 100 AS job_id FROM part),
    s AS (SELECT job_id, unnest([{", ".join(f"'{a}'" for a in fl.WELL_KNOWN)}]) AS name FROM j)
    SELECT job_id, name, size IS NOT NULL AS "exists", size, '/api/v1/jobs/' || job_id || '/download?path=outputs/' || name AS download_url FROM s LEFT JOIN f USING (job_id, name)""")
def io15_r18_inventory(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d).select((F.col("p_partkey") % 100).alias("job_id"), "path").distinct().withColumn("length", F.col("job_id") * 10)
    return fl.inventory(p.select("job_id").distinct(), p)


@query()
def io10_r15_listing(spark: SparkSession, d: str) -> DataFrame:
    """The files of the table folder itself; sizes differ by machine, so there is no SQL."""
    return fl.listing(spark, d).select("path", "length", fl.is_upload(F.col("path")).alias("upload"))


def packed(spark: SparkSession, d: str) -> DataFrame:
    """key, content: an archive of four files for each document, each with its text."""
    import io
    import zipfile

    def pack(text):
        with zipfile.ZipFile(buf := io.BytesIO(), "w") as z:
            for name in ("a/x.pdf", "b/x.pdf", "c/y.PDF", "d/z.txt"):
                z.writestr(name, text or "")
        return buf.getvalue()

    pack = F.udf(pack, "binary", useArrow=False)
    return table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("key"), pack("text").alias("content"))


@query("SELECT doc_id AS key, unnest(['x.pdf', 'x_1.pdf', 'y.PDF']) AS name, strlen(coalesce(text, '')) AS size FROM documents")
def io13_unzip(spark: SparkSession, d: str) -> DataFrame:
    """Archives made from documents, then taken apart again."""
    return fl.unzip(packed(spark, d)).select("key", "name", F.length("content").cast("long").alias("size"))


def uploaded(spark: SparkSession, d: str) -> DataFrame:
    """Uploads of a job for each document: a plan, notes, an archive, and one that is none; of every third job the notes alone."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("job"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), (F.col("doc_id") % 3 != 0).alias("all"))
    one = lambda name: F.struct(F.lit(name).alias("name"), F.col("text").alias("content"))
    plain = t.select("job", F.explode(F.when(F.col("all"), F.array(one("in/the plan..PDF"), one("notes.txt"), one("broken.zip"))).otherwise(F.array(one("notes.txt")))).alias("f")).select("job", "f.*")
    zips = packed(spark, d).where("key % 3 <> 0").select(F.col("key").cast("string").alias("job"), F.lit("all.ZIP").alias("name"), "content")
    return plain.unionByName(zips).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))


KEPT = "kept AS (SELECT doc_id::VARCHAR AS job, unnest([{'name': 'the plan_PDF', 'source': 'pdf'}, {'name': 'x.pdf', 'source': 'zip'}, {'name': 'x_1.pdf', 'source': 'zip'}, {'name': 'y.PDF', 'source': 'zip'}], recursive := true), strlen(coalesce(text, '')) AS size FROM documents WHERE doc_id % 3 <> 0)"


@query(f"WITH {KEPT} SELECT job, name, source, size FROM kept")
def r15_uploaded_files(spark: SparkSession, d: str) -> DataFrame:
    return dc.ingest(uploaded(spark, d))[0].select("job", "name", "source", "size")


@query(f"WITH {KEPT} SELECT job, count(*) AS n_files, 'CREATED' AS status FROM kept GROUP BY job")
def r15_created_events(spark: SparkSession, d: str) -> DataFrame:
    """A job with nothing but notes has no event."""
    return dc.ingest(uploaded(spark, d))[1].select("job", "n_files", "status")


@query(f"""WITH {SEG}, p AS (SELECT part_id, count(*) AS n_segments, {Q6('sum(z_end - z_start) + 1e-10')} AS length, max(od_diameter) > 2.4 AS corrupt FROM segments GROUP BY part_id)
    SELECT CASE WHEN NOT corrupt THEN part_id END AS part_id, CASE WHEN NOT corrupt THEN n_segments END AS n_segments, CASE WHEN NOT corrupt THEN length END AS length, corrupt, count(*) AS n FROM p GROUP BY ALL""")
def io01_io02_r12_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Stacks written as files of JSON and read back with a schema; of parts with a large outside the file holds but half, which is marked."""
    one = F.struct("part_id", F.lit("in").alias("units"), F.col("s").alias("segments"))
    s = segments(spark, d).groupBy("part_id").agg(F.collect_list(F.struct("z_start", "z_end", "od_diameter", "id_diameter")).alias("s"), F.max("od_diameter").alias("od")).withColumn("doc", F.to_json(one))
    folder = dc.scratch(spark, "stacks")
    dc.save_text(s.withColumn("doc", F.when(F.col("od") > 2.4, F.substring("doc", F.lit(1), F.floor(F.length("doc") / 2).cast("int"))).otherwise(F.col("doc"))), folder)
    j = dc.load(spark, folder, "part_id long, units string, segments array<struct<z_start: double, z_end: double, od_diameter: double, id_diameter: double>>")
    total = F.aggregate("segments", F.lit(0.0), lambda acc, x: acc + (x["z_end"] - x["z_start"]))
    good = lambda x: F.when(F.col("bad").isNull(), x)
    rows = j.select(good(F.col("part_id")).alias("part_id"), good(F.size("segments").cast("long")).alias("n_segments"), good(r6(total + 1e-10)).alias("length"), F.col("bad").isNotNull().alias("corrupt"))
    return rows.groupBy("part_id", "n_segments", "length", "corrupt").agg(F.count("*").alias("n"))


#: Events as the stage rows that a run appends: below 40 a stage begins, above 90 one fails.
STAGE_ROWS = "sr AS (SELECT user_id AS job_id, event_type AS name, event_id AS n, ts, CASE WHEN value < 40 THEN 'running' WHEN value > 90 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN value > 90 THEN event_type || ' failed' END AS error FROM events)"
INTERVALS = f"""{STAGE_ROWS}, sp AS (SELECT *, lead(status) OVER w AS ns, lead(ts) OVER w AS nt, lead(error) OVER w AS ne, coalesce(lag(status) OVER w, '') AS before FROM sr WINDOW w AS (PARTITION BY job_id, name ORDER BY n)),
    si AS (SELECT job_id, name, n, ts AS started_at, CASE WHEN status <> 'running' THEN ts WHEN ns <> 'running' THEN nt END AS finished_at, CASE WHEN status = 'running' AND ns <> 'running' THEN ns ELSE status END AS status, CASE WHEN status <> 'running' THEN error WHEN ns <> 'running' THEN ne END AS error FROM sp WHERE status = 'running' OR before <> 'running')"""


def stage_rows(spark: SparkSession, d: str) -> DataFrame:
    e, v = table(spark, d, "events"), F.col("value")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("name"), F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"), F.when(v < 40, "running").when(v > 90, "failed").otherwise("completed").alias("status"), F.when(v > 90, F.concat("event_type", F.lit(" failed"))).alias("error"))


@query(f"WITH {INTERVALS} SELECT job_id, name, n, epoch_us(started_at) AS started_us, epoch_us(finished_at) AS finished_us, status, error, (epoch_us(finished_at) - epoch_us(started_at)) / 1000 AS duration_ms FROM si")
def r13_stage_intervals(spark: SparkSession, d: str) -> DataFrame:
    p = jb.paired_stages(stage_rows(spark, d))
    return p.select("job_id", "name", "n", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"), "status", "error", "duration_ms")


@query(f"""WITH {INTERVALS}, c AS (SELECT job_id, count(*) AS stage_count, count(DISTINCT name) AS distinct_stages FROM sr GROUP BY job_id),
    p AS (SELECT job_id, min(epoch_us(started_at)) AS s, max(epoch_us(finished_at)) AS f, count(*) FILTER (finished_at IS NULL) AS o, count(*) FILTER (status = 'failed') AS x, count(*) AS n_intervals, count(error) AS n_errors FROM si GROUP BY job_id)
    SELECT job_id, CASE WHEN o > 0 THEN 'running' WHEN x > 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o = 0 THEN (f - s) / 1000 END AS duration_ms, stage_count, distinct_stages, n_intervals, n_errors FROM p JOIN c USING (job_id)""")
def r13_run_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as JSON files and loaded again."""
    folder = dc.scratch(spark, "run-reports")
    dc.save(jb.run_reports(stage_rows(spark, d)), folder)
    r = dc.load(spark, folder, "job_id long, status string, duration_ms double, stage_count long, distinct_stages long, stages array<struct<name: string>>, errors array<string>")
    return r.select("job_id", "status", "duration_ms", "stage_count", "distinct_stages", F.size("stages").cast("long").alias("n_intervals"), F.size("errors").cast("long").alias("n_errors"))


@query(f"WITH {segments_sql(gaps=True, bad=True)}, ok AS (SELECT * FROM segments WHERE z_start < z_end AND od_diameter > 0 AND id_diameter >= 0 AND id_diameter <= od_diameter), g AS (SELECT part_id, count(*) AS n FROM ok GROUP BY part_id) SELECT o_orderkey AS part_id, coalesce(n, 0) AS n_segments, n IS NOT NULL AS saved FROM orders LEFT JOIN g ON part_id = o_orderkey")
def io03_io04_stack_input(spark: SparkSession, d: str) -> DataFrame:
    """Rows that pass are saved; a part without any loads as an empty stack that isn't saved."""
    from swarf.operators.validate import row_rule

    ok = row_rule(segments(spark, d, gaps=True, bad=True)).where("code is null").groupBy("part_id").agg(F.collect_list("seq").alias("segments"))
    out = parts(spark, d).select("part_id").join(ok, "part_id", "left")
    return out.select("part_id", F.size(F.coalesce("segments", F.array().cast("array<bigint>"))).cast("long").alias("n_segments"), F.col("segments").isNotNull().alias("saved"))


@query(f"WITH {SEG} SELECT part_id, {Q6('max(od_diameter) / 2 * 1.1')} AS plot_radius, max(z_end) AS next_start, max(z_end) + 1 AS next_end FROM segments GROUP BY part_id")
def r28_r30_next_and_plot(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("part_id").agg(r6(F.max("od_diameter") / 2 * 1.1).alias("plot_radius"), F.max("z_end").alias("next_start"), (F.max("z_end") + 1).alias("next_end"))


@query(f"WITH {SEG}, w AS (SELECT part_id, sum(l) OVER (PARTITION BY part_id ORDER BY od_diameter RANGE UNBOUNDED PRECEDING) AS run, sum(l) OVER (PARTITION BY part_id) AS total, sum(l) FILTER (od_diameter = mx) OVER (PARTITION BY part_id) AS support, od_diameter, mx FROM (SELECT *, round((z_end - z_start) * 1000) AS l, max(od_diameter) OVER (PARTITION BY part_id) AS mx FROM segments)), m AS (SELECT part_id, any_value(mx) AS mx, any_value(support) AS support, any_value(total) AS total, min(od_diameter) FILTER (run >= 0.5 * total) AS med FROM w GROUP BY part_id) SELECT part_id, mx > med + 0.2 AND support / total < 0.05 AS spike FROM m")
def a13_od_spike(spark: SparkSession, d: str) -> DataFrame:
    part = Window.partitionBy("part_id")
    s = segments(spark, d).withColumn("l", F.round((F.col("z_end") - F.col("z_start")) * 1000)).withColumn("mx", F.max("od_diameter").over(part))
    s = s.withColumn("run", F.sum("l").over(part.orderBy("od_diameter").rangeBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("l").over(part))
    m = s.groupBy("part_id", "mx", "total").agg(F.sum(F.when(F.col("od_diameter") == F.col("mx"), F.col("l"))).alias("support"), F.min(F.when(F.col("run") >= 0.5 * F.col("total"), F.col("od_diameter"))).alias("med"))
    return m.select("part_id", ((F.col("mx") > F.col("med") + 0.2) & (F.col("support") / F.col("total") < 0.05)).alias("spike"))
