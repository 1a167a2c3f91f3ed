"""Detected drawing views: filters, ranking, axis and symmetry scores, anchors and scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.functions.geometry import clamp
from swarf.params import DEFAULT, Params


def candidates(boxes: DataFrame, share: float = 0.01, aspect: tuple[float, float] = (0.1, 10.0), most: int = 10) -> DataFrame:
    """From page, view_index, w, h, page_w, page_h: the boxes large and square enough, at most ten a page by area."""
    b = boxes.withColumn("area", F.col("w") * F.col("h")).where(F.col("area") >= F.col("page_w") * F.col("page_h") * share)
    b = b.withColumn("aspect", F.when(F.col("h") > 0, F.col("w") / F.when(F.col("h") > 0, F.col("h"))).otherwise(0.0)).where(F.col("aspect").between(*aspect))
    by = Window.partitionBy("page").orderBy(F.col("area").desc(), "view_index")
    return b.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= most)


def view_confidence(axis: Column, symmetry: Column, profile: Column, dia: Column, section: Column) -> Column:
    return axis * 0.35 + symmetry * 0.35 + profile * 0.20 + dia * 0.05 + section * 0.05


def profile_score(angle: Column, n_horizontal: Column, fill: Column, n_vertical: Column, aspect: Column) -> Column:
    """How much a view looks like a turned part, from counts of lines, the fill of the outline and the aspect."""
    upright = (F.abs(angle) > 75) & (F.abs(angle) < 105)
    score = 0.3 + F.when(upright, F.least(F.lit(0.3), n_horizontal * 0.08)).otherwise(0.0) + F.when(fill > 0.2, 0.2).otherwise(0.0) + F.least(F.lit(0.2), n_vertical * 0.05) + F.when((aspect > 1) & (aspect < 6), 0.2).otherwise(0.0)
    return clamp(score)


def ranked_views(scores: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each view with its place in its job by confidence, and whether it is the one selected."""
    by = Window.partitionBy("job_id").orderBy(F.col("view_conf").desc(), "page", "view_index")
    return scores.withColumn("place", F.row_number().over(by).cast("long")).withColumn("selected", (F.col("place") == 1) & (F.col("view_conf") >= p.view_conf))


def best_axis(lines: DataFrame) -> DataFrame:
    """From view_id, i, x1, y1, x2, y2, w, h: the best line of each view, with a boost for lines that agree with it."""
    c = F.col
    big = F.greatest("w", "h")
    l = lines.withColumn("length", F.sqrt((c("x2") - c("x1")) * (c("x2") - c("x1")) + (c("y2") - c("y1")) * (c("y2") - c("y1")))).withColumn("angle", F.atan2(c("y2") - c("y1"), c("x2") - c("x1")) * 180 / F.pi())  # noqa: E741
    steep = F.when(F.abs("angle") > 90, 180 - F.abs("angle")).otherwise(F.abs("angle"))
    mx, my = (c("x1") + c("x2")) / 2 - F.floor(c("w") / 2), (c("y1") + c("y2")) / 2 - F.floor(c("h") / 2)
    l = l.withColumn("score", c("length") / big * 0.4 + (1 - F.least(steep, 90 - steep) / 45) * 0.4 + F.greatest(F.lit(0.0), 1 - F.sqrt(mx * mx + my * my) / (big * 0.3)) * 0.2)  # noqa: E741
    view = Window.partitionBy("view_id")
    top = F.first(F.struct("i", "length", "angle", "score")).over(view.orderBy(F.floor(c("score") * 1e9 + 0.5).desc(), "i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    l = l.where("length > 0").withColumn("top", top)  # noqa: E741
    like = (F.abs(c("angle") - c("top.angle")) < 5) & (F.abs(c("length") - c("top.length")) / c("top.length") < 0.3)
    return l.groupBy("view_id", "top").agg(F.count_if(like).alias("n")).select("view_id", c("top.i").alias("line"), c("top.angle").alias("angle"), c("top.length").alias("length"), clamp(c("top.score") + F.least(F.lit(0.2), c("n") * 0.05)).alias("axis_conf"))


def symmetry(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """From view_id, x, y, v, edge and sizes (view_id, w): likeness of the left half and the mirrored right one.

    The mirror image is an equi-join on (view_id, y, w - 1 - x).
    """
    p = pixels.join(sizes, "view_id")
    left = p.where("2 * x < w - 1").select("view_id", "y", (F.col("w") - 1 - F.col("x")).alias("x"), F.col("v").alias("a"), F.col("edge").alias("ea"))
    j = left.join(p.select("view_id", "x", "y", F.col("v").alias("b"), F.col("edge").alias("eb")), ["view_id", "x", "y"])
    t = j.groupBy("view_id").agg(F.corr("a", "b").alias("corr"), F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"), F.count_if(F.col("ea") & F.col("eb")).alias("both"), F.count_if(F.col("ea") | F.col("eb")).alias("any"), F.count("*").alias("n"))
    score = 0.5 * (F.coalesce(F.when(~F.isnan("corr"), F.col("corr")), F.lit(0.0)) + 1) / 2 + 0.3 * (1 - F.col("mse") / (255.0 * 255.0)) + 0.2 * F.when(F.col("any") > 0, F.col("both") / F.when(F.col("any") > 0, F.col("any"))).otherwise(0.0)
    return t.select("view_id", "n", clamp(score).alias("symmetry"))


def anchors(dims: DataFrame, measured: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The best anchor of each view: a dimension in a preferred range against overall length or largest diameter.

    dims: view_id, i, value, unit, confidence; measured: view_id, length_px, od_px, both at most one row a view. The ranges
    and the two measurements are unrolled by explode, so only the equi-join on view_id remains.
    """
    ways = F.array(F.struct(F.lit(0).alias("k"), F.lit("overall_length").alias("name"), F.col("length_px").alias("px")), F.struct(F.lit(1).alias("k"), F.lit("max_od_diameter").alias("name"), F.col("od_px").alias("px")))
    inside = F.lit(False)
    for low, high in p.anchor_ranges:
        inside = inside | F.col("value").between(low, high)
    c = dims.where((F.col("unit") == "in") & inside).join(measured, "view_id").withColumn("way", F.explode(ways)).withColumn("scale", F.try_divide("value", "way.px")).where("way.px > 0 and scale > 0.0001D and scale < 0.1D")
    by = Window.partitionBy("view_id").orderBy(F.col("confidence").desc(), "i", "way.k")
    return c.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("view_id", F.col("way.name").alias("name"), "value", F.col("way.px").alias("pixel_length"), F.col("scale").alias("inch_per_pixel"), "confidence")


def scales(views: DataFrame, best: DataFrame) -> DataFrame:
    """Inches a pixel of each view (view_id, h): by its anchor, else as if 70 % of the height were 1.25 inches."""
    estimate = F.when(F.col("h") > 0, 1.25 / F.when(F.col("h") > 0, F.col("h") * 0.7)).otherwise(0.01)
    return views.join(best.select("view_id", "name", "inch_per_pixel"), "view_id", "left").select("view_id", F.when(F.col("name").isNotNull(), "anchor_dimension").otherwise("estimated").alias("method"), F.coalesce("inch_per_pixel", estimate).alias("inch_per_pixel"))


def normalised_axis(lines: DataFrame) -> DataFrame:
    """From view_id, x1, y1, x2, y2, angle, w, h of the axis: the rotation that makes it vertical, and the shift that centres it, with w, h.

    normalised_points maps points by the same two steps: turned about the middle of the view, then moved along x. The rule for
    the rotation makes level and upright axes upright; a slanting one it turns by what it lacks to 90 degrees, whichever way it leans.
    """
    c = F.col
    turn = F.when(F.abs("angle") < 90, 90 - c("angle")).otherwise(-(90 + c("angle")))
    at = lambda x, y: _turned(x, y, c("turn"))[0]
    out = lines.withColumn("turn", turn)
    return out.select("view_id", c("turn").alias("rotation_angle"), (c("w") / 2 - (at(c("x1"), c("y1")) + at(c("x2"), c("y2"))) / 2).alias("translation_x"), "w", "h")


def _turned(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """A point turned about the middle pixel of its view (w, h)."""
    cx, cy, rad = F.floor(F.col("w") / 2), F.floor(F.col("h") / 2), F.radians(degrees)
    return F.cos(rad) * (x - cx) + F.sin(rad) * (y - cy) + cx, F.cos(rad) * (y - cy) - F.sin(rad) * (x - cx) + cy


def normalised_points(points: DataFrame, axes: DataFrame) -> DataFrame:
    """Points (view_id, x, y) with x, y where the view's normalised axis (one row a view, of normalised_axis) puts them, and inside.

    inside: whether the point still lies on the view's pixels. The points of a view without an axis stay where they are, with a
    null there. One join by view; all else that a row holds is carried along, but columns w, h, rotation_angle, translation_x and inside.
    """
    c, own = F.col, ("w", "h", "rotation_angle", "translation_x", "inside")
    j = points.drop(*own).join(axes.select("view_id", *own[:4]), "view_id", "left")
    x, y = _turned(c("x"), c("y"), c("rotation_angle"))
    j = j.withColumns({"x": F.coalesce(x + c("translation_x"), c("x").cast("double")), "y": F.coalesce(y, c("y").cast("double"))})
    on = lambda v, size: (v >= -1e-6) & (v <= size - 1 + 1e-6)
    return j.withColumn("inside", on(c("x"), c("w")) & on(c("y"), c("h"))).drop(*own[:4])


def contour_roles(contours: DataFrame) -> DataFrame:
    """From view_id, i, area, cx, w: which contours belong to the outside and which to a bore."""
    view = Window.partitionBy("view_id")
    ratio = F.try_divide("area", F.max("area").over(view))
    c = contours.withColumn("ratio", ratio).withColumn("axis", F.floor(F.col("w") / 2))
    inner = (F.col("ratio") < 0.01) & (F.col("area") > 0) & ((F.col("cx") < F.col("axis")) | (F.abs(F.col("cx") - F.col("axis")) < F.col("w") * 0.1))
    return c.select("view_id", "i", F.coalesce(F.col("ratio") > 0.05, F.lit(False)).alias("is_od"), F.coalesce(inner, F.lit(False)).alias("is_id"))


def select_view(asked: DataFrame, results: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a request: job_id, page, view_index, source (given or best), ranked, box, box_pixels, area, image_size, error.

    asked: job_id, page, view_index (a number as text), null where not given. results: job_id, ranked_views (array of page,
    view_index), best_view (the same, null below the threshold). pages: job_id, page, views (array of box, box_pixels, area), image_size.

    If both page and view are given they count, ranked or not; otherwise the best view does. What stands in the way is said in
    this order: NO_BEST_VIEW, MISSING_SELECTION (a best view without page or index), MISSING_PAGE, NO_VIEWS, INDEX_NOT_INTEGER,
    INDEX_OUT_OF_RANGE, MISSING_BOX. With an error there is no box. Two joins by job, and by job and page; look-up by place
    in the array.
    """
    c = F.col
    a = asked.select("job_id", c("page").cast("long").alias("asked_page"), c("view_index").cast("string").alias("asked_index"))
    j = a.join(results.select("job_id", "ranked_views", "best_view"), "job_id", "left")
    given = c("asked_page").isNotNull() & c("asked_index").isNotNull()
    j = j.withColumn("source", F.when(given, "given").when(c("best_view").isNotNull(), "best"))
    j = j.withColumn("page", F.when(given, c("asked_page")).otherwise(c("best_view.page").cast("long"))).withColumn("index", F.when(given, c("asked_index")).otherwise(c("best_view.view_index").cast("string")))
    whole = F.trim("index")
    j = j.withColumn("k", F.when(whole.rlike(r"^[+-]?\d{1,9}$"), whole.cast("int")))
    j = j.withColumn("ranked", F.coalesce(given & F.exists("ranked_views", lambda v: (v["page"] == c("page")) & (v["view_index"] == c("k"))), F.lit(False)))
    j = j.join(pages.select("job_id", c("page").cast("long").alias("page"), "views", "image_size", F.lit(True).alias("there")), ["job_id", "page"], "left")
    n = F.coalesce(F.size("views"), F.lit(0))
    j = j.withColumn("view", F.when(c("k") >= 0, F.try_element_at("views", F.when(c("k") >= 0, c("k") + 1).otherwise(1))))
    error = (
        F.when(c("source").isNull(), "NO_BEST_VIEW").when(c("page").isNull() | c("index").isNull(), "MISSING_SELECTION").when(c("there").isNull(), "MISSING_PAGE").when(n <= 0, "NO_VIEWS")
        .when(c("k").isNull(), "INDEX_NOT_INTEGER").when((c("k") < 0) | (c("k") >= n), "INDEX_OUT_OF_RANGE").when(c("view.box_pixels").isNull(), "MISSING_BOX")
    )
    j = j.withColumn("error", error)
    good = lambda x: F.when(c("error").isNull(), x)
    return j.select("job_id", "page", c("k").alias("view_index"), "source", "ranked", good(c("view.box")).alias("box"), good(c("view.box_pixels")).alias("box_pixels"), good(c("view.area")).alias("area"), good(c("image_size")).alias("image_size"), "error")
