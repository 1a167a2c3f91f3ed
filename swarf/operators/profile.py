"""Profile loops: building one from segments, and its topology checks as array and column expressions.

A loop is rows (part_id, i, sx, sy, ex, ey) in order; a row with a radius is an arc, by cx, cy, radius, a0, a1, clockwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.shipping import ship

CLOSE = 1e-6


def from_segments(seg: DataFrame) -> DataFrame:
    """Bottom edge, outside upward with steps where it changes, top edge, bore downward with its steps. Segments without a start come last."""
    by = Window.partitionBy("part_id").orderBy(F.asc_nulls_last("z_start"), "seq")
    s = seg.select(
        "part_id", F.row_number().over(by).alias("k"), "z_start", "z_end", (F.col("od_diameter") / 2).alias("ro"), (F.col("id_diameter") / 2).alias("ri"), F.lag("z_end").over(by).alias("pz"), F.lead("z_start").over(by).alias("nz"),
        (F.lag("od_diameter").over(by) / 2).alias("po"), (F.lead("id_diameter").over(by) / 2).alias("ni"),
    )
    line = lambda leg, key, sub, sx, sy, ex, ey: F.struct(F.lit(leg).alias("leg"), key.alias("key"), F.lit(sub).alias("sub"), sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey"))
    k, c = F.col("k"), F.col
    bore = F.greatest(c("ri"), F.lit(0.0))
    lines = F.array(
        F.when(c("pz").isNull(), line(0, k, 0, bore, c("z_start"), c("ro"), c("z_start"))),
        F.when(F.abs(c("ro") - c("po")) > CLOSE, line(1, k, 0, c("po"), c("pz"), c("ro"), c("z_start"))), line(1, k, 1, c("ro"), c("z_start"), c("ro"), c("z_end")),
        F.when(c("nz").isNull(), line(2, k, 0, c("ro"), c("z_end"), bore, c("z_end"))),
        F.when(F.abs(c("ri") - c("ni")) > CLOSE, line(3, -k, 0, c("ni"), c("nz"), c("ri"), c("z_end"))), line(3, -k, 1, bore, c("z_end"), bore, c("z_start")),
    )
    # a column of its own, as explode asks an expression for its type at every row, and every segment has lines
    out = s.select("part_id", F.filter(lines, lambda x: x.isNotNull()).alias("lines")).select("part_id", F.explode_outer("lines").alias("p"))
    order = Window.partitionBy("part_id").orderBy("p.leg", "p.key", "p.sub")
    return out.select("part_id", F.row_number().over(order).cast("long").alias("i"), "p.sx", "p.sy", "p.ex", "p.ey")


#: What an arc has besides its place i; a line has none of it.
ARC = {"cx": "double", "cy": "double", "radius": "double", "a0": "double", "a1": "double", "clockwise": "boolean"}
ENDS = ("sx", "sy", "ex", "ey")


def near(ax: Column, ay: Column, bx: Column, by: Column, tolerance: float = CLOSE) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) <= tolerance


def sweep_angle(a0: Column, a1: Column, clockwise: Column) -> Column:
    """Angle that an arc sweeps, never negative."""
    s, e = F.pmod(a0, F.lit(2 * math.pi)), F.pmod(a1, F.lit(2 * math.pi))
    return F.when(clockwise, F.pmod(s - e, F.lit(2 * math.pi))).otherwise(F.pmod(e - s, F.lit(2 * math.pi)))


def primitives(loop: DataFrame) -> DataFrame:
    """Lines and arcs alike: part_id, i, both end points, and the columns of ARC, null for a line.

    A row with a radius is an arc, and its end points follow from its angles, whatever the row says.
    """
    held = [F.col(c).cast(k).alias(c) if c in loop.columns else F.lit(None).cast(k).alias(c) for c, k in ARC.items()]
    rows = loop.select("part_id", F.col("i").cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in ENDS], *held)
    at = {f"{p}{x}": F.col(f"c{x}") + F.col("radius") * f(F.col(a)) for p, a in (("s", "a0"), ("e", "a1")) for x, f in (("x", F.cos), ("y", F.sin))}
    return rows.select("part_id", "i", *[F.when(F.col("radius").isNull(), F.col(c)).otherwise(at[c]).alias(c) for c in ENDS], *ARC)


def arc_length(p: Column) -> Column:
    return p["radius"] * sweep_angle(p["a0"], p["a1"], p["clockwise"])


def line_length(p: Column) -> Column:
    return F.sqrt((p["ex"] - p["sx"]) * (p["ex"] - p["sx"]) + (p["ey"] - p["sy"]) * (p["ey"] - p["sy"]))


def _whole(loop: DataFrame) -> DataFrame:
    """One row a loop: part_id, all (its primitives in order)."""
    return primitives(loop).groupBy("part_id").agg(F.sort_array(F.collect_list(F.struct("i", *ENDS, *ARC))).alias("all"))


def _in_a_row(loop: DataFrame, tolerance: float, axis_x: float = 0.0, touching: bool = True) -> DataFrame:
    """One row a loop, of tens of primitives: `all` of them in order, and the checks that need no pairs.

    n, n_degenerate (a line whose ends are one point, an arc without radius or sweep), n_open (joints, the last with the first),
    area (signed, of the polygon of starts and the last end; 0 for less than three), line_area (of the lines alone), perimeter,
    least_radius (of the ends), n_across (lines that cross the axis x = axis_x; with touching not those that end on it).
    """
    t = _whole(loop).withColumn("n", F.size("all"))
    last, after = F.element_at("all", -1), F.concat(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.slice("all", 1, 1))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    is_line = lambda p: p["radius"].isNull()
    bad = lambda p: F.when(is_line(p), near(p["sx"], p["sy"], p["ex"], p["ey"], tolerance)).otherwise((p["radius"] <= 0) | (sweep_angle(p["a0"], p["a1"], p["clockwise"]) < 1e-9))
    open_ = F.zip_with("all", after, lambda p, q: ~near(p["ex"], p["ey"], q["sx"], q["sy"], tolerance))
    turn = lambda ax, ay, bx, by: ax * by - bx * ay
    inner = F.zip_with(F.slice("all", 1, F.greatest(F.size("all") - 1, F.lit(0))), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda p, q: turn(p["sx"], p["sy"], q["sx"], q["sy"]))
    first = F.element_at("all", 1)
    area = (add(inner) + turn(last["sx"], last["sy"], last["ex"], last["ey"]) + turn(last["ex"], last["ey"], first["sx"], first["sy"])) / 2
    lines = F.filter("all", is_line)

    def across(p: Column) -> Column:
        a, b = p["sx"] - axis_x, p["ex"] - axis_x
        on = (F.abs(a) < tolerance, F.abs(b) < tolerance)
        return F.when(a * b < -tolerance, F.lit(not touching) | ~(on[0] | on[1])).otherwise(F.lit(not touching) & on[0] & on[1])

    return t.select(
        "part_id", "all", "n", F.size(F.filter("all", bad)).alias("n_degenerate"), F.size(F.filter(open_, lambda x: x)).alias("n_open"), F.when(F.col("n") >= 3, area).otherwise(0.0).alias("area"),
        (add(F.transform(lines, lambda p: turn(p["sx"], p["sy"], p["ex"], p["ey"]))) / 2).alias("line_area"), add(F.transform("all", lambda p: F.when(is_line(p), line_length(p)).otherwise(arc_length(p)))).alias("perimeter"),
        F.array_min(F.transform("all", lambda p: F.least(p["sx"], p["ex"]))).alias("least_radius"), F.size(F.filter(lines, across)).alias("n_across"),
    )


def loop_checks(loop: DataFrame, tolerance: float = CLOSE) -> DataFrame:
    """One row a loop: n, degenerate primitives, open joints (cyclic), signed area, winding, perimeter, least radius."""
    t, c = _in_a_row(loop, tolerance), F.col
    t = t.select("part_id", c("n").cast("long").alias("n"), c("n_degenerate").cast("long").alias("n_degenerate"), c("n_open").cast("long").alias("n_open"), "area", "perimeter", "least_radius")
    return t.withColumn("closed", (c("n") >= 2) & (c("n_open") == 0)).withColumn("counterclockwise", (c("n") >= 3) & (c("area") > 0))


def _ends_meet(a: str, b: str, tolerance: float) -> Column:
    shared = F.lit(False)
    for p in "se":
        for q in "se":
            shared = shared | near(*[F.col(f"{a}.{p}{x}") for x in "xy"], *[F.col(f"{b}.{q}{x}") for x in "xy"], tolerance)
    return shared


def with_line_line(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Adds t: where along the line a (0 to 1) it meets the line b; null if it doesn't, is parallel, or shares an end point.

    Here and below each step is a column of its own: what is used more than once is worked out once.
    """
    v = lambda p, x: F.col(f"{p}.e{x}") - F.col(f"{p}.s{x}")
    d = pairs.withColumns({"dx1": v("a", "x"), "dy1": v("a", "y"), "dx2": v("b", "x"), "dy2": v("b", "y"), "dx3": F.col("b.sx") - F.col("a.sx"), "dy3": F.col("b.sy") - F.col("a.sy"), "apart": ~_ends_meet("a", "b", tolerance)})
    d = d.withColumn("det", F.expr("dx1 * dy2 - dy1 * dx2")).withColumn("det", F.when(F.abs("det") >= tolerance, F.col("det")))
    d = d.withColumn("t", F.expr("(dx3 * dy2 - dy3 * dx2) / det")).withColumn("u", F.expr("(dx3 * dy1 - dy3 * dx1) / det"))
    return d.withColumn("t", F.when(F.col("apart") & F.col("t").between(0, 1) & F.col("u").between(0, 1), F.col("t"))).drop("dx1", "dy1", "dx2", "dy2", "dx3", "dy3", "apart", "det", "u")


def with_line_arc(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Adds t1 and t2: where along the line l it meets the arc c, the nearer and the farther root; null where it doesn't."""
    d = pairs.withColumns({"dx": F.expr("l.ex - l.sx"), "dy": F.expr("l.ey - l.sy"), "fx": F.expr("l.sx - c.cx"), "fy": F.expr("l.sy - c.cy"), "swept": sweep_angle(F.col("c.a0"), F.col("c.a1"), F.col("c.clockwise"))})
    d = d.withColumns({"qa": F.expr("dx * dx + dy * dy"), "qb": F.expr("2 * (dx * fx + dy * fy)"), "qc": F.expr("fx * fx + fy * fy - c.radius * c.radius")})
    d = d.withColumn("disc", F.expr("qb * qb - 4 * qa * qc"))
    d = d.withColumn("root", F.when((F.col("disc") >= 0) & (F.abs("qa") >= tolerance), F.sqrt("disc")))
    d = d.withColumns({"t1": F.expr("(-qb - root) / (2 * qa)"), "t2": F.expr("(-qb + root) / (2 * qa)")})
    d = d.withColumns({f"w{k}": sweep_angle(F.col("c.a0"), F.expr(f"atan2(fy + t{k} * dy, fx + t{k} * dx)"), F.col("c.clockwise")) for k in (1, 2)})
    held = {f"t{k}": F.when(F.col(f"t{k}").between(0, 1) & (F.col(f"w{k}") <= F.col("swept")), F.col(f"t{k}")) for k in (1, 2)}
    return d.withColumns(held).drop("dx", "dy", "fx", "fy", "swept", "qa", "qb", "qc", "disc", "root", "w1", "w2")


def arc_arc(a: Column, b: Column) -> Column:
    """Whether two arcs are taken to cross: their circles do, and the centres are clearly less apart than both radii."""
    apart = F.sqrt((a["cx"] - b["cx"]) * (a["cx"] - b["cx"]) + (a["cy"] - b["cy"]) * (a["cy"] - b["cy"]))
    return (apart > F.abs(a["radius"] - b["radius"])) & (apart < (a["radius"] + b["radius"]) * 0.9)


def _lines_met(pairs: DataFrame, tolerance: float, touches: bool) -> DataFrame:
    """Adds crosses, x and y to pairs (a, b) of primitives that aren't neighbours: whether both are lines that cross, and where.

    Without touches, one that meets the other with an end point doesn't cross it.
    """
    both = F.col("a.radius").isNull() & F.col("a.i").isNotNull() & F.col("b.radius").isNull() & F.col("b.i").isNotNull()  # b may be null
    d = with_line_line(pairs.withColumn("both", both), tolerance).withColumn("hit", F.when(F.col("both"), F.col("t")))
    d = d.withColumns({x: F.expr(f"a.s{x} + hit * (a.e{x} - a.s{x})") for x in "xy"})
    crosses = F.col("hit").isNotNull()
    if not touches:
        for p in "ab":
            for q in "se":
                crosses = crosses & ~F.coalesce(near(F.col("x"), F.col("y"), F.col(f"{p}.{q}x"), F.col(f"{p}.{q}y"), tolerance), F.lit(False))
    return d.withColumn("crosses", crosses).drop("both", "t", "hit")


def _box(p: Column, x: str, tolerance: float) -> tuple[Column, Column]:
    """From where to where a primitive may reach along x: a line between its ends, an arc within its circle."""
    s, e, c, r = (p[k] for k in (f"s{x}", f"e{x}", f"c{x}", "radius"))
    return F.coalesce(c - r, F.least(s, e)) - tolerance, F.coalesce(c + r, F.greatest(s, e)) + tolerance


#: A loop of more primitives is sorted by their boxes before its pairs are made.
FEW = 64


def _by_height(loops: DataFrame, tolerance: float) -> DataFrame:
    """Adds to a loop of more than a FEW primitives: sorted (all of them by the lower edges of their boxes) and order (their places in all);
    for each place in all: rank (its place in sorted) and reach (how many begin no higher than it ends). Null in other loops.

    From the sorted edges: what comes before an upper edge, but for upper ones, begins no higher. A box without edges reaches nothing.
    """
    edge = lambda k, none: F.transform("all", lambda p, at: F.struct(F.coalesce(_box(p, "y", tolerance)[k], F.lit(none)).alias("y"), F.lit(k).alias("upper"), at.alias("at")))
    edges = F.transform(F.sort_array(F.concat(edge(0, math.inf), edge(1, -math.inf))), lambda e, n: F.struct(e["upper"].alias("upper"), e["at"].alias("at"), n.alias("n")))
    loops = loops.withColumn("edges", F.when(F.size("all") > FEW, edges))
    lower, upper = F.filter("edges", lambda e: e["upper"] == 0), F.filter("edges", lambda e: e["upper"] == 1)
    by_place = lambda xs, f: F.transform(F.sort_array(F.transform(xs, lambda e, k: F.struct(e["at"].alias("at"), f(e, k).alias("v")))), lambda x: x["v"])
    loops = loops.withColumns({"order": F.transform(lower, lambda e: e["at"]), "rank": by_place(lower, lambda e, k: k), "reach": by_place(upper, lambda e, k: e["n"] - k)}).drop("edges")
    return loops.withColumn("sorted", F.transform("order", lambda at: F.get("all", at)))


def _boxed_pairs(loops: DataFrame, tolerance: float) -> DataFrame:
    """Rows with `all`, the ordered primitives, to pairs (a, b) of them that aren't neighbours and whose boxes overlap.

    b is null in one row of each primitive that has none after it, so every loop keeps some rows. In a long loop those after it
    are the ones whose boxes begin within its height, so that its pairs are not the square of its length.
    """
    c = F.col
    one = _by_height(loops, tolerance).withColumn("last", F.element_at("all", -1)["i"]).select("*", F.posexplode("all").alias("at", "a"))
    rank, reach = F.get("rank", c("at")), F.get("reach", c("at"))
    later = F.coalesce(F.slice("sorted", rank + 2, F.greatest(reach - rank - 1, F.lit(0))), F.slice("all", c("at") + 3, F.greatest(F.size("all") - c("at") - 2, F.lit(0))))
    box = {f"{end}_{x}": e for x in "xy" for end, e in zip(("low", "high"), _box(c("a"), x, tolerance), strict=True)}
    both = one.withColumns({"later": later, **box}).withColumn("rank", rank).drop("all", "sorted", "reach")
    both = both.select("*", F.posexplode_outer("later").alias("k", "b")).drop("later")
    both = both.withColumn("to", F.coalesce(F.get("order", c("rank") + 1 + c("k")), c("at") + 2 + c("k"))).drop("order", "rank", "k")
    meet = F.lit(True)
    for x in "yx":
        low, high = _box(c("b"), x, tolerance)
        meet = meet & (c(f"low_{x}") <= high) & (low <= c(f"high_{x}"))
    meet = meet & (F.abs(c("to") - c("at")) > 1) & ~((c("at") == 0) & (c("b.i") == c("last"))) & ~((c("to") == 0) & (c("a.i") == c("last")))
    both, turned = both.where(c("b").isNull() | meet), c("to") < c("at")
    return both.withColumns({"a": F.when(turned, c("b")).otherwise(c("a")), "b": F.when(turned, c("a")).otherwise(c("b"))}).drop("at", "to", "last", *box)


#: How many pairs of primitives are looked at together; one more primitive's may come on top.
PAIRS = 1 << 17


def _pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of pairs in a loop that aren't neighbours, the last and the first included; starts and ends are those of each place's loop."""
    place = np.arange(len(ends))
    counts = np.maximum(ends - place - 2, 0)
    total = np.cumsum(counts)
    low = 0
    while low < len(place):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
        n = counts[low:high]
        a = np.repeat(place[low:high], n)
        b = a + 2 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        keep = ~((a == starts[a]) & (b == ends[a] - 1))
        yield a[keep], b[keep]
        low = high


def _turn(x: np.ndarray) -> np.ndarray:
    r = np.fmod(x, 2 * math.pi)
    return np.where(r < 0, np.fmod(r + 2 * math.pi, 2 * math.pi), r)


def _swept(a0: np.ndarray, a1: np.ndarray, clockwise: np.ndarray) -> np.ndarray:
    s, e = _turn(a0), _turn(a1)
    return _turn(np.where(clockwise, s - e, e - s))


def _met(p: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, tolerance: float, touches: bool) -> tuple[np.ndarray, ...]:
    """Of pairs (a, b) of places those that cross, with x and y of the point (NaN for two arcs). What is NaN meets nothing.

    Lines cross where both have the point between their ends and share none. A line crosses an arc at the nearer of the roots that
    both have. Without touches, one that meets the other with an end point doesn't cross it.
    """
    # an arc may reach as far as its circle
    for x in "xy":
        low, high = (np.where(np.isnan(p["radius"] + p[f"c{x}"]), f(p[f"s{x}"], p[f"e{x}"]), p[f"c{x}"] + sign * p["radius"]) + sign * tolerance for f, sign in ((np.fmin, -1), (np.fmax, 1)))
        meet = (low[a] <= high[b]) & (low[b] <= high[a])
        a, b = a[meet], b[meet]
    line = np.isnan(p["radius"])
    near_ = lambda ax, ay, bx, by: np.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) <= tolerance
    end = lambda k, q: (p[f"{q}x"][k], p[f"{q}y"][k])
    v = lambda k, x: p[f"e{x}"][k] - p[f"s{x}"][k]
    within = lambda t: (t >= 0) & (t <= 1)
    hit = np.full(len(a), np.nan)

    both = np.flatnonzero(line[a] & line[b])
    m, n = a[both], b[both]
    dx1, dy1, dx2, dy2, dx3, dy3 = v(m, "x"), v(m, "y"), v(n, "x"), v(n, "y"), p["sx"][n] - p["sx"][m], p["sy"][n] - p["sy"][m]
    det = dx1 * dy2 - dy1 * dx2
    det[~(np.abs(det) >= tolerance)] = np.nan
    t, u = (dx3 * dy2 - dy3 * dx2) / det, (dx3 * dy1 - dy3 * dx1) / det
    shared = np.logical_or.reduce([near_(*end(m, q), *end(n, r)) for q in "se" for r in "se"])
    hit[both] = np.where(within(t) & within(u) & ~shared, t, np.nan)

    one = np.flatnonzero(line[a] != line[b])
    m = np.where(line[a[one]], a[one], b[one])
    n = np.where(line[a[one]], b[one], a[one])
    dx, dy, fx, fy, r = v(m, "x"), v(m, "y"), p["sx"][m] - p["cx"][n], p["sy"][m] - p["cy"][n], p["radius"][n]
    qa, qb, qc = dx * dx + dy * dy, 2 * (dx * fx + dy * fy), fx * fx + fy * fy - r * r
    disc = qb * qb - 4 * qa * qc
    root = np.sqrt(np.where((disc >= 0) & (np.abs(qa) >= tolerance), disc, np.nan))
    a0, a1, clockwise = p["a0"][n], p["a1"][n], p["clockwise"][n]
    swept = _swept(a0, a1, clockwise)
    roots = [(-qb + sign * root) / (2 * qa) for sign in (-1, 1)]
    held = [within(t) & (_swept(a0, np.arctan2(fy + t * dy, fx + t * dx), clockwise) <= swept) for t in roots]
    hit[one] = np.where(held[0], roots[0], np.where(held[1], roots[1], np.nan))

    l = np.where(line[a], a, b)
    x, y = (p[f"s{k}"][l] + hit * v(l, k) for k in "xy")
    crosses = ~np.isnan(hit)
    if not touches:
        for k in (a, b):
            for q in "se":
                crosses &= ~near_(x, y, *end(k, q))
    apart = np.sqrt((p["cx"][a] - p["cx"][b]) ** 2 + (p["cy"][a] - p["cy"][b]) ** 2)
    crosses |= ~line[a] & ~line[b] & (apart > np.abs(p["radius"][a] - p["radius"][b])) & (apart < (p["radius"][a] + p["radius"][b]) * 0.9)
    return a[crosses], b[crosses], x[crosses], y[crosses]


def _crossed(loops: DataFrame, tolerance: float, touches: bool) -> DataFrame:
    """Rows with `all`, the ordered primitives, and instead `hits`: array of (i, j, x, y), the pairs that cross, as `crossings` gives them.

    For loops with arcs: the steps of both kinds together make a generated method too long for the JVM to compile (8,000
    bytes), while lines alone are faster there. Arrow batches of loops; a loop's pairs are made, and dropped again where their boxes lie apart, some 100,000 at a time.
    """
    fields = ("i", *ENDS, *ARC)
    sent = loops.withColumn("all", F.struct(*[F.col("all")[c].alias(c) for c in fields]))
    kept = [f for f in loops.schema.fields if f.name != "all"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", hits array<struct<i:bigint,j:bigint,x:double,y:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("all")
            flat = {c: lists.field(k).flatten() for k, c in enumerate(fields)}
            n = pc.list_value_length(lists.field(0)).to_numpy(zero_copy_only=False)
            last = np.cumsum(n)
            p = {c: x.cast(pa.float64()).to_numpy(zero_copy_only=False) for c, x in flat.items() if c not in ("i", "clockwise")}
            p["clockwise"] = pc.fill_null(flat["clockwise"], False).to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                found = [_met(p, a, b, tolerance, touches) for a, b in _pairs(np.repeat(last - n, n), np.repeat(last, n))]
            a, b, x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int if k < 2 else float) for k in range(4))
            i = flat["i"].to_numpy(zero_copy_only=False)
            offsets = np.searchsorted(a, np.concatenate([[0], last])).astype(np.int32)
            hits = pa.StructArray.from_arrays([pa.array(i[a], pa.int64()), pa.array(i[b], pa.int64()), pa.array(x, pa.float64(), mask=np.isnan(x)), pa.array(y, pa.float64(), mask=np.isnan(y))], ["i", "j", "x", "y"])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.ListArray.from_arrays(pa.array(offsets), hits)], [*[f.name for f in kept], "hits"])

    ship(loops.sparkSession)
    return sent.mapInArrow(run, schema)


def crossings(loop: DataFrame, tolerance: float = 1e-9, touches: bool = False) -> DataFrame:
    """(part_id, i, j, x, y): primitives of a loop that cross, with the point, which is null for two arcs.

    Neighbours and shared end points don't count; touches: an end point on another primitive does. A loop has tens of
    primitives, so its pairs are made within its row: one scan and one shuffle, no self-join.
    """
    if "radius" in loop.columns:
        d = _crossed(_whole(loop), tolerance, touches)
        return d.select("part_id", F.explode("hits").alias("hit")).select("part_id", "hit.*")
    d = _lines_met(_boxed_pairs(_whole(loop), tolerance), tolerance, touches)
    hit = F.when(F.col("crosses"), F.array(F.struct(F.col("a.i").alias("i"), F.col("b.i").alias("j"), "x", "y")))  # exploded: a filter would be pushed below all steps
    return d.select("part_id", F.explode_outer(hit).alias("hit")).where("hit is not null").select("part_id", "hit.*")


def topology(loop: DataFrame, strict: bool = False, axis_x: float = 0.0, touching: bool = True, tolerance: float = CLOSE) -> DataFrame:
    """One row a loop with the first stage it fails: DEGENERATE, OPEN, NO_AREA, CROSSING, or OK.

    strict: NEGATIVE_RADIUS, AXIS (a line crosses x = axis_x; without touching, it lies on it), OPEN, CROSSING (of lines, an
    end point on another line included), NO_AREA (of the lines), or OK. One scan and one shuffle: the pairs of a loop
    are counted where they are made.
    """
    t, c = _in_a_row(loop, tolerance, axis_x, touching), F.col
    if not strict and "radius" in loop.columns:
        t = _crossed(t, tolerance, strict).withColumn("n_crossings", F.size("hits").cast("long"))
    else:
        numbers = [x for x in t.columns if x not in ("part_id", "all")]
        t = _lines_met(_boxed_pairs(t, tolerance), tolerance, strict).groupBy("part_id").agg(*[F.max(x).alias(x) for x in numbers], F.count_if("crosses").alias("n_crossings"))
    closed = (c("n") >= (1 if strict else 2)) & (c("n_open") == 0)
    if strict:
        stage = F.when(F.col("least_radius") < -tolerance, "NEGATIVE_RADIUS").when(F.col("n_across") > 0, "AXIS").when(~closed, "OPEN").when(F.col("n_crossings") > 0, "CROSSING").when(F.abs("line_area") < tolerance, "NO_AREA").otherwise("OK")
    else:
        stage = F.when(F.col("n_degenerate") > 0, "DEGENERATE").when(~closed, "OPEN").when((F.col("n") < 3) | (F.abs("area") < tolerance), "NO_AREA").when(F.col("n_crossings") > 0, "CROSSING").otherwise("OK")
    return t.select("part_id", c("n").cast("long").alias("n"), "n_crossings", stage.alias("stage"))


def arc_line_hits(arcs: DataFrame, lines: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(part_id, arc, line, n): how often each line of a part meets each of its arcs, at most twice."""
    both = arcs.select("part_id", F.struct("i", *ARC).alias("c")).join(lines.select("part_id", F.struct("i", *ENDS).alias("l")), "part_id")
    n = F.when(F.col("t1").isNotNull(), 1).otherwise(0) + F.when(F.col("t2").isNotNull(), 1).otherwise(0)
    hit = with_line_arc(both, tolerance).select("part_id", F.explode_outer(F.when(n > 0, F.array(F.struct(F.col("c.i").alias("arc"), F.col("l.i").alias("line"), n.cast("long").alias("n"))))).alias("hit"))
    return hit.where("hit is not null").select("part_id", "hit.*")


def arc_arc_hits(arcs: DataFrame) -> DataFrame:
    """(part_id, i, j): arcs of a part, not next to each other, that are taken to cross."""
    whole = arcs.groupBy("part_id").agg(F.sort_array(F.collect_list(F.struct("i", *ARC))).alias("all"))
    pairs = whole.select("part_id", "all", F.explode("all").alias("a")).select("part_id", "a", F.explode("all").alias("b"))
    return pairs.where((F.col("b.i") > F.col("a.i") + 1) & arc_arc(F.col("a"), F.col("b"))).select("part_id", "a.i", F.col("b.i").alias("j"))


def _before(w: Column, s: Column) -> Column:
    """The segment s with its weight w, of which the greatest counts. Where weights tie it is the first in order, so all else is turned round."""
    back = lambda x: F.nanvl(-x, F.lit(-math.inf))
    seq = F.coalesce(F.bitwise_not(s["seq"]), F.lit(2**63 - 1))
    return F.struct(w.alias("w"), back(s["a"]).alias("a"), back(s["b"]).alias("b"), seq.alias("seq"), (-s["ro"]).alias("ro"), (-s["ri"]).alias("ri"))


def _places(seg: DataFrame, by_ends: bool) -> DataFrame:
    """Two rows a segment s, one for each place z where it starts or ends: last (of the rows of this place) and found, ro and ri there or up to the next place, in that last row and null over a gap.

    Of the segments that have begun the one with the greatest end is a running maximum, which counts if it goes on that far. By ends those
    that begin or end there go before it: all of this place, and those of other places less than 1e-9 away.
    """
    num = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    s, z, c = F.col("s"), F.col("z"), F.col
    t = seg.select("part_id", F.struct(num("z_start").alias("a"), num("z_end").alias("b"), c("seq").cast("bigint").alias("seq"), (num("od_diameter") / 2).alias("ro"), (num("id_diameter") / 2).alias("ri")).alias("s"))
    by = Window.partitionBy("part_id").orderBy("z")
    # rows are sorted for this, before what is worked out of them makes them wide
    t = t.select("part_id", "s", F.explode(F.array("s.a", "s.b")).alias("z")).withColumn("next", F.lead("z").over(by))
    near = lambda f: F.expr(f"{f} OVER (PARTITION BY part_id ORDER BY z RANGE BETWEEN 2e-9 PRECEDING AND 2e-9 FOLLOWING)")
    farthest = F.max(F.when(s["a"] == z, _before(s["b"], s))).over(by).alias("farthest")
    last = (c("next").isNull() | (c("next") > z)).alias("last")
    if by_ends:
        counts = lambda s: 1000 + s["b"] > -1
        here = F.max(F.when((s["a"] <= s["b"]) & counts(s), _before(1000 + s["b"], s))).over(by.rangeBetween(0, 0)).alias("here")
        t = t.select("part_id", "s", "z", "next", farthest, here, (near("max(z)") > near("min(z)")).alias("crowded"))
        t = t.select("part_id", "s", "z", "farthest", last, "here", near("collect_list(CASE WHEN crowded THEN s END)").alias("around"))
        held = F.filter("around", lambda s: ((F.abs(z - s["a"]) < 1e-9) | (F.abs(z - s["b"]) < 1e-9)) & (s["a"] <= z) & (s["b"] >= z) & counts(s))
        best = F.greatest("here", F.array_max(F.transform(held, lambda s: _before(1000 + s["b"], s))), F.when((c("farthest.w") >= z) & (c("farthest.w") > -1), c("farthest")))
    else:
        t = t.select("part_id", "s", "z", "next", farthest).withColumns({"last": last, "middle": (z + c("next")) / 2})
        t = t.withColumn("farthest", F.when(c("middle") >= c("next"), F.lead("farthest").over(by)).otherwise(c("farthest")))  # no number between them
        best = F.when(c("farthest.w") >= c("middle"), c("farthest"))
    t = t.select("part_id", "s", "z", "last", F.when(c("last"), best).alias("best"))
    return t.select("part_id", "s", "z", "last", F.when(c("best").isNotNull(), F.struct((-c("best.ro")).alias("ro"), (-c("best.ri")).alias("ri"))).alias("found"))


def from_overlapping(seg: DataFrame, by_ends: bool = False) -> DataFrame:
    """Lines of the profile of segments that may overlap and leave gaps: part_id, i, sx, sy, ex, ey.

    All starts and ends of a part cut it into intervals. Of the segments that cover an interval's middle the one with the
    greatest end gives both radii, the first in order of start and end where these tie; over a gap the radii before it are
    carried on. by_ends is the rule as it was surveyed: the segment is looked for at the intervals' ends, where one that
    begins or ends there goes before one that runs through, and an interval has its outside from its upper end and its bore
    from the lower one; so an earlier segment loses its last interval to the one that follows, which is why it isn't the default.

    Segments and places are rows in order, and the radii of a part one row of arrays: one shuffle. Rows with a null place or radius count as if they had 0 there;
    parts of one place have no profile.
    """
    # the last one found so far; a part begins with a segment, but one that ends before it starts covers nothing
    so_far = F.last("found", ignorenulls=True).over(Window.partitionBy("part_id").orderBy("z"))
    of = lambda s: F.struct(s["ro"].alias("ro"), s["ri"].alias("ri"))
    t = _places(seg, by_ends).select("part_id", "s", F.when(F.col("last"), F.struct("z", so_far.alias("r"))).alias("place"))
    t = t.groupBy("part_id").agg(F.sort_array(F.collect_list("place")).alias("places"), (F.count("place") - 1).cast("int").alias("m"), F.min("s").alias("first"), F.max("s").alias("last")).where("m > 0")
    t = t.withColumns({"first": of(F.col("first")), "last": of(F.col("last"))})
    t = t.withColumns({"zs": F.transform("places", lambda x: x["z"]), "r": F.transform("places", lambda x: F.coalesce(x["r"], F.col("first")))})
    if by_ends:  # interval k, from 1, has the outside of place k and the bore of place k - 1, of the first and last segment at both ends
        t = t.withColumn("r", F.concat(F.array("first"), F.slice("r", F.lit(2), F.col("m") - 1), F.array("last")))
        t = t.withColumns({"ro": F.transform(F.slice("r", F.lit(2), F.col("m")), lambda x: x["ro"]), "ri": F.transform(F.slice("r", F.lit(1), F.col("m")), lambda x: x["ri"])})
    else:
        t = t.withColumn("r", F.slice("r", F.lit(1), F.col("m")))
        t = t.withColumns({"ro": F.transform("r", lambda x: x["ro"]), "ri": F.transform("r", lambda x: x["ri"]), "first": F.col("r")[0], "last": F.element_at("r", -1)})
    t = t.withColumn("back", F.reverse("ri"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    bore = lambda x: F.when(x > CLOSE, x).otherwise(0.0)
    z = lambda k: F.element_at("zs", k)
    step = lambda now, before, low, high: F.when(F.abs(now[0] - before) > CLOSE, F.array(point(now[1], low), point(now[1], high))).otherwise(F.array(point(now[1], high)))
    up = F.flatten(F.transform("ro", lambda r, k: step((r, r), F.when(k == 0, F.col("first.ro")).otherwise(F.get("ro", k - 1)), z(k + 1), z(k + 2))))
    down = F.flatten(F.transform("back", lambda r, k: step((r, bore(r)), F.when(k == 0, bore(F.col("last.ri"))).otherwise(F.get("back", k - 1)), z(F.col("m") + 1 - k), z(F.col("m") - k))))
    start = point(bore(F.col("first.ri")), z(F.lit(1)))
    t = t.withColumn("p", F.concat(F.array(start, point(F.col("first.ro"), z(F.lit(1)))), up, F.array(point(bore(F.col("last.ri")), z(F.lit(-1)))), down))
    end = F.element_at("p", -1)
    t = t.withColumn("p", F.when(near(end["x"], end["y"], start["x"], start["y"]), F.col("p")).otherwise(F.concat("p", F.array(start))))
    lines = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.struct(a["x"].alias("sx"), a["y"].alias("sy"), b["x"].alias("ex"), b["y"].alias("ey")))
    # there is a line in every part; for an inner explode the optimizer would filter by the size of lines first, and make them again for that
    return t.select("part_id", F.posexplode_outer(lines).alias("i", "l")).select("part_id", (F.col("i") + 1).cast("long").alias("i"), "l.*")


def revolved_faces(loop: DataFrame) -> DataFrame:
    """The faces of a counterclockwise loop of lines turned about the axis x = 0, in the columns that features.from_faces() takes.

    A line along the axis gives a cylinder, an inner one if it runs down; one across it a plane, which looks down if it runs
    outward; any other a cone. A line on the axis gives nothing, and neither does one without length.
    """
    c = F.col
    along, across = F.abs(c("sx") - c("ex")) <= CLOSE, F.abs(c("sy") - c("ey")) <= CLOSE
    surface = F.when(along, "CYLINDER").when(across, "PLANE").otherwise("CONE")
    plane = surface == "PLANE"
    rows = loop.where(~(along & (F.greatest("sx", "ex") <= CLOSE)) & ~(along & across))
    ring = F.abs(c("ex") * c("ex") - c("sx") * c("sx")) * math.pi
    return rows.select(
        "part_id", c("i").alias("face"), surface.alias("surface"), F.when(surface == "CYLINDER", c("ey") < c("sy")).alias("internal"), F.when(surface == "CYLINDER", c("sx")).alias("radius"), *[F.lit(0.0).alias(x) for x in ("ox", "oy")], F.when(plane, c("sy")).otherwise(0.0).alias("oz"),
        *[F.lit(0.0).alias(x) for x in ("dx", "dy")], F.when(plane & (c("ex") > c("sx")), -1.0).otherwise(1.0).alias("dz"), F.least("sy", "ey").alias("t_min"), F.greatest("sy", "ey").alias("t_max"), F.when(plane, ring).alias("area"),
    )
