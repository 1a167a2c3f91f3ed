"""Golden numbers of parts, and models in Python of the order-dependent folds."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swarf.functions import geometry as g
from swarf.operators import features as fe
from swarf.operators import normalize, rfq, totals, validate, weighted
from swarf.operators import profile as pr
from swarf.plans import geometry_queries

SEG = "part_id long, seq long, z_start double, z_end double, od_diameter double, id_diameter double, confidence double"
BASELINE = [(1, 1, 0.0, 3.27, 1.63, 1.13, 0.9), (1, 2, 3.27, 4.25, 0.806, 0.753, 0.9)]


def seg(spark, rows):
    return spark.createDataFrame(rows, SEG)


def test_baseline_totals(spark):
    t = totals.part_totals(seg(spark, BASELINE)).first()
    want = {"volume": 3.607784944313426, "od_area": 19.22648420811646, "id_area": 13.926805897069695, "end_start": 1.0838494654884787, "end_end": 0.06489509404704105, "od_shoulder": 1.5765014590538153, "id_shoulder": 0.5575470876123777, "planar_ring": 3.2827931062017126, "total_surface": 36.436083211387874}
    for k, v in want.items():
        assert t[k] == pytest.approx(v, rel=1e-12), k
    assert (t["z_min"], t["z_max"], t["n_segments"], t["n_bores"]) == (0.0, 4.25, 2, 2)


def test_ceil_to_step_and_percentile(spark):
    one = spark.range(1)
    for x, step, want in ((2.90, 0.05, 2.90), (2.901, 0.05, 2.95), (1.0, 0.10, 1.0), (1.0000000000001, 0.10, 1.1)):
        assert one.select(g.ceil_to_step(F.lit(x), step)).first()[0] == pytest.approx(want)
    for values, weights, want in (([1, 2, 3], [1, 1, 1], 3.0), ([1, 10], [9, 1], 1.0)):
        df = spark.createDataFrame([(1, float(v), float(w)) for v, w in zip(values, weights)], "k long, v double, w double")
        assert weighted.weighted_percentile(df, ["k"], "v", "w", 0.85, "p").first()["p"] == want


PART = "part_id long, part_no string, units string, method string, validation_passed boolean, overall double, crop_partial boolean, z0 double, z1 double, rm_od_allowance double, rm_len_allowance double"
A = "anchor_dimension"
# (segments (z0, z1, od, id, conf, low), z range, units, method, valid, overall), and what has to come out
RFQ = [
    ([(0, 1, 1, 0, 0.9, False)], (0, 1), "in", A, False, 0.9, {"status": "REJECTED", "has": "VALIDATION_FAILED"}),
    ([(0, 1, 1, 0.25, 0.9, False)], (0, 1), "in", "estimated", True, 0.9, {"status": "NEEDS_REVIEW", "has": "SCALE_ESTIMATED"}),
    ([(0, 2, 1.5, 0.5, 0.95, False)], (0, 2), "in", A, True, 0.95, {"status": "AUTO_FILLED", "not": "SCALE_ESTIMATED"}),
    ([], None, "in", A, True, 0.9, {"status": "REJECTED", "has": "INSUFFICIENT_GEOMETRY", "finish_od": None, "finish_id": 0.0}),
    ([(0, 25.4, 25.4, 0, 0.9, False)], (0, 25.4), "mm", A, True, 0.9, {"finish_len": 1.0, "finish_od": 1.0}),
    ([(0, 10, 5, 0, 0.9, True), (0, 10, 3, 0, 0.9, False), (0, 0.01, 100, 0, 0.9, False)], (0, 10), "in", A, True, 0.9, {"finish_od": 3.0}),
    ([(0, 8, 2, 0, 0.9, False)], (0, 10), "in", A, True, 0.9, {"finish_len": 10.0}),
    ([(0, 2, 2, 0, 0.9, False), (2, 5, 2, 1, 0.9, False), (5, 7, 2, 0, 0.9, False), (7, 8, 2, 1, 0.9, False), (8, 10, 2, 0, 0.9, False)], (0, 10), "in", A, True, 0.9, {"coverage": 40.0, "has": "LOW_BORE_COVERAGE"}),
    ([(0, 1, 2, 0.01, 0.9, False)], (0, 1), "in", A, True, 0.9, {"finish_id": 0.0}),
    ([(0, 0.03, 2, 0, 0.9, False), (0.03, 1, 1, 0, 0.9, False)], (0, 1), "in", A, True, 0.9, {"finish_od": 2.0, "has": "OD_SPIKE_SUSPECT", "finish_od_conf": 0.9}),
    ([(0, 1, 1, 0.99, 0.9, False)], (0, 1), "in", A, True, 0.9, {"finish_id": 0.98, "has": "ID_AUTO_CLAMPED"}),
    ([(0, 1, 1, 0, 0.9, False)], None, "ft", A, True, 0.9, {"status": "NEEDS_REVIEW", "has": "UNKNOWN_UNITS,Z_RANGE_MISSING_FALLBACK"}),
]


def test_quotations(spark):
    parts = spark.createDataFrame([(i, f"P{i}", u, m, v, o, False, *(map(float, z) if z else (None, None)), 0.1, 0.35) for i, (_, z, u, m, v, o, _) in enumerate(RFQ)], PART)
    rows = spark.createDataFrame([(i, k, float(a), float(b), float(c), float(d), float(e), f) for i, (s, *_) in enumerate(RFQ) for k, (a, b, c, d, e, f) in enumerate(s)], SEG + ", low_flag boolean")
    got = {r["part_id"]: r for r in rfq.autofill(parts, rows).collect()}
    assert len(got) == len(RFQ)
    for i, (*_, want) in enumerate(RFQ):
        r = got[i]
        for k, v in want.items():
            if k == "has":
                assert v in r["reasons"], (i, r)
            elif k == "not":
                assert v not in r["reasons"], (i, r)
            else:
                assert r[k] == (pytest.approx(v) if isinstance(v, float) else v), (i, k, r)


def test_quotations_of_nulls(spark):
    """Null units are inches, a null method is an estimate, a null part number an empty one; a null verdict passes."""
    given = [("P", "in", A, True), ("P", None, A, None), ("P", "in", None, True), (None, "in", A, True), (None, None, None, None)]
    parts = spark.createDataFrame([(i, no, u, m, v, 0.95, None, 0.0, 2.0, None, None) for i, (no, u, m, v) in enumerate(given)], PART)
    rows = spark.createDataFrame([(i, 0, 0.0, 2.0, 1.5, 0.5, 0.95, False) for i in range(len(given))], SEG + ", low_flag boolean")
    got = {r["part_id"]: (r["status"], set(r["reasons"].split(",")) - {""}) for r in rfq.autofill(parts, rows).collect()}
    assert got[0] == got[1] and got[0][0] == "AUTO_FILLED" and not got[0][1]
    assert got[2] == ("NEEDS_REVIEW", {"SCALE_ESTIMATED"})
    assert got[3] == ("AUTO_FILLED", {"INVALID_PART_NO"}) and got[4] == ("NEEDS_REVIEW", {"INVALID_PART_NO", "SCALE_ESTIMATED"})


def model(rows, two_pass=False):
    """The normaliser over dicts z0, z1, od, id, in order; the same rules, one segment after the other."""
    low, width = min(r[0] for r in rows), max(r[1] for r in rows) - min(r[0] for r in rows)
    s = [dict(z0=a, z1=b, od=o, bore=i, k=1, snapped=False) for a, b, o, i in sorted(rows, key=lambda r: r[0])]
    if width > 0:
        eps = max(0.02, 0.005 * width)
        for a, b in zip(s, s[1:]):
            if abs(b["z0"] - a["z1"]) < eps:
                a["z1"] = b["z0"] = (a["z1"] + b["z0"]) / 2
                a["snapped"] = b["snapped"] = True
        for x in s:
            x["z0"] -= low
            x["z1"] -= low

    def join(a, b):
        la, lb = a["z1"] - a["z0"], b["z1"] - b["z0"]
        w = lambda c: (a[c] * la + b[c] * lb) / (la + lb) if la + lb > 0 else a[c]
        return dict(z0=a["z0"], z1=b["z1"], od=w("od"), bore=w("bore"), k=a["k"] + b["k"], snapped=a["snapped"] or b["snapped"])

    def run(s, short, similar):
        out, i = [], 0
        while i < len(s):
            x = s[i]
            if short and i + 1 < len(s) and x["z1"] - x["z0"] < max(0.005, 0.002 * width):
                out.append(join(x, s[i + 1]))
                i += 2
                continue
            if similar and out:
                limit = max(0.02, 0.01 * (out[-1]["od"] + x["od"]) / 2)
                if abs(out[-1]["od"] - x["od"]) < limit and abs(out[-1]["bore"] - x["bore"]) < limit:
                    out[-1] = join(out[-1], x)
                    i += 1
                    continue
            out.append(x)
            i += 1
        return out

    if width <= 0:
        return s
    return run(run(s, True, False), False, True) if two_pass else run(s, True, True)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 3), st.integers(40, 60), st.integers(0, 3)), min_size=1, max_size=9), min_size=1, max_size=25), st.booleans())
def test_normaliser_follows_the_model(spark, parts, two_pass):
    rows, want = [], {}
    for i, p in enumerate(parts):
        z, mine = 0.0, []
        for k, (length, gap, od, bore) in enumerate(p):
            z += gap * 0.015
            mine.append((z, z + length * 0.002, od / 50, bore / 50))
            rows.append((i, k, *mine[-1], 0.9))
            z += length * 0.002
        want[i] = model(mine, two_pass)
    got = {}
    for r in normalize.normalise(seg(spark, rows), two_pass=two_pass).orderBy("part_id", "place").collect():
        got.setdefault(r["part_id"], []).append(r)
    for i, w in want.items():
        assert [x["k"] for x in got[i]] == [x["k"] for x in w]
        for a, b in zip(got[i], w):
            assert all(math.isclose(a[c], b[c], abs_tol=1e-9) for c in ("z0", "z1", "od", "bore"))
            assert a["snapped"] == b["snapped"]
        assert got[i][-1]["z1"] == pytest.approx(w[-1]["z1"])


@pytest.mark.parametrize("two_pass", [False, True])
def test_long_parts_are_folded_in_blocks(spark, two_pass):
    """Parts about as long as some blocks follow the model too, and say which segments each merged one comes from."""
    rng, rows, want = random.Random(5), [], {}
    for i, n in enumerate((1, normalize.BLOCK - 1, normalize.BLOCK, normalize.BLOCK + 1, 3 * normalize.BLOCK, 1000)):
        z, mine = 0.0, []
        for k in range(n):
            mine.append((z, z + rng.choice([0.001, 0.004, 1.0, 2.0, 3.0]), rng.choice([1.0, 1.015, 1.03, 1.2]), rng.choice([0.0, 0.0, 0.25])))
            rows.append((i, k + 10, *mine[-1], 0.9))
            z = mine[-1][1]
        want[i] = model(mine, two_pass)
    rows += [(50, 1, None, None, 1.0, 0.0, None), (50, 2, 0.0, None, None, 0.0, 0.9), (51, 7, 1.0, 1.0, 1.0, None, 0.9), (None, 1, 0.0, 1.0, 1.0, 0.0, 0.9)]
    got = {}
    for r in normalize.normalise(seg(spark, rows), two_pass=two_pass).orderBy("part_id", "place").collect():
        got.setdefault(r["part_id"], []).append(r)
    for i, w in want.items():
        assert [(x["k"], x["snapped"]) for x in got[i]] == [(x["k"], x["snapped"]) for x in w]
        assert all(math.isclose(a[c], b[c], abs_tol=1e-9) for a, b in zip(got[i], w) for c in ("z0", "z1", "od", "bore"))
        assert [q for x in got[i] for q in x["seqs"]] == [r[1] for r in rows if r[0] == i] and all(len(x["seqs"]) == x["k"] for x in got[i])
    assert [x["seqs"] for p in (50, 51, None) for x in got[p]] == [[1], [2], [7], [1]]


def test_parts_are_folded_once(spark):
    """No filter works out the fold of a part to see that it gives something."""
    assert "Filter" not in normalize.normalise(seg(spark, []), two_pass=True)._jdf.queryExecution().optimizedPlan().toString()


def test_greedy_groups_follow_the_seed(spark):
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate([1.0, 1.4, 1.8, 1.2, 5.0])], "part_id long, id long, radius double")
    got = {r["id"]: r["seed"] for r in fe.greedy_groups(rows, fe.same_radius(0.5)).collect()}
    assert got == {0: 0, 1: 0, 3: 0, 2: 2, 4: 4}  # 1.8 is near 1.4 but not near the seed


def test_baseline_radii(spark):
    rows = spark.createDataFrame([(1, r) for r in (0.815, 0.565, 0.403, 0.3765)], "part_id long, radius double")
    got = {r["radius"]: r["kind"] for r in fe.classify_radii(rows).collect()}
    assert got == {0.815: "EXTERNAL", 0.565: "INTERNAL", 0.403: "EXTERNAL", 0.3765: "INTERNAL"}


def loop(spark, *loops):
    rows = []
    for k, pts in enumerate(loops):
        rows += [(k, i + 1, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(pts, pts[1:]))]
    return spark.createDataFrame(rows, "part_id long, i long, sx double, sy double, ex double, ey double")


def test_topology_of_loops(spark):
    square = [(5, 0), (15, 0), (15, 5), (5, 5), (5, 0)]
    bow, open_, zero = [(0, 0), (2, 2), (2, 0), (0, 1), (0, 0)], square[:-1], [(0, 0), (1, 0), (1, 0), (1, 1), (0, 0)]
    across = [(-1, 0), (1, 0), (1, 1), (-1, 1), (-1, 0)]
    got = {r["part_id"]: r["stage"] for r in pr.topology(loop(spark, square, bow, open_, zero)).collect()}
    assert got == {0: "OK", 1: "CROSSING", 2: "OPEN", 3: "DEGENERATE"}
    assert [r["stage"] for r in pr.topology(loop(spark, square, across), strict=True).orderBy("part_id").collect()] == ["OK", "NEGATIVE_RADIUS"]
    t = pr.loop_checks(loop(spark, square)).first()
    assert (t["area"], t["perimeter"], t["counterclockwise"]) == (50.0, 30.0, True)


def test_lines_of_segments_are_a_column_before_they_are_rows(spark):
    """An expression within explode is asked for its type at every row; an inner explode of a column would make the lines twice, for a filter."""
    text = pr.from_segments(seg(spark, []))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(lines" in text and "size(" not in text
    odd = seg(spark, [(1, 1, None, None, None, None, None), (2, 1, 0.0, None, 1.0, None, 0.9), (2, 1, 0.0, 1.0, None, 0.5, 0.9), (None, None, 0.0, 1.0, 2.0, 0.0, 0.9)])
    assert {r["part_id"]: r["count"] for r in pr.from_segments(odd).groupBy("part_id").count().collect()} == {1: 4, 2: 7, None: 4}


def crossed(p, q):
    """Whether two lines meet, of which none has an end point of the other."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = p, q
    if any(math.dist(e, f) <= 1e-6 for e in ((ax, ay), (bx, by)) for f in ((cx, cy), (dx, dy))):
        return False
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    if abs(det) < 1e-6:
        return False
    t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
    return 0 <= t <= 1 and 0 <= u <= 1


def test_crossings_of_long_loops(spark):
    """Loops about as long as those whose lines are sorted before they are paired, wild ones and rising ones, with null lines and repeated places."""
    rng, loops = random.Random(11), {}
    for k, n in enumerate((3, pr.FEW - 1, pr.FEW, pr.FEW + 1, 150, 300)):
        for kind in range(3):
            at = [(float(rng.randrange(9)), float(rng.randrange(9))) if kind == 0 else (rng.random() * 3, i + rng.random() * 3) if kind == 1 else (float(i % 3), float(i // 3)) for i in range(n)]
            loops[3 * k + kind] = [(*a, *b) for a, b in zip(at, at[1:] + at[:1])]
    rows = [(k, i + 1, *line) for k, lines in loops.items() for i, line in enumerate(lines)]
    rows += [(90, i + 1, None, None, 1.0, None) for i in range(100)] + [(91, 5, float(i % 7), float(i), float((i + 3) % 7), float(i + 1)) for i in range(100)] + [(None, 1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "part_id long, i long, sx double, sy double, ex double, ey double")
    got = {}
    for r in pr.crossings(df, tolerance=1e-6, touches=True).collect():
        got.setdefault(r["part_id"], set()).add((r["i"], r["j"]))
        x, y = loops[r["part_id"]][r["i"] - 1][:2]
        assert math.dist((r["x"], r["y"]), (x, y)) <= math.dist((x, y), loops[r["part_id"]][r["i"] - 1][2:]) + 1e-9
    want = {k: {(i + 1, j + 1) for i in range(len(p)) for j in range(i + 2, len(p)) if (i, j) != (0, len(p) - 1) and crossed(p[i], p[j])} for k, p in loops.items()}
    assert got == {k: w for k, w in want.items() if w}
    counts = {r["part_id"]: (r["n"], r["n_crossings"]) for r in pr.topology(df, strict=True).collect()}
    assert counts == {**{k: (len(p), len(want[k])) for k, p in loops.items()}, 90: (100, 0), 91: (100, 0), None: (1, 0)}


def test_lines_of_a_long_loop_are_paired_where_they_overlap(spark):
    """A long profile has few pairs more than lines, and not the half of its square."""
    n = 500
    lines = loop(spark, [(1, z / 10) for z in range(n + 1)])
    few = pr._by_height(pr._whole(lines), 1e-6).select(F.zip_with("reach", "rank", lambda a, b: a - b - 1).alias("x")).first()["x"]
    assert len(few) == n and max(few) <= 2
    assert pr._boxed_pairs(pr._whole(lines), 1e-6).where("b is not null").count() == 0
    assert pr._by_height(pr._whole(lines.where("i <= 64")), 1e-6).first()["order"] is None


def arc_loop(spark, *loops):
    """Loops of lines (sx, sy, ex, ey) and arcs (cx, cy, radius, a0, a1, clockwise)."""
    rows = []
    for k, prims in enumerate(loops):
        rows += [(k, i + 1, *map(float, p), *[None] * 6) if len(p) == 4 else (k, i + 1, *[None] * 4, *map(float, p[:5]), p[5]) for i, p in enumerate(prims)]
    return spark.createDataFrame(rows, "part_id long, i long, sx double, sy double, ex double, ey double, cx double, cy double, radius double, a0 double, a1 double, clockwise boolean")


def test_touches_are_forgiven_but_not_by_the_strict_check(spark):
    touch = [(0, 0), (4, 0), (4, 3), (2, 0), (0, 3), (0, 0)]
    tiny = [(0, 0), (1e-4, 0), (0, 1e-4), (0, 0)]
    df = loop(spark, touch, tiny)
    assert [r["stage"] for r in pr.topology(df).orderBy("part_id").collect()] == ["OK", "NO_AREA"]
    assert [r["stage"] for r in pr.topology(df, strict=True).orderBy("part_id").collect()] == ["CROSSING", "NO_AREA"]
    assert pr.crossings(df).count() == 0 and {(r["i"], r["j"]) for r in pr.crossings(df, touches=True).collect()} == {(1, 3), (1, 4)}


def test_strict_profile_and_its_axis(spark):
    on = [(0, 0), (2, 0), (2, 3), (0, 3), (0, 0)]
    df = loop(spark, on, [(x + 1, y) for x, y in on])
    stages = lambda **k: [r["stage"] for r in pr.topology(df, strict=True, **k).orderBy("part_id").collect()]
    assert stages() == ["OK", "OK"] and stages(touching=False) == ["AXIS", "OK"]
    assert stages(axis_x=1.0) == ["AXIS", "OK"] and stages(axis_x=2.5) == ["OK", "AXIS"]


def test_loops_of_lines_and_arcs(spark):
    pi = math.pi
    round_ = [(1, 0, 3, 0), (3, 1, 1, -pi / 2, pi / 2, False), (3, 2, 1, 2), (1, 2, 1, 0)]  # a slot with one round end
    dent = [(1, 0, 3, 0), (3, 1, 1, 3 * pi / 2, pi / 2, True), (3, 2, 1, 2), (1, 2, 1, 0)]  # the same, bent inward
    through = [(1, 0, 3, 0), (3, 1, 1, 3 * pi / 2, pi / 2, True), (3, 2, 2.5, 2), (2.5, 2, 2.5, 0.5), (2.5, 0.5, 1, 0.5), (1, 0.5, 1, 0)]
    flat, still = [*round_[:1], (3, 1, 0, -pi / 2, pi / 2, False), *round_[2:]], [*round_[:1], (3, 1, 1, 1, 1, False), *round_[2:]]
    rings = [(0, 0, 2, 0), (2, 1, 1, -pi / 2, pi / 2, False), (2, 2, 0, 2), (0, 1, 1.4, pi / 2, 3 * pi / 2, False)]
    df = arc_loop(spark, round_, dent, through, flat, still, rings)
    got = {r["part_id"]: r for r in pr.loop_checks(df).collect()}
    assert got[0]["perimeter"] == got[1]["perimeter"] == pytest.approx(6 + pi) and got[0]["closed"] and got[0]["area"] == pytest.approx(4)
    assert [got[k]["n_degenerate"] for k in range(5)] == [0, 0, 0, 1, 1]
    assert {r["part_id"]: r["stage"] for r in pr.topology(df).collect()} == {0: "OK", 1: "OK", 2: "CROSSING", 3: "DEGENERATE", 4: "DEGENERATE", 5: "OPEN"}
    hits = {(r["part_id"], r["i"], r["j"]): (r["x"], r["y"]) for r in pr.crossings(df).collect() if r["part_id"] < 3 or r["part_id"] == 5}
    assert set(hits) == {(2, 2, 4), (2, 2, 5), (5, 2, 4)} and hits[5, 2, 4] == (None, None)
    assert hits[2, 2, 4] == pytest.approx((2.5, 1 + math.sqrt(0.75))) and hits[2, 2, 5] == pytest.approx((3 - math.sqrt(0.75), 0.5))


def test_votes_of_samples(spark):
    df = spark.createDataFrame([(1, True), (1, True), (1, False), (2, True), (2, False), (2, None), (3, None), (4, False), (4, None), (5, True), (5, None), (5, None)], "face long, internal boolean")
    got = {r["face"]: (r["n_internal"], r["n_external"], r["is_internal"]) for r in fe.majority_vote(df, "face").collect()}
    assert got == {1: (2, 1, True), 2: (1, 1, False), 3: (0, 0, False), 4: (0, 1, False), 5: (1, 0, True)}


def test_designed_decision(spark):
    kind = "part_id long, dimension double, completeness double, consistency double, valid boolean, axis double"
    rows = [(1, 0.9, 1.0, 1.0, True, 0.9), (1, 0.9, 1.0, 1.0, False, 0.9), (2, 1.0, 1.0, 1.0, True, 1.0), (3, 1.0, 1.0, 1.0, False, 1.0), (4, None, None, 0.5, True, None)]
    got = {r["part_id"]: (r["overall"], r["action"]) for r in normalize.decide(spark.createDataFrame(rows, kind)).collect()}
    assert got[1] == (pytest.approx(0.6 * 0.96 + 0.18 + 0.1), "manual_review") and got[2] == (pytest.approx(1.0), "auto_use")
    assert got[3] == (pytest.approx(0.8), "fallback_to_manual") and got[4] == (pytest.approx(0.6 * 0.15 + 0.2), "fallback_to_manual")


def test_overall_weighs_what_is_left_after_penalties(spark):
    m = spark.createDataFrame([(1, 0.0, 3.0, 0.5), (1, 3.0, 4.0, 0.9), (2, 1.0, 1.0, 0.4), (2, 1.0, 1.0, 0.6)], "part_id long, z0 double, z1 double, confidence double")
    assert {r["part_id"]: (r["overall"], r["total_length"]) for r in normalize.overall(m).collect()} == {1: (pytest.approx(0.6), 4.0), 2: (pytest.approx(0.5), 0.0)}


def test_baseline_profile(spark):
    got = [(r["sx"], r["sy"]) for r in pr.from_segments(seg(spark, BASELINE)).orderBy("i").collect()]
    want = [(0.565, 0), (0.815, 0), (0.815, 3.27), (0.403, 3.27), (0.403, 4.25), (0.3765, 4.25), (0.3765, 3.27), (0.565, 3.27)]
    assert len(got) == 8 and all(a == pytest.approx(b) for a, b in zip(got, want))


def test_arcs_against_lines(spark):
    arc = [(1, 1, 0.0, 0.0, 1.0, 0.0, math.pi, False), (1, 2, 0.0, 0.0, 1.0, 0.0, math.pi, True)]
    arcs = spark.createDataFrame(arc, "part_id long, i long, cx double, cy double, radius double, a0 double, a1 double, clockwise boolean")
    lines = spark.createDataFrame([(1, 1, -2.0, 0.5, 2.0, 0.5), (1, 2, 0.0, -2.0, 0.0, 2.0), (1, 3, 2.0, 2.0, 3.0, 3.0)], "part_id long, i long, sx double, sy double, ex double, ey double")
    got = {(r["arc"], r["line"]): r["n"] for r in pr.arc_line_hits(arcs, lines).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 2): 1}


def test_validators_on_nulls_and_nothing(spark):
    assert validate.stack_validity(seg(spark, [])).count() == 0
    r = validate.row_rule(seg(spark, [(1, 1, None, 1.0, 1.0, 0.0, 0.9), (1, 2, 2.0, 1.0, 1.0, 0.0, 0.9)])).orderBy("seq").collect()
    assert [x["code"] for x in r] == [None, "Z_ORDER"]


def test_queries_have_distinct_parts(spark):
    assert geometry_queries.features(spark, "/root/testdata/sf0.001").count() > 0


INF = float("inf")
HOLE = "part_id long, seed long, id long, radius double, depth double, n_faces long, bottom_face long, bottom_type string"
# members (id, radius, depth, faces, bottom face, its type), and type, depth, bottom, completeness, confidence
HOLES = [
    ([(1, 2.0, INF, 1, None, "NONE")], ("THROUGH", INF, "NONE", "COMPLETE", "HIGH")),
    ([(1, 2.0, 3.0, 1, None, "NONE")], ("THROUGH", INF, "NONE", "COMPLETE", "MEDIUM")),
    ([(1, 2.0, 3.0, 1, 7, "CONICAL")], ("BLIND", 3.0, "CONICAL", "COMPLETE", "HIGH")),
    ([(1, 2.0, INF, 1, None, "NONE"), (2, 2.0, 4.0, 1, 7, "SPHERICAL"), (3, 2.0, 5.0, 1, 8, "FLAT")], ("BLIND", 5.0, "SPHERICAL", "COMPLETE", "HIGH")),
    ([(1, 2.0, 3.0, 1, 7, "FLAT"), (2, 2.1, 2.0, 1, 8, "FLAT")], ("BLIND", 3.0, "FLAT", "COMPLETE", "MEDIUM")),
    ([(1, 2.0, INF, 0, None, "NONE")], ("THROUGH", INF, "NONE", "INCOMPLETE", "HIGH")),
    ([(1, 2.0, INF, 1, 7, "UNKNOWN")], ("BLIND", INF, "UNKNOWN", "COMPLETE", "HIGH")),
]


def test_merged_holes(spark):
    rows = [(p, 1, *m) for p, (members, _) in enumerate(HOLES) for m in members]
    got = {r.part_id: r for r in fe.merge_holes(spark.createDataFrame(rows, HOLE)).collect()}
    for p, (members, want) in enumerate(HOLES):
        r = got[p]
        assert (r.hole_type, r.depth, r.bottom_type, r.completeness, r.confidence) == want, p
        assert r.sources == ",".join(str(m[0]) for m in members)
        assert r.diameter == pytest.approx(2 * sum(m[1] for m in members) / len(members))


CYLINDER = "part_id long, seed long, id long, radius double, height double, dz double, is_external boolean, end_faces array<long>"
CYLINDERS = [
    ([(1, 2.0, 10.0, 1.0, True, [4, 5])], ("PILLAR", 10.0, "VERTICAL", True, "4,5", "COMPLETE", "HIGH")),
    ([(1, 2.0, 10.0, 0.0, False, [4]), (2, 2.0, 60.0, 1.0, True, [5, 6])], ("SHAFT", 60.0, "HORIZONTAL", False, "4,5", "PARTIAL", "HIGH")),
    ([(1, 2.0, 10.0, 0.0, True, []), (2, 2.5, 20.0, 0.0, True, [])], ("BOSS", 20.0, "HORIZONTAL", True, "", "INCOMPLETE", "MEDIUM")),
    ([(1, 2.0, INF, 0.0, True, [])], ("SHAFT", INF, "HORIZONTAL", True, "", "COMPLETE", "HIGH")),
]


def test_merged_cylinders(spark):
    rows = [(p, 1, *m) for p, (members, _) in enumerate(CYLINDERS) for m in members]
    got = {r.part_id: r for r in fe.merge_cylinders(spark.createDataFrame(rows, CYLINDER)).collect()}
    for p, (_, want) in enumerate(CYLINDERS):
        r = got[p]
        assert (r.cylinder_type, r.height, r.orientation, r.is_external, r.end_faces, r.completeness, r.confidence) == want, p


def test_normaliser_joins_groups_and_counts(spark):
    axis = "part_id long, id long, ox double, oy double, oz double, dx double, dy double, dz double, radius double, depth double, n_faces long, bottom_face long, bottom_type string, height double, is_external boolean, end_faces array<long>, area double"
    row = lambda i, x, r: (1, i, x, 0.0, float(i), 0.0, 0.0, 1.0, r, INF, 1, None, "NONE", 5.0, True, [i], 1.5)
    m = spark.createDataFrame([row(1, 0.0, 2.0), row(2, 9.0, 2.0), row(3, 0.0, 2.0), row(4, 0.0, 2.5)], axis)
    out = fe.normalise(m, m, m)
    got = {(r.normal_id, r.sources, r.completeness, r.confidence) for r in out.collect()}
    both = {("normalized_{}_0", "1,3,4"), ("normalized_{}_1", "2")}
    assert {g[:2] for g in got if "planar" not in g[0]} == {(a.format(k), b) for k in ("hole", "cylinder") for a, b in both}
    assert ("normalized_hole_0", "1,3,4", "COMPLETE", "MEDIUM") in got and ("normalized_hole_1", "2", "COMPLETE", "HIGH") in got
    assert {g[1] for g in got if "planar" in g[0]} == {"1", "2", "3", "4"}
    c = fe.normaliser_counts(out).first()
    assert (c.total_features, c.merged_count) == (8, 4)


def test_bottom_types(spark):
    ends = spark.createDataFrame([(1, 1, 5, 0.0, "CONE"), (1, 1, 6, 2.0, "PLANE"), (1, 2, 7, -3.0, "SPHERE"), (1, 3, 8, 1.0, "TORUS"), (1, 5, 9, 1.0, None)], "part_id long, axis long, plane long, t double, surface string")
    got = {r.id: (r.n_end_faces, r.depth, r.bottom_type) for r in fe.hole_shape(ends, spark.createDataFrame([(1, i) for i in range(1, 6)], "part_id long, id long")).collect()}
    assert got == {1: (2, 2.0, "CONICAL"), 2: (1, 3.0, "SPHERICAL"), 3: (1, 1.0, "UNKNOWN"), 4: (0, INF, "NONE"), 5: (1, 1.0, "UNKNOWN")}


def test_gate_counts_flags_not_walls(spark):
    rows = [(1, 1, 0.0, 1.0, 2.0, 0.0, 0.9, ["thin_wall"]), (1, 2, 1.0, 2.0, 2.0, 0.0, 0.9, ["thin_wall", "x"]), (2, 1, 0.0, 1.0, 2.0, 1.99, 0.9, None), (2, 2, 1.0, 2.0, 2.0, 1.99, None, [])]
    got = {r.part_id: (r.n_thin, r.status, r.reasons) for r in validate.step_gate(spark.createDataFrame(rows, SEG + ", flags array<string>")).collect()}
    assert got[1] == (2, "needs_review", "THIN_WALLS")
    assert got[2][0] == 0 and "THIN_WALLS" not in got[2][2]
