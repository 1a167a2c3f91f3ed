"""Profiles of overlapping segments, and features found from faces, against plain Python."""

import math
import random

import numpy as np
import pytest
from conftest import SF, same_rows

from swarf.operators import features as fe
from swarf.operators import profile as pr

SEG = "part_id long, seq long, z_start double, z_end double, od_diameter double, id_diameter double"
BASELINE = [(1, 1, 0.0, 3.27, 1.63, 1.13), (1, 2, 3.27, 4.25, 0.806, 0.753)]


def points(df, part=1):
    rows = df.where(f"part_id = {part}").orderBy("i").collect()
    assert all((a["ex"], a["ey"]) == (b["sx"], b["sy"]) for a, b in zip(rows, rows[1:]))
    return [(round(r["sx"], 9), round(r["sy"], 9)) for r in rows], [(round(r["ex"], 9), round(r["ey"], 9)) for r in rows][-1:]


def walked(segs, by_ends):
    """The points of the profile, by a walk over the places of a part."""
    segs = sorted((a or 0.0, b or 0.0, k, (o or 0.0) / 2, (i or 0.0) / 2) for k, a, b, o, i in segs)
    zs = sorted({z for s in segs for z in s[:2]})
    if len(zs) < 2:
        return None
    known = None

    def at(z):
        best, most = None, -1 if by_ends else -math.inf
        for s in segs:
            if s[0] <= z <= s[1]:
                w = s[1] + (1000 if by_ends and (abs(z - s[0]) < 1e-9 or abs(z - s[1]) < 1e-9) else 0)
                if w > most:
                    best, most = s[3:], w
        return best

    radii = []
    for z in zs if by_ends else [(a + b) / 2 for a, b in zip(zs, zs[1:])]:
        known = at(z) or known or segs[0][3:]
        radii.append(known)
    if by_ends:
        radii[0], radii[-1] = segs[0][3:], segs[-1][3:]
        up, down, first, last = [r[0] for r in radii[1:]], [r[1] for r in radii[:-1]], radii[0], radii[-1]
    else:
        up, down, first, last = [r[0] for r in radii], [r[1] for r in radii], radii[0], radii[-1]
    eff = lambda x: x if x > 1e-6 else 0.0
    out, prev = [(eff(first[1]), zs[0]), (first[0], zs[0])], first[0]
    for r, low, high in zip(up, zs, zs[1:]):
        out += [(r, low)] * (abs(r - prev) > 1e-6) + [(r, high)]
        prev = r
    out.append((eff(last[1]), zs[-1]))
    prev = eff(last[1])
    for r, low, high in list(zip(down, zs, zs[1:]))[::-1]:
        out += [(eff(r), high)] * (abs(r - prev) > 1e-6) + [(eff(r), low)]
        prev = r
    if math.dist(out[-1], out[0]) > 1e-6:
        out.append(out[0])
    return [(round(x, 9), round(y, 9)) for x, y in out]


@pytest.mark.parametrize("by_ends", [False, True])
def test_profiles_of_overlapping_segments(spark, by_ends):
    rng, rows = random.Random(3), []
    for p in range(60):
        for k in range(rng.randint(1, 7)):
            a = rng.randrange(12) / 2
            rows.append((p, k, a, a + rng.choice([-0.5, 0, 0.5, 1, 2, 5]), rng.randrange(1, 9) / 2, rng.choice([0, 0, 0.25, 1e-7, 3])))
    rows += [(100, 0, None, 2.0, 1.0, None), (101, 0, 1.0, 1.0, 1.0, 0.0), *((102, *r[1:]) for r in BASELINE)]
    got = pr.from_overlapping(spark.createDataFrame([(*r[:2], *[None if v is None else float(v) for v in r[2:]]) for r in rows], SEG), by_ends).cache()
    for p in {r[0] for r in rows}:
        want = walked([r[1:] for r in rows if r[0] == p], by_ends)
        if want is None:
            assert got.where(f"part_id = {p}").count() == 0
        elif p % 3 == 0 or p >= 100:
            starts, end = points(got, p)
            assert starts + end == want, p
    assert pr.from_overlapping(spark.createDataFrame([], SEG)).count() == 0


@pytest.mark.parametrize("by_ends", [False, True])
def test_profiles_of_odd_places(spark, by_ends):
    """Places less than 1e-9 apart, segments longer than the weight of an end, places below zero, repeated and null numbers, and a part of many segments."""
    rng, rows = random.Random(7), []
    starts = (lambda: 1 + rng.randrange(5) * 4e-10, lambda: rng.randrange(3), lambda: -1000 * rng.randrange(4), lambda: rng.randrange(4) * 0.1)
    for p in range(40):
        for k in range(rng.randint(2, 6)):
            a = float(starts[p % 4]())
            rows.append((p, k, a, a + rng.choice([(0, 3e-10, 9e-10, 1), (1, 999.5, 1000, 2000), (0, 1, 500, 1500), (0, 0.1, 0.2, 1e-16)][p % 4]), rng.randrange(1, 9) / 2, rng.choice([0.0, 0.25, 3.0])))
    rows += [(50, k, k // 2 + 0.0, k // 2 + rng.choice([0.5, 1.0, 3.0]), rng.randrange(1, 5) / 2, 0.0) for k in range(600)]
    rows += [(51, None, 0.0, 1.0, 2.0, 0.0), (51, None, 0.0, 1.0, 2.0, 0.5), (51, 1, 0.0, 1.0, 1.0, 0.0), (None, 1, 0.0, 1.0, 2.0, 0.5)]
    got = {}
    for r in pr.from_overlapping(spark.createDataFrame(rows, SEG), by_ends).orderBy("part_id", "i").collect():
        got.setdefault(r["part_id"], []).append(r)
    for p in {r[0] for r in rows}:
        want = walked([(-1 if r[1] is None else r[1], *r[2:]) for r in rows if r[0] == p], by_ends)
        if want is None:
            assert p not in got
        else:
            assert [(round(r["sx"], 9), round(r["sy"], 9)) for r in got[p]] + [(round(got[p][-1]["ex"], 9), round(got[p][-1]["ey"], 9))] == want, p


@pytest.mark.parametrize("by_ends", [False, True])
def test_profiles_are_made_once_and_in_proportion(spark, by_ends):
    """Nothing goes through all segments at each place or copies what came before, no filter makes the lines first, and one shuffle is enough."""
    plan = pr.from_overlapping(spark.createDataFrame([], SEG), by_ends)._jdf.queryExecution()
    assert "aggregate(" not in (text := plan.optimizedPlan().toString()) and "size(zip_with" not in text and "array_max(" not in text.replace("array_max(transform(filter(around", "")
    assert plan.executedPlan().toString().count("Exchange") == 1


def test_baseline_with_overlap_resolved_is_its_profile(spark):
    """Segments that only touch: the same loop as without the sweep. By ends, the first segment's outside goes, as surveyed."""
    df = spark.createDataFrame(BASELINE, SEG)
    want, _ = points(pr.from_segments(df))
    got, end = points(pr.from_overlapping(df))
    assert got == want and end == want[:1]
    assert pr.topology(pr.from_overlapping(df)).first()["stage"] == "OK"
    assert (0.403, 0.0) in points(pr.from_overlapping(df, by_ends=True))[0]


def test_baseline_has_two_holes_two_cylinders_four_planes(spark):
    faces = pr.revolved_faces(pr.from_segments(spark.createDataFrame(BASELINE, SEG)))
    r = fe.feature_summary(faces).first()
    assert (r["n_holes"], r["n_cylinders"], r["n_planar"], r["n_faces"]) == (2, 2, 4, 8) and (r["n_plane"], r["n_cylinder"], r["n_other"]) == (4, 4, 0)
    f = {r["id"]: r for r in fe.from_faces(faces).collect()}
    assert {k: (v["radius"], v["t_min"], v["t_max"]) for k, v in f.items()} == {"hole_0": (0.3765, 3.27, 4.25), "hole_1": (0.565, 0.0, 3.27), "cylinder_0": (0.815, 0.0, 3.27), "cylinder_1": (0.403, 3.27, 4.25)}
    assert f["hole_0"]["depth"] == f["cylinder_0"]["depth"] == 4.25 and f["hole_0"]["bottom_type"] == "FLAT"


FACE = "part_id long, face long, surface string, internal boolean, radius double, ox double, oy double, oz double, dx double, dy double, dz double, t_min double, t_max double, area double"


def found(faces, tol=1e-3):
    """The features of a part by nested loops over lists of faces."""
    beside = lambda a, b: (t := sum((y - x) * d for x, y, d in zip(a[5:8], b[5:8], a[8:11])), math.sqrt(max(0.0, sum((y - x) ** 2 for x, y in zip(a[5:8], b[5:8])) - t * t)))
    dot = lambda a, b: abs(sum(x * y for x, y in zip(a[8:11], b[8:11])))
    out = []
    for kind, internal in (("HOLE", True), ("CYLINDER", False)):
        todo, n = [f for f in sorted(faces, key=lambda f: f[1]) if f[2] == "CYLINDER" and f[8] is not None and bool(f[3]) == internal], 0
        while todo:
            mine = [f for f in todo if f is todo[0] or dot(todo[0], f) >= 1 - tol and beside(todo[0], f)[1] <= tol]
            todo, radii = [f for f in todo if f not in mine], [f for f in mine if f[4] is not None]
            while radii:
                cluster = [f for f in radii if abs(f[4] - radii[0][4]) <= tol]
                seed, radii = radii[0], [f for f in radii if f not in cluster]
                ts = [beside(seed, p)[0] for p in faces if p[2] == "PLANE" and p[8] is not None and dot(seed, p) > 1 - tol and beside(seed, p)[1] < tol]
                depth = math.inf if len(ts) < (1 if internal else 2) else abs(ts[0]) if len(ts) == 1 else max(ts) - min(ts)
                out.append((kind, f"{kind.lower()}_{n}", seed[4], len(cluster), len(ts), round(depth, 9), ("FLAT" if ts else "NONE") if internal else None, min(f[11] for f in cluster), max(f[12] for f in cluster)))
                n += 1
    return sorted(out)


def test_features_of_random_faces(spark):
    rng, rows = random.Random(21), []
    dirs = [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (0.6, 0.8, 0.0)]
    for p in range(80):
        for k in rng.sample(range(50), rng.randint(1, 16)):
            o = [rng.choice([0.0, 0.0, 0.0004, 1.0]) for _ in range(3)]
            d = rng.choice(dirs)
            rows.append((p, k, rng.choice(["CYLINDER"] * 3 + ["PLANE", "PLANE", "CONE", None]), rng.choice([True, False, None]), rng.choice([1.0, 1.0, 1.0006, 1.0012, 2.0, None]), *o, *d, float(k), k + 1.5, None))
    rows += [(99, 1, "CYLINDER", True, 1.0, *[0.0] * 3, None, None, None, 0.0, 1.0, None), (99, 2, "PLANE", None, None, *[0.0] * 3, None, None, None, 0.0, 0.0, 1.0), (99, 3, "PLANE", None, None, *[0.0] * 3, 0.0, 0.0, -1.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, FACE)
    got = {}
    for r in fe.from_faces(df).collect():
        got.setdefault(r["part_id"], []).append((r["kind"], r["id"], r["radius"], r["n_faces"], r["n_end_faces"], round(r["depth"], 9), r["bottom_type"], r["t_min"], r["t_max"]))
    for p in {r[0] for r in rows}:
        assert sorted(got.get(p, []), key=str) == sorted(found([r for r in rows if r[0] == p]), key=str), p
    assert [(r["id"], r["orientation"]) for r in fe.planar_features(df.where("part_id = 99")).collect()] == [("planar_face_1", "BOTTOM")]
    assert fe.from_faces(df.limit(0)).count() == 0 and fe.feature_summary(df.where("part_id = 99")).first()["n_holes"] == 0
    h = fe.face_histogram(df).agg({"n_faces": "sum", "n_other": "sum"}).first()
    assert h[0] + h[1] == len(rows) + sum(r[2] is None for r in rows)


def test_pairs_of_a_long_loop_stay_in_its_row(spark):
    """A comb of 600 lines that one long line crosses, among small loops; more pairs than are looked at together."""
    rows = [(1, 2 * k + 1, float(k), 0.0, float(k), 2.0) for k in range(300)] + [(1, 2 * k + 2, float(k), 2.0, k + 1.0, 0.0) for k in range(300)] + [(1, 601, 300.0, 0.0, 300.0, 1.0), (1, 602, 300.0, 1.0, -1.0, 1.0), (1, 603, -1.0, 1.0, 0.0, 0.0)]
    rows += [(p, k + 1, *[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)][k], *[(2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)][k]) for p in range(2, 9) for k in range(4)]
    df = spark.createDataFrame(rows, "part_id long, i long, sx double, sy double, ex double, ey double")
    arcs = df.selectExpr("*", *[f"cast(null as {k}) as {c}" for c, k in pr.ARC.items()])
    got = {r["part_id"]: (r["n"], r["n_crossings"], r["stage"]) for r in pr.topology(arcs).collect()}
    assert got == {1: (603, 600, "CROSSING")} | {p: (4, 0, "OK") for p in range(2, 9)}
    assert {(r["i"], r["j"], r["y"]) for r in pr.crossings(arcs).collect()} == {(k, 602, 1.0) for k in range(1, 601)}
    assert "Generate" not in pr.topology(arcs)._jdf.queryExecution().executedPlan().toString()


def test_segments_are_spread_by_their_number(spark, monkeypatch):
    from swarf.sources import tables

    want = sorted(map(tuple, tables.segments(spark, SF).collect()))
    monkeypatch.setattr(tables, "SEGMENTS", 100)
    s = tables.segments(spark, SF)
    n = -(-tables.table(spark, SF, "lineitem").count() // 100)
    assert s.rdd.getNumPartitions() == n and sorted(map(tuple, s.collect())) == want
    plan = pr.topology(pr.from_segments(s))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(part_id" in plan


def test_a_summary_reads_the_faces_once(spark):
    """No fold over faces is interpreted, and the counts of a part are those of its features."""
    from swarf.plans import face_queries as q

    faces = q.faces(spark, SF)
    summary, features = fe.feature_summary(faces), fe.from_faces(faces)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (summary, features)]
    assert [p.count("FileScan") for p in plans] == [2, 2] and all("MapInArrow" in p for p in plans)
    want = {}
    for r in features.collect():
        n = want.setdefault(r["part_id"], [0, 0])
        n[r["kind"] == "CYLINDER"] += 1
    assert {r["part_id"]: [r["n_holes"], r["n_cylinders"]] for r in summary.collect() if r["n_holes"] + r["n_cylinders"]} == want


def test_a_long_part_beside_short_ones(spark, monkeypatch):
    """500 faces of one part, nearly each a group of its own, and more pairs of clusters and planes than are looked at together."""
    rng = random.Random(5)
    face = lambda p, k, plane: (p, k, "PLANE" if plane else "CYLINDER", k % 3 == 0, rng.choice([1.0, 1.0006, 2.0]), 0.0, 0.0, rng.randrange(400) / 2, 1.0, 0.0, 0.0, float(k), k + 1.0, None)
    rows = [face(1, k, k % 5 == 0) for k in range(500)] + [face(p, k, k == 3) for p in range(2, 40) for k in range(4)]
    got = {}
    for r in fe.from_faces(spark.createDataFrame(rows, FACE)).collect():
        got.setdefault(r["part_id"], []).append((r["kind"], r["id"], r["radius"], r["n_faces"], r["n_end_faces"], round(r["depth"], 9), r["bottom_type"], r["t_min"], r["t_max"]))
    assert all(sorted(got[p], key=str) == sorted(found([r for r in rows if r[0] == p]), key=str) for p in range(1, 40))

    f = {c: np.array([float(r[k]) for r in rows]) for c, k in zip(("ox", "oy", "oz", "dx", "dy", "dz"), range(5, 11))}
    f |= {"part": np.array([r[0] for r in rows]), "plane": np.array([r[2] == "PLANE" for r in rows])}
    axes = np.flatnonzero(~f["plane"])
    want = [x.tolist() for x in fe._end_faces(f, axes, 1e-3)]
    monkeypatch.setattr(fe, "PAIRS", 150)
    assert [x.tolist() for x in fe._end_faces(f, axes, 1e-3)] == want


def test_faces_without_a_part_have_no_features(spark, duck, tmp_path):
    from swarf import plans

    spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("* except (l_orderkey)", "nullif(l_orderkey, 7) as l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("i10_features_from_faces", "a17_r02_face_summary"):
        same_rows(plans.queries()[name](spark, str(tmp_path)), con, plans.oracle_sql()[name])


def test_a_plane_without_a_place_is_no_end_face(spark):
    rows = [(1, 1, "CYLINDER", True, 1.0, *[0.0] * 5, 1.0, 0.0, 2.0, None), (1, 2, "PLANE", None, None, 0.0, 0.0, None, 0.0, 0.0, 1.0, None, None, 1.0)]
    r = fe.from_faces(spark.createDataFrame(rows, FACE)).first()
    assert (r["n_faces"], r["n_end_faces"], r["depth"], r["bottom_type"]) == (1, 0, math.inf, "NONE")


def test_odd_lines_have_the_features_of_the_sql(spark, duck, tmp_path):
    """Lines without a number, part, supplier or quantity, and quantities of hundredths and halves of them."""
    from swarf import plans

    quantity = "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_quantity / 100 + l_suppkey % 40 / 200.0::DOUBLE + 0.01 END"
    odd = {"l_linenumber": "nullif(l_linenumber, 3)", "l_partkey": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey END", "l_suppkey": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey END", "l_quantity": quantity}
    con = duck.cursor()
    con.execute(f"COPY (SELECT * REPLACE ({', '.join(f'{x} AS {c}' for c, x in odd.items())}) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE TEMP VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    for name in ("w14_profile_loop", "i10_features_from_faces", "a17_r02_face_summary", "i11_planar_features"):
        same_rows(plans.queries()[name](spark, str(tmp_path)), con, plans.oracle_sql()[name])


def test_a_cylinder_without_a_radius_is_a_feature_if_asked(spark):
    rows = [(1, k, "CYLINDER", True, r, *[0.0] * 5, 1.0, float(k), k + 1.0, None) for k, r in ((1, None), (2, 1.0), (3, None), (4, 1.0))]
    df = spark.createDataFrame(rows, FACE)
    got = {r["id"]: (r["radius"], r["n_faces"], r["t_min"], r["t_max"]) for r in fe.from_faces(df, unmeasured=True).collect()}
    assert got == {"hole_0": (None, 1, 1.0, 2.0), "hole_1": (1.0, 2, 2.0, 5.0), "hole_2": (None, 1, 3.0, 4.0)}
    assert [fe.feature_summary(df, unmeasured=u).first()["n_holes"] for u in (False, True)] == [1, 3]
