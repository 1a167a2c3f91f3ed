"""Extents along axes, points of normalised views, groups by their seed: small cases and models."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from swarf.operators import features as fe
from swarf.operators import views as vw

AXIS = "part_id long, id long, from_hole boolean, ox double, oy double, oz double, dx double, dy double, dz double"
BOX = "part_id long, id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


def test_extents_by_boxes_and_end_faces(spark):
    rng, up, slant = random.Random(3), (0.0, 0.0, 1.0), (0.6, 0.0, -0.8)
    cylinders = [(1, 0, True, 0, 0, 1, *up), (1, 1, False, 0, 0, 1, *up), (1, 2, False, 0, 0, 1, *up), (1, 3, None, 0, 0, 0, *up), (2, 0, True, 1, 2, 3, *slant), (2, 1, False, 0, 0, 0, *slant)]
    boxes = [(p, i, *itertools.chain.from_iterable(sorted((rng.uniform(-5, 5), rng.uniform(-5, 5))) for _ in "xyz")) for p, i in [(1, 0), (1, 0), (1, 1), (1, 2), (2, 0), (2, 0), (2, 1), (7, 7)]]
    ends = [(1, 0, -9.0), (1, 1, 2.5), (1, 1, -1.0), (2, 0, 40.0)]
    df = spark.createDataFrame([(*c[:3], *map(float, c[3:])) for c in cylinders], AXIS)
    got = {(r["part_id"], r["id"]): (r["t_min"], r["t_max"]) for r in fe.axial_extent(df, spark.createDataFrame(boxes, BOX), spark.createDataFrame(ends, "part_id long, axis long, t double")).collect()}
    assert set(got) == {c[:2] for c in cylinders}
    for p, i, hole, *v in cylinders:
        mine = [t for a, b, t in ends if (a, b) == (p, i) and not hole]
        if not mine:
            mine = [sum((x - o) * n for x, o, n in zip(corner, v[:3], v[3:], strict=True)) for b in boxes if b[:2] == (p, i) for corner in itertools.product(b[2:4], b[4:6], b[6:8])] or [0.0]
        assert got[p, i] == pytest.approx((min(mine), max(mine)))
    none = spark.createDataFrame([], BOX), spark.createDataFrame([], "part_id long, axis long, t double")
    assert {(r["t_min"], r["t_max"]) for r in fe.axial_extent(df, *none).collect()} == {(0.0, 0.0)}


def test_points_on_the_axis_end_up_in_the_middle(spark):
    axes = spark.createDataFrame([(1, 50, 40, 350, 40, 0.0, 400, 300), (2, 100, 20, 100, 280, 90.0, 400, 300), (3, 0, 0, 200, 200, 45.0, 401, 301)], "view_id long, x1 int, y1 int, x2 int, y2 int, angle double, w int, h int")
    points = [(1, 60, 40, "a"), (1, 200, 40, "b"), (1, 200, 60, "off"), (2, 100, 7, "c"), (2, 110, 7, "off"), (3, 10, 10, "d"), (3, 150, 150, "e"), (4, 5, 6, "stays"), (None, 1, 2, "stays")]
    df = spark.createDataFrame([(*p, "w") for p in points], "view_id long, x int, y int, tag string, w string")
    out = vw.normalised_points(df, vw.normalised_axis(axes))
    assert out.columns == ["view_id", "x", "y", "tag", "inside"]
    rows = {(r["view_id"], r["tag"]): r for r in out.collect()}
    assert len(rows) == len(points)
    for (view, tag), r in rows.items():
        if tag == "stays":
            assert (r["x"], r["y"]) in {(5.0, 6.0), (1.0, 2.0)} and r["inside"] is None
        elif view == 3:  # the rule lays an axis at 45 degrees flat; the points keep their distances on it
            assert r["y"] == pytest.approx(rows[3, "d"]["y"]) and abs(rows[3, "d"]["x"] - rows[3, "e"]["x"]) == pytest.approx(140 * 2**0.5)
        else:
            assert (r["x"] == pytest.approx(200.0)) == (tag != "off") and r["inside"] is True
    assert abs(rows[1, "a"]["y"] - rows[1, "b"]["y"]) == pytest.approx(140)  # distances along the axis stay


def test_groups_follow_a_model(spark):
    rng = random.Random(11)
    rows = [(p, i, float(rng.choice([0, 0.5, 1.0])), rng.choice([1.0, 1.2, 1.45, 1.7, 2.0])) for p in range(30) for i in rng.sample(range(100), rng.randint(1, 25))]
    df = spark.createDataFrame(rows, "part_id long, id long, x double, radius double").withColumn("more", F.array("x"))
    got = {(r["part_id"], r["id"]): r["seed"] for r in fe.grouped(df, fe.same_radius(0.3)).collect()}
    for part in range(30):
        seeds: list = []
        for _, i, _, radius in sorted(r for r in rows if r[0] == part):
            mine = next((s for s, r in seeds if abs(radius - r) <= 0.3), None)
            if mine is None:
                seeds.append((i, radius))
                mine = i
            assert got[part, i] == mine
    assert fe.grouped(df.where("false"), fe.same_radius()).count() == 0
    blank = fe.greedy_groups(spark.createDataFrame([(1, 1, None), (1, 2, 1.0), (1, 3, None)], "part_id long, id long, radius double"), fe.same_radius())
    assert {(r["id"], r["seed"]) for r in blank.collect()} == {(1, 1), (2, 2), (3, 3)}
