import itertools
import random

import numpy as np
import pytest

from dhruva.operators import proximity
from dhruva.operators.proximity import Quadtree, RTree, around, haversine, in_regions, nearest, pairs_within
from dhruva.plans import records

SCHEMA = "stop_id string, latitude double, longitude double, lat string, id string"


def brute(rows, metres):
    ok = [(i, a, b) for i, a, b, *_ in rows if i is not None and a is not None and b is not None and abs(a) <= 90 and abs(b) <= 180 and (a, b) != (0, 0)]
    out = set()
    for (i, a, b), (j, c, d) in itertools.combinations(ok, 2):
        if i != j and haversine(a, b, c, d) <= metres:
            out.add((min(i, j), max(i, j)))
    return out


def found(spark, rows, metres):
    pairs = pairs_within(spark.createDataFrame(rows, SCHEMA), metres, "stop_id").collect()
    assert len({(r["id_a"], r["id_b"]) for r in pairs}) == len(pairs)
    return {(r["id_a"], r["id_b"]) for r in pairs}


def test_dirty_positions_ties_and_lifetimes(spark):
    rows = [("A", 13.0, 80.0), ("B", 13.0005, 80.0), ("C", 13.0, 80.0), ("A", 13.0, 80.0), ("A", 14.0, 80.0), ("D", 14.0001, 80.0), ("E", None, 80.0), ("F", 13.0, None), ("G", 0.0, 0.0), ("H", 0.0, -0.0), ("I", 91.0, 80.0),
            ("J", 13.0, 181.0), (None, 13.0, 80.0), ("K", float("nan"), 80.0), ("L", 80.0, 13.0)]
    rows = [(*r, "x", "y") for r in rows]
    assert found(spark, rows, 75) == {("A", "B"), ("A", "C"), ("B", "C"), ("A", "D")}
    assert found(spark, [], 75) == set()


def test_antimeridian_and_poles(spark):
    rows = [("A", 10.0, 179.9999), ("B", 10.0, -179.9999), ("C", 89.9999, 0.0), ("D", 89.9999, 180.0), ("E", 89.9999, -90.0), ("F", -89.9999, 45.0), ("G", -90.0, 0.0), ("H", 10.0, 180.0), ("I", 10.0, -180.0)]
    rows = [(*r, "x", "y") for r in rows]
    assert found(spark, rows, 75) == brute(rows, 75)
    assert ("H", "I") in found(spark, rows, 75)


@pytest.mark.parametrize("cell", [4_000, 8])
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(proximity, "CELL", cell)
    rnd = random.Random(cell)
    rows = [(f"S{i}", 13 + rnd.gauss(0, 0.01), 80 + rnd.gauss(0, 0.01), "x", "y") for i in range(600)]
    rows += [(f"T{i}", 13.0, 80.0 + rnd.random() * 1e-4, "x", "y") for i in range(200)]
    assert found(spark, rows, 75) == brute(rows, 75)


@pytest.mark.parametrize("cell", [4_000, 8])
def test_points_around_anchors_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(proximity, "CELL", cell)
    rnd = random.Random(cell)
    points = [(f"S{i}", 13 + rnd.gauss(0, 0.05), 80 + rnd.gauss(0, 0.05)) for i in range(500)] + [("S0", 13.0, 80.0), ("S0", 13.0, 80.0), (None, 13.0, 80.0), ("N", None, 80.0), ("Z", 0.0, 0.0), ("D", 10.0, -179.9999)]
    anchors = [("A", 13.0, 80.0), ("B", 13.02, 80.01), ("B", 13.02, 80.01), ("C", 10.0, 179.9999), ("E", 13.0, None), ("F", 0.0, 0.0), ("G", 50.0, 50.0)]
    want = {}
    for a, y, x in anchors:
        for i, lat, lon in points:
            if None not in (i, x, lat) and (lat, lon) != (0, 0) and (y, x) != (0, 0) and (d := haversine(y, x, lat, lon)) <= 2_000:
                want[a, i] = min(d, want.get((a, i), d))
    got = around(spark.createDataFrame(anchors, "anchor string, alat double, alon double"), spark.createDataFrame(points, "id string, lat double, lon double"), 2_000.0).collect()
    assert len(got) == len(want) and {(r["anchor"], r["id"]): pytest.approx(r["metres"], abs=1e-3) for r in got} == want
    assert ("C", "D") in want


def test_members_of_hubs_make_no_pairs_of_stops(spark, sf):
    plan = records.hub_members_expand(spark, sf)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_quadtree_touches_every_leaf_of_a_box():
    rnd = np.random.default_rng(1)
    y, x = rnd.uniform(-90, 90, 500), rnd.uniform(-180, 180, 500)
    tree = Quadtree.fit(y, x, 10, 0.01)
    r, leaf = tree.touched(y - 5, y + 5, x - 5, x + 5)
    have = set(zip(r, leaf))
    for dy, dx in itertools.product((-5, 0, 5), repeat=2):
        assert all((i, k) in have for i, k in enumerate(tree.home(np.clip(y + dy, -90, 90), np.clip(x + dx, -180, 180))))


def test_rtree_probe():
    rnd = np.random.default_rng(2)
    y, x = rnd.uniform(0, 1, 2_000), rnd.uniform(0, 1, 2_000)
    q, p = RTree(y, x).probe(np.array([0.2]), np.array([0.3]), np.array([0.5]), np.array([0.7]))
    assert set(p) == set(np.flatnonzero((y >= 0.2) & (y <= 0.3) & (x >= 0.5) & (x <= 0.7)))


@pytest.mark.parametrize("sample, cell", [(20_000, 4_000), (60, 5)])
def test_nearest_equals_brute_force(spark, monkeypatch, sample, cell):
    monkeypatch.setattr(proximity, "SAMPLE", sample)
    monkeypatch.setattr(proximity, "CELL", cell)
    rnd = random.Random(sample)
    points = [(f"P{i:04d}", 13 + rnd.gauss(0, 0.05), 80 + rnd.gauss(0, 0.05), "x") for i in range(700)] + [(f"Q{i}", 13.0, 80.0, "x") for i in range(8)]
    points += [("D1", 0.5, 179.99, "x"), ("D2", 0.5, -179.99, "x"), ("N", 89.9, 10.0, "x"), ("N2", 89.9, -170.0, "x"), ("bad", None, 80.0, "x"), ("zero", 0.0, 0.0, "x")]
    anchors = [("a", 13.0, 80.0), ("b", 12.5, 80.2), ("c", 0.5, 180.0), ("d", 90.0, 0.0), ("d", 90.0, 0.0), ("e", None, 1.0), (None, 13.1, 80.1)]
    got = nearest(spark.createDataFrame(anchors, "anchor string, alat double, alon double"), spark.createDataFrame(points, "id string, lat double, lon double, leaf string").drop("leaf"), 6)
    want = set()
    for a, y, x in set(anchors):
        if y is not None:
            near = sorted((float(haversine(y, x, p[1], p[2])), p[0]) for p in points if p[1] is not None and p[0] != "zero")
            want |= {(a, i, n) for n, (_, i) in enumerate(near[:6], 1)}
    assert {(r["anchor"], r["id"], r["rank"]) for r in got.collect()} == want
    assert nearest(spark.createDataFrame(anchors, "anchor string, alat double, alon double"), spark.createDataFrame([], "id string, lat double, lon double")).count() == 0


@pytest.mark.parametrize("cell", [4_000, 5])
def test_regions_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(proximity, "CELL", cell)
    rnd = random.Random(cell)
    points = [(f"P{i}", rnd.uniform(-10, 10), rnd.uniform(-10, 10)) for i in range(600)] + [("E", 5.0, 179.5), ("W", 5.0, -179.5), (None, 1.0, 1.0), ("X", None, 1.0), ("P0", 1.0, 1.0)]
    star = [(9, 0), (2, 2), (0, 9), (-2, 2), (-9, 0), (-2, -2), (0, -9), (2, -2)]
    rings = {"star": star, "box": [(-6, -6), (-6, 6), (6, 6), (6, -6)], "line": [(0, 0), (5, 5)], "over": [(0, 179), (0, 181), (10, 181), (10, 179)], "none": None}
    floats = lambda ring: ring and [p and (float(p[0]), float(p[1])) for p in ring]
    given = [(k, floats(r)) for k, r in (*rings.items(), ("hole", [(0, 0), None, (1, 1)]))]
    got = in_regions(spark.createDataFrame(points, "id string, lat double, lon double"), spark.createDataFrame(given, "region_id string, ring array<struct<lat:double,lon:double>>"))

    def inside(y, x, ring):
        hits = 0
        for (a, c), (b, d) in zip(ring, ring[1:] + ring[:1]):
            hits += (a > y) != (b > y) and x < (d - c) * (y - a) / (b - a) + c
        return hits % 2 == 1

    want = {(i, k) for i, y, x in points if i and y is not None for k, ring in rings.items() if ring and len(ring) > 2 and any(inside(y, x + t, ring) for t in (-360, 0, 360))}
    assert {tuple(r) for r in got.collect()} == want and {("E", "over"), ("W", "over")} <= want
