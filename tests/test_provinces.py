"""Hulls against gift wrapping, touched cells against dense points on edges, grouped k-means against a loop."""

import math

import numpy as np
import pytest

from pyrocell.grid import GridSpec
from pyrocell.operators import provinces as R
from pyrocell.operators import spatial as D


def wrapped(points):
    """Corners by gift wrapping."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out, at = [], points[0]
    while True:
        out.append(at)
        best = next(p for p in points if p != at)
        for p in points:
            c = cross(at, best, p)
            if p != at and (c < 0 or (c == 0 and math.dist(at, p) > math.dist(at, best))):
                best = p
        at = best
        if at == points[0]:
            return out


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_hull_of_points(n):
    rng = np.random.default_rng(n)
    for span in (2, 6, 1000):
        pts = [tuple(map(float, p)) for p in rng.integers(0, span, (n, 2))]
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        assert [(x[i], y[i]) for i in R.hull_of(x, y)] == wrapped(pts)
    line = [(float(i), 2.0 * i) for i in range(9)]
    assert [line[i] for i in R.hull_of(*map(np.array, zip(*line)))] == [line[0], line[-1]]


def test_hulls_of_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(z, float(a), float(b)) for z in ("a", None, "c") for a, b in rng.integers(0, 40, (200, 2))] + [("dot", 1.0, 2.0)] * 3 + [("a", None, 1.0), ("none", 1.0, None)]
    got = {}
    for r in R.convex_hulls(spark.createDataFrame(rows, "zone string, x double, y double").repartition(5), ["zone"]).orderBy("seq").collect():
        got.setdefault(r.zone, []).append((r.x, r.y))
    assert got == {z: wrapped([(x, y) for y_, x, y in rows if y_ == z and x is not None and y is not None]) for z in ("a", None, "c", "dot")}


def test_touched_cells(spark):
    rng = np.random.default_rng(2)
    grid = GridSpec(10.0, 50.0, 2.0, 3.0, 12, 9)
    rings = {k: [(float(x), float(y)) for x, y in rng.uniform((6, 20), (38, 54), (n, 2))] for k, n in enumerate((3, 4, 3, 2, 1))}
    rows = [(k, s, x, y) for k, ring in rings.items() for s, (x, y) in enumerate(ring)]
    table = spark.createDataFrame(rows, "poly_id int, seq int, x double, y double")
    got = {(r.poly_id, r.pixelID) for r in D.cells_touched(table, grid, ["poly_id"]).collect()}
    inside = {(r.poly_id, r.pixelID) for r in D.cells_inside(table, grid, ["poly_id"]).collect()}
    passed = set()
    for k, ring in rings.items():
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            for t in np.linspace(0, 1, 20001):
                c, r = math.floor((x1 + t * (x2 - x1) - 10) / 2), math.floor((50 - y1 - t * (y2 - y1)) / 3)
                if 0 <= c < 12 and 0 <= r < 9:
                    passed.add((k, r * 12 + c + 1))
    assert passed | inside <= got and len(got - passed - inside) <= 1  # a corner cut shorter than the step
    whole = D.rasterize(table.withColumn("v", table.poly_id * 10), grid, "v", "max", background=-1, touches=True)
    assert {r.pixelID: r.v for r in whole.collect()} == {c: max((k * 10 for k, p in got if p == c), default=-1) for c in range(1, 109)}


def test_provinces_of_several_patches_are_merged(spark):
    grid = GridSpec(0, 0, 1, 1, 20, 20)
    two = {r * 20 + c + 1 for r, c in [(2, 2), (2, 3), (9, 2), (9, 9)]}
    one = {r * 20 + c + 1 for r, c in [(15, 1), (16, 2), (16, 3), (15, 4)]}
    rows = [(1, c) for c in two] + [(None, c) for c in one] + [(1, min(two))]
    got = {}
    for r in R.merged_provinces(spark.createDataFrame(rows, "zone int, pixelID long"), grid).collect():
        got.setdefault(r.zone, []).append(r.pixelID)
    assert sorted(got[None]) == sorted(one) and len(got[1]) == len(set(got[1]))
    hull = [(2, 2), (2, 3), (9, 9), (9, 2)]
    side = lambda a, b, p: (b[1] - a[1]) * (p[0] - a[0]) - (b[0] - a[0]) * (p[1] - a[1])
    inner = {r * 20 + c + 1 for r in range(20) for c in range(20) if all(side(hull[i], hull[(i + 1) % 4], (r, c)) >= 0 for i in range(4))}
    near = {r * 20 + c + 1 for r in range(2, 10) for c in range(2, 10) if any(abs(r - (x - 1) // 20) <= 1 and abs(c - (x - 1) % 20) <= 1 for x in inner)}
    assert inner <= set(got[1]) <= near


def loop_parts(cells, k, wide, rounds=20):
    """k-means of one zone from strips."""
    t = sorted(x if wide else y for x, y in cells)
    of = lambda v: sum(u < v for u in t) * k // len(t)
    label = {p: of(p[0] if wide else p[1]) for p in cells}
    mean = lambda ps: (round(sum(x for x, _ in ps) / len(ps), 6), round(sum(y for _, y in ps) / len(ps), 6))
    centres = {c: mean([p for p in cells if label[p] == c]) for c in sorted(set(label.values()))}
    near = lambda p: min(centres, key=lambda c: ((p[0] - centres[c][0]) ** 2 + (p[1] - centres[c][1]) ** 2, c))
    for _ in range(rounds):
        label = {p: near(p) for p in cells}
        new = {c: mean(ps) if (ps := [p for p in cells if label[p] == c]) else centres[c] for c in centres}
        if new == centres:
            break
        centres = new
    label = {p: near(p) for p in cells}
    order = sorted(set(label.values()), key=lambda c: (min(x for (x, _), m in label.items() if m == c), min(y for (_, y), m in label.items() if m == c), c))
    return {p: order.index(c) + 1 for p, c in label.items()}


def test_zones_are_cut_as_a_loop_cuts_them(spark):
    rng = np.random.default_rng(5)
    zones = {1: (60, 20), 2: (12, 70), None: (40, 40), 4: (5, 5)}
    cells = {z: sorted({(float(x), float(y)) for x, y in zip(rng.integers(0, w, 150), rng.integers(0, h, 150))})[: 20 if z == 4 else 150] for z, (w, h) in zones.items()}
    rows = [(z, i, x, y) for z, ps in cells.items() for i, (x, y) in enumerate(ps)]
    got = {(r.zone, r.x, r.y): r.part for r in R.split_large_zones(spark.createDataFrame(rows, "zone int, pixelID long, x double, y double"), 50).collect()}
    want = {}
    for z, ps in cells.items():
        k = math.ceil(len(ps) / 50) if len(ps) > 50 else 1
        wide = np.var([x for x, _ in ps]) >= np.var([y for _, y in ps])
        want |= {(z, *p): n for p, n in (loop_parts(ps, k, wide) if k > 1 else dict.fromkeys(ps, 1)).items()}
    assert got == want
    assert R.split_large_zones(spark.createDataFrame([], "zone int, pixelID long, x double, y double"), 50).count() == 0
