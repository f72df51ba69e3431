"""Tiles of any size against arrays over the whole grid, and growth in blocks against a loop over rings."""

import math
from collections import Counter

import numpy as np
import pytest

from pyrocell.grid import GridSpec
from pyrocell.operators import covariates as H
from pyrocell.operators import fires as N
from pyrocell.operators import spatial as D
from pyrocell.operators import tiles
from pyrocell.operators.components import least_roots


def flood(cells, ncol, directions):
    """Least cell of each patch."""
    left, out = set(cells), {}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (directions == 8 or a == 0 or b == 0)]
    while left:
        start = min(left)
        todo = [start]
        left.discard(start)
        while todo:
            c = todo.pop()
            out[c] = start
            r, q = divmod(c - 1, ncol)
            for a, b in steps:
                n = (r + a) * ncol + q + b + 1
                if 0 <= q + b < ncol and n in left:
                    left.discard(n)
                    todo.append(n)
    return out


def near(cells, grid, radius):
    out = set()
    for c in cells:
        r, q = divmod(c - 1, grid.ncol)
        for a in range(grid.nrow):
            for b in range(grid.ncol):
                if math.hypot((a - r) * grid.res_y, (b - q) * grid.res_x) <= radius + 1e-9:
                    out.add(a * grid.ncol + b + 1)
    return out


@pytest.mark.parametrize("shape", [(40, 30, 1, 1), (9, 55, 2.5, 1), (1, 30, 1, 1), (30, 1, 1, 3)])
def test_distances_are_exact_at_every_radius(shape):
    h, w, dy, dx = shape
    rng = np.random.default_rng(h)
    for share in (0.002, 0.05, 0.6, 1.0):
        mask = rng.random((h, w)) < share
        got = tiles.squares_to_nearest(mask, dy, dx)
        want = np.full((h, w), np.inf)
        for r, c in np.argwhere(mask):
            want = np.minimum(want, ((np.arange(h)[:, None] - r) * dy) ** 2.0 + ((np.arange(w)[None] - c) * dx) ** 2.0)
        assert np.allclose(got, want)
        for radius in range(21):
            inside = np.sqrt(want) <= radius + 1e-9
            assert ((np.sqrt(got) <= radius + 1e-9) == inside).all()
            assert (tiles.within(mask, radius, GridSpec(0, 0, dx, dy, w, h)) == inside).all()


def test_roots_of_a_million_edges():
    rng = np.random.default_rng(2)
    n = 400_000
    u, v = rng.integers(0, n, 1_000_000), rng.integers(0, n, 1_000_000)
    u, v = np.where(rng.random(len(u)) < 0.7, u % 3000, u), np.where(rng.random(len(v)) < 0.7, v % 3000, v)
    root = least_roots(u, v, n)
    assert (root[u] == root[v]).all() and (root <= np.arange(n)).all() and (root[root] == root).all()
    chain = np.arange(100_000)
    assert not least_roots(chain[1:], chain[:-1], len(chain)).any()


@pytest.mark.parametrize("directions", [4, 8])
def test_patches_over_tiles(spark, directions):
    rng = np.random.default_rng(directions)
    grid = GridSpec(0, 0, 1, 1, 37, 41)
    rows = [(z, int(c)) for z in (1, 2, None) for c in rng.choice(grid.ncell, 800, False) + 1]
    table = spark.createDataFrame([*rows, rows[0], (1, None)], "zone int, pixelID long")
    want = {(z, c): p for z in (1, 2, None) for c, p in flood({c for y, c in rows if y == z}, 37, directions).items()}
    for side in (16, 512):
        got = [(r.zone, r.pixelID, r.patch) for r in tiles.connected(table, grid, directions, ["zone"], side=side).collect()]
        assert len(got) == len(want) and {(z, c): p for z, c, p in got} == want
    lost = {(r.zone, r.pixelID): r.lost for r in D.drop_small_patches(table, grid, 12, ["zone"]).collect()}
    for z in (1, 2, None) if directions == 8 else ():  # small patches have eight neighbours
        size = Counter(p for (y, _), p in want.items() if y == z)
        assert {c: lost[y, c] for y, c in want if y == z} == {c: int(size[p] < 12 <= max(size.values())) for (y, c), p in want.items() if y == z}
    assert tiles.connected(table.limit(0), grid, directions, ["zone"]).count() == 0


def test_small_patches_of_a_null_zone(spark):
    grid = GridSpec(0, 0, 1, 1, 10, 10)
    rows = [(None, c) for c in (1, 2, 3, 50, 77)] + [(5, c) for c in (1, 100)]
    got = {(r.zone, r.pixelID): r.lost for r in D.drop_small_patches(spark.createDataFrame(rows, "zone int, pixelID long"), grid, 3).collect()}
    assert got == {(None, 1): 0, (None, 2): 0, (None, 3): 0, (None, 50): 1, (None, 77): 1, (5, 1): 0, (5, 100): 0}


def test_cells_reached_and_fire_ids_over_tiles(spark):
    rng = np.random.default_rng(3)
    grid = GridSpec(0, 0, 2, 1, 23, 31)
    rows = [(y, int(c)) for y in (2000, 2001) for c in rng.choice(grid.ncell, 25, False) + 1]
    table = spark.createDataFrame([*rows, rows[0]], "year int, pixelID long")
    for radius in (0.0, 2.3, 6.0):
        want = {(y, c, (y, c) in rows) for y in (2000, 2001) for c in near({c for z, c in rows if z == y}, grid, radius)}
        got = [tuple(r) for r in tiles.reached(table, radius, grid, ["year"], side=13).collect()]
        assert len(got) == len(want) and set(got) == want
        patch = {y: flood(near({c for z, c in rows if z == y}, grid, radius), 23, 4) for y in (2000, 2001)}
        ids = {(r.year, r.pixelID): r.ids for r in N.make_fire_ids(table, grid, radius).collect()}
        assert ids == {(y, c): patch[y][c] for y, c in rows}


def test_windows_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles.Tiling.__init__, "__defaults__", (0, 10))
    rng = np.random.default_rng(4)
    grid = GridSpec(0, 0, 1, 1, 17, 19)
    values = [None if rng.random() < 0.4 else int(rng.integers(1, 4)) for _ in range(grid.ncell)]
    there = [i for i in range(grid.ncell) if rng.random() < 0.8]
    table = spark.createDataFrame([(i + 1, values[i], "x") for i in there], "pixelID long, v int, other string")
    around = lambda i, k: [j for j in there if abs(j // 17 - i // 17) <= k and abs(j % 17 - i % 17) <= k]
    mean = {r.pixelID: r.v for r in D.focal_mean_fill(table, grid, "v").collect()}
    mode = {r.pixelID: (r.v, r.other) for r in D.focal_modal_fill(table, grid, "v").collect()}
    count = {r.pixelID: r.n for r in D.neighbour_count(table, table, grid, "v").collect()}
    for i in there:
        three, five = [[values[j] for j in around(i, k) if values[j] is not None] for k in (1, 2)]
        assert mean.pop(i + 1) == (values[i] if values[i] is not None else pytest.approx(np.mean(three)) if three else None)
        assert mode.pop(i + 1) == (values[i] if values[i] is not None else min(set(five), key=lambda x: (-five.count(x), x)) if five else None, "x")
        assert count.pop(i + 1) == sum(three) - 1
    assert not mean and not mode and not count
    points = spark.createDataFrame([(k, float(k % 17) + 0.2, -float(k % 19) - 0.7) for k in range(40)] + [(99, -5.0, 0.0)], "point_id long, x double, y double")
    got = {r.point_id: r.v for r in H.mean_around_points(points, table, 2.0, grid, "v").collect()}
    for k in range(40):
        of = [values[c - 1] for c in near({k % 19 * 17 + k % 17 + 1}, grid, 2.0) if c - 1 in there]
        if of:
            known = [x for x in of if x is not None]
            assert got.pop(k) == (pytest.approx(np.mean(known)) if known else None)
    assert not got


def test_holes_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles.Tiling.__init__, "__defaults__", (0, 9))
    grid = GridSpec(0, 0, 1, 1, 20, 20)
    ring = {r * 20 + c + 1 for r in range(3, 17) for c in range(2, 18) if r in (3, 16) or c in (2, 17)}
    zones = {1: ring, 2: ring - {3 * 20 + 10 + 1}, 3: {1, 2, 22, 400}}
    table = spark.createDataFrame([(z, c) for z, cells in zones.items() for c in cells], "zone int, pixelID long")
    got = {}
    for r in D.buffer_zones(table, 1.0, grid).collect():
        got.setdefault(r.zone, {})[r.pixelID] = r.v
    full = {1: {r * 20 + c + 1 for r in range(3, 17) for c in range(2, 18)}, 2: zones[2], 3: zones[3]}
    assert got == {z: {c: 2 if c in full[z] else 1 for c in near(full[z], grid, 1.0)} for z in zones}


def grown(rows, grid, goal_of, open_=None, rounds=100):
    """Rings one by one with sets: all cells of each finished fire, trimmed."""
    ring = {}
    for y, i, c in rows:
        ring.setdefault((y, i), {})[c] = 0
    goal = {k: goal_of(len(v)) for k, v in ring.items()}
    over, front = {}, {k: set(v) for k, v in ring.items()}
    for step in range(1, rounds + 2):
        for k in [k for k in ring if len(ring[k]) > goal[k]]:
            order = sorted(ring[k], key=lambda c: (ring[k][c], c * 7919 % 104729, c))
            over[k] = {c: ring[k][c] == 0 for c in order[: goal[k]]}
            del ring[k]
        if step > rounds:
            break
        taken, new = {(k[0], c) for k, v in ring.items() for c in v}, {}
        for k in ring:
            for c in front.get(k, ()):
                r, q = divmod(c - 1, grid.ncol)
                for a in range(max(r - 1, 0), min(r + 2, grid.nrow)):
                    for b in range(max(q - 1, 0), min(q + 2, grid.ncol)):
                        cell = a * grid.ncol + b + 1
                        if (k[0], cell) not in taken and (open_ is None or cell in open_):
                            new[k[0], cell] = min(new.get((k[0], cell), k[1]), k[1])
        front = {}
        for (y, c), i in new.items():
            front.setdefault((y, i), set()).add(c)
            ring[y, i][c] = step
    return over, ring


WAYS = [({}, False, True), ({"block": 3, "reach": 6, "side": 9}, True, True), ({"block": 2, "reach": 0, "side": 20}, True, False), ({"rounds": 3, "block": 2}, False, True)]


@pytest.mark.parametrize("way, masked, keep", WAYS)
def test_growth_in_blocks_against_a_loop(spark, way, masked, keep):
    rng = np.random.default_rng(11)
    grid = GridSpec(0, 0, 1, 1, 40, 36)
    starts = [(2000 + y, int(i), int(c)) for y in (0, 1) for i, c in enumerate(rng.integers(1, grid.ncell, 14))]
    rows = sorted({(y, i, min(c + d, grid.ncell)) for y, i, c in starts for d in (0, 1)} | {(2001, 77, c) for c in range(500, 530)})
    open_ = {c for c in range(1, grid.ncell + 1) if c % 7 and c % 11 != 3} if masked else None
    over, left = grown(rows, grid, lambda n: max(4 * n, 20), open_, way.get("rounds", 100))
    mask = spark.createDataFrame([(c,) for c in open_], "pixelID long") if masked else None
    got = {}
    for r in N.buffer_to_area(spark.createDataFrame(rows, "year int, ids long, pixelID long"), grid, area=lambda n: n * 4, min_size=20, mask=mask, resolve=False, keep_unfinished=keep, **way).collect():
        assert r.pixelID not in got.setdefault((r.year, r.ids), {})
        got[r.year, r.ids][r.pixelID] = bool(r.buffer)
    assert got == over | ({k: {c: n == 0 for c, n in v.items()} for k, v in left.items()} if keep else {})
    assert over


def test_growth_of_nothing(spark):
    assert N.buffer_to_area(spark.createDataFrame([], "year int, ids long, pixelID long"), GridSpec(0, 0, 1, 1, 5, 5)).count() == 0


@pytest.mark.parametrize("side", [3, 32])
def test_nearest_cells_of_a_group(spark, side):
    from pyrocell.operators.nearest import nearest_cells

    rng = np.random.default_rng(side)
    grid = GridSpec(5.0, 90.0, 2.0, 1.0, 40, 60)
    cells = sorted({(g, int(c)) for g in (1, 2, 3) for c in rng.integers(1, grid.ncell + 1, 60 if g < 3 else 1)})
    points = [(k, k % 5 if k % 5 else None, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 100, (60, 2)))]
    got = {r.point_id: (r.g, r.pixelID, r.dist) for r in nearest_cells(spark.createDataFrame(points, "point_id long, g int, x double, y double"), spark.createDataFrame([*cells, cells[0], (1, None)], "g int, pixelID long"), grid, ["g"], side).collect()}
    want = {}
    for k, g, x, y in points:
        if own := [(round(math.hypot(5 + ((c - 1) % 40 + 0.5) * 2 - x, 90 - ((c - 1) // 40 + 0.5) - y), 6), c) for z, c in cells if z == g]:
            want[k] = (g, min(own)[1], min(own)[0])
    assert got == want
