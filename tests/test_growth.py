"""Fires in chains and great fires grow as in a plain loop, and the rows of a job are dealt once."""

import pytest
from pyspark.sql import functions as F
from test_read_once import noted
from test_tiles import grown

from pyrocell.grid import GridSpec
from pyrocell.operators import fires as N
from pyrocell.storage import recording

GRID = GridSpec(0, 0, 1, 1, 60, 40)


def chain(years=(2000, 2001)):
    """Small fires three cells apart over the whole grid, a great one, one of two parts far from each other."""
    rows = {(y, 100 * r + c, r * 60 + c + 1 + d) for y in years for r in range(2, 26, 3) for c in range(y % 3, 58, 4) for d in (0, 1)}
    rows |= {(y, 7, (30 + r) * 60 + c + 1) for y in years for r in range(3) for c in range(5, 50)}
    return sorted(rows | {(y, 9, c) for y in years for c in (36 * 60 + 2, 36 * 60 + 58, 36 * 60 + 59)})


@pytest.mark.parametrize("way", [{}, {"side": 8, "reach": 3}, {"side": 8, "reach": 12, "block": 2}, {"side": 16, "reach": 1, "block": 3, "rounds": 2}])
@pytest.mark.parametrize("masked", [False, True])
def test_chains_and_great_fires_against_a_loop(spark, way, masked):
    rows = chain()
    open_ = {c for c in range(1, GRID.ncell + 1) if c % 7 and c % 11 != 3} if masked else None
    mask = spark.createDataFrame([(c,) for c in open_], "pixelID long") if masked else None
    over, left = grown(rows, GRID, lambda n: max(2 * n, 8), open_, way.get("rounds", 100))
    got = {}
    for r in N.buffer_to_area(spark.createDataFrame(rows, "year int, ids long, pixelID long"), GRID, lambda n: n * 2, 8, mask, resolve=False, keep_unfinished=True, **way).collect():
        assert r.pixelID not in got.setdefault((r.year, r.ids), {})
        got[r.year, r.ids][r.pixelID] = bool(r.buffer)
    assert got == over | {k: {c: n == 0 for c, n in v.items()} for k, v in left.items()}
    assert over


def test_a_chain_of_fires_over_many_tiles_is_grown_in_tiles(spark):
    """Fires that all but touch one another over the whole grid: a few tables, not some for each join of each ring."""
    fires = spark.createDataFrame(chain((2000,)), "year int, ids long, pixelID long")
    with recording(tables := []):
        assert N.buffer_to_area(fires, GRID, lambda n: n * 2, 8, side=8, reach=12).count()
    assert len(tables) <= 12


def test_fires_points_and_flammability_are_read_a_few_times(spark):
    fires, read = noted(spark.createDataFrame(chain(), "year int, ids long, pixelID long"))
    points, placed = noted(spark.createDataFrame([(i, y, i, (c - 1) % 60 + 0.5, -((c - 1) // 60) - 0.5) for y, i, c in chain() if c % 2], "point_id long, year int, ids long, x double, y double"))
    land, asked = noted(spark.range(1, GRID.ncell + 1).select(F.col("id").alias("pixelID"), (F.col("id") % 11 != 0).cast("int").alias("flammable")))
    buffers, cleaned = N.harmonize_fire_data(fires, points, land, GRID, lambda n: n * 2, 8)
    assert buffers.select("year", "ids").distinct().count() == cleaned.select("year", "ids").distinct().count() > 0
    assert read.value <= 2 * len(chain()) and placed.value <= len(chain()) and asked.value <= 5 * GRID.ncell


def test_repeated_and_missing_point_ids_keep_their_meaning(spark):
    """A point is moved unless a point of its id lies on a burned cell; one without an id may be kept and moved both."""
    grid = GridSpec(0, 0, 1, 1, 10, 10)
    buffers = spark.range(1, 51).select(F.lit(2000).alias("year"), F.lit(1).cast("long").alias("ids"), F.col("id").alias("pixelID"), F.lit(1).alias("buffer"))
    points = [(1, 2000, 1, 0.5, -0.5), (1, 2000, 1, 0.5, -9.5), (2, 2000, 1, 3.5, -9.5), (None, 2000, 1, 4.5, -0.5), (3, 2000, 2, 0.5, -0.5), (4, None, 1, 0.5, -0.5), (5, 2000, 1, 99.0, 99.0)]
    mask = spark.range(1, 101).select(F.col("id").alias("pixelID"), F.lit(1).alias("flammable"))
    out = N.harmonize_buffer_and_points(spark.createDataFrame(points, "point_id long, year int, ids long, x double, y double"), buffers, mask, grid)
    assert sorted((r.point_id or 0, r.pixelID, r.moved) for r in out.collect()) == [(0, 5, 0), (0, 15, 1), (1, 1, 0), (2, 44, 1), (5, 19, 1)]
