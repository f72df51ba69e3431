"""Work that mustn't grow with repeated rows, repeated reads or long edges."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pyrocell.grid import GridSpec
from pyrocell.operators import fires as N
from pyrocell.operators import fits as M
from pyrocell.operators import nearest, spatial


def noted(df):
    """df, and the number of its rows that were computed."""
    rows = df.sparkSession.sparkContext.accumulator(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), rows


def test_points_at_one_place_are_looked_up_once(spark, monkeypatch):
    grid, asked = GridSpec(0, 0, 1, 1, 64, 64), []
    possible = nearest._possible

    def looked_up(pairs, *by):
        asked.append(pairs.count())
        return possible(pairs, *by)

    monkeypatch.setattr(nearest, "_possible", looked_up)
    cells = spark.range(1, grid.ncell + 1).select(F.lit(1).alias("g"), F.col("id").alias("pixelID"))
    points = spark.range(500).select(F.col("id").alias("point_id"), F.lit(1).alias("g"), F.lit(3.5).alias("x"), F.lit(-0.5).alias("y"))
    got = nearest.nearest_cells(points, cells, grid, ["g"]).collect()
    assert len(got) == 500 and {(r.pixelID, r.dist) for r in got} == {(4, 0.0)}
    assert sum(asked) <= 4


def test_buffers_are_read_once_to_place_points(spark):
    grid = GridSpec(0, 0, 1, 1, 10, 10)
    buffers, rows = noted(spark.range(1, 51).select(F.lit(2000).alias("year"), F.lit(1).cast("long").alias("ids"), F.col("id").alias("pixelID"), F.lit(1).alias("buffer")))
    points = spark.createDataFrame([(1, 2000, 1, 0.5, -0.5), (2, 2000, 1, 0.5, -9.5)], "point_id long, year int, ids long, x double, y double")
    mask = spark.range(1, 101).select(F.col("id").alias("pixelID"), F.lit(1).alias("flammable"))
    got = {r.point_id: (r.pixelID, r.moved) for r in N.harmonize_buffer_and_points(points, buffers, mask, grid).collect()}
    assert got == {1: (1, 0), 2: (42, 1)} and rows.value == 50


def test_burn_rates_and_landscapes_are_read_once(spark):
    rates, rows = noted(spark.createDataFrame([("1", 0.1), ("2", 0.12), ("5", 0.6), ("missingForest", 0.5)], "lcc string, coef double"))
    assert len({r.group for r in M.cluster_nonforest(rates, 2).collect()}) == 2 and rows.value == 4
    forest = [(i, 2000, 5, f"Spec_{i % 2}", float(100 * (1 + i % 7)), int((i * 7 + i % 5) % 3 == 0)) for i in range(60)]
    bare = [(100 + i, 2000, 1 + i % 3, None, None, int(i % (2 + i % 3) == 0)) for i in range(30)]
    landscape, rows = noted(spark.createDataFrame(forest + bare, "pixelID long, year int, lcc int, speciesCode string, B double, burned int"))
    classes, groups, _ = M.assess_fuel_classes(landscape, spark.createDataFrame([("Spec_0", "a"), ("Spec_1", "b")], "speciesCode string, FuelClass string"), [1, 2, 3])
    assert classes.count() == 2 and groups.count() == 3 and rows.value == 90


def test_a_long_edge_is_many_tasks_work(spark):
    """A triangle of 20,000 rows: no task follows more of an edge than a strip or a few, and the cells are all there."""
    grid = GridSpec(0, 0, 1, 1, 4, 20000)
    ring = spark.createDataFrame([(1, 0, 0.5, -0.5), (1, 1, 0.5, -19999.5), (1, 2, 2.5, -19999.5)], "zone int, seq int, x double, y double")
    edges = spatial._edges(ring, ["zone"])
    most = spatial._by_row(edges, ["zone"], F.lit(0).cast("long"), F.lit(19999).cast("long")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 3 * 20000
    got = spatial.cells_touched(ring, grid, ["zone"])
    per = {r.c: r["count"] for r in got.groupBy(((F.col("pixelID") - 1) % 4).alias("c")).count().collect()}
    assert got.count() == got.distinct().count() and per == {0: 20000, 1: 15000, 2: 5001}


def test_a_mask_goes_to_tiles_as_bits(spark):
    """One row a tile, whatever its cells, and every window gets back the cells it holds, with rims wider than a tile too."""
    from pyrocell.operators.tiles import Tiling, around, packed

    grid = GridSpec(0, 0, 1, 1, 23, 19)
    cells = {int(c) for c in np.random.default_rng(4).integers(1, grid.ncell + 1, 150)}
    parts = packed(spark.createDataFrame([(c,) for c in [*cells, *cells]], "pixelID long"), grid, 4)
    assert parts.count() <= 5 * 6
    for rim in (0, 1, 5):
        tiling, got = Tiling(grid, rim, 4), {}
        for r in around(parts, tiling).collect():
            window = tiling.window(r.tile)
            window.paste(r.part, r.bits, got.setdefault(r.tile, np.zeros((window.h, window.w), bool)))
        for tile, mask in got.items():
            window = tiling.window(tile)
            assert set(window.pixels(np.flatnonzero(mask.ravel())).tolist()) == cells & set(window.pixels(np.arange(window.h * window.w)).tolist())
