"""The nearest cell of a point's own group, by boxes of cells inside boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyrocell.grid import GridSpec
from pyrocell.storage import materialise

#: Cells on a box's side, boxes on the side of the box around them.
SIDE = 32


def nearest_cells(points: DataFrame, cells: DataFrame, grid: GridSpec, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """(point_id, keys, pixelID, dist): for each point (point_id, keys, x, y) the cell of the same keys whose centre is nearest,
    of several the least; distances are rounded to six places. Points without a cell or with a null key have no row.

    A point starts with the largest boxes of its group, at most side squared, and keeps those that can hold its nearest
    cell: not farther at their near side than another box is at its far corner. Only the boxes in those are looked at
    next, and in the end the cells of the few smallest ones. So no group's cells meet all its points. Points of a group at
    one place are looked up together."""
    by = list(keys)
    here = [*by, *(F.floor(f(F.col("pixelID")) / side).alias(n) for f, n in ((grid.row, "r"), (grid.col, "c")))]
    placed = materialise(cells.where("pixelID IS NOT NULL").select(*here, "pixelID", grid.x(F.col("pixelID")).alias("cx"), grid.y(F.col("pixelID")).alias("cy")).distinct())
    extent = [f(g).alias(n) for f, g, n in ((F.min, "x0", "x0"), (F.max, "x1", "x1"), (F.min, "y0", "y0"), (F.max, "y1", "y1"))]
    boxes = [placed.groupBy(*by, "r", "c").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))]
    size = side
    while max(grid.ncol, grid.nrow) > size * side:
        size *= side
        boxes.append(boxes[-1].groupBy(*by, F.floor(F.col("r") / side).alias("r"), F.floor(F.col("c") / side).alias("c")).agg(*extent))
    own = points.select("point_id", *by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    place = [*by, "x", "y"]
    found = _possible(own.select(*place).distinct().join(boxes.pop(), by), place)
    while boxes:
        inner = boxes.pop().withColumns({"pr": F.floor(F.col("r") / side), "pc": F.floor(F.col("c") / side)})
        outer = found.select(*place, F.col("r").alias("pr"), F.col("c").alias("pc"))
        found = _possible(outer.join(inner, [*by, "pr", "pc"]).drop("pr", "pc"), place)
    last = materialise(found.select(*place, "r", "c"))  # its size is known: with few places no cell is shuffled
    dist = F.round(F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")), 6)
    nearest = F.min(F.struct(dist.alias("dist"), "pixelID")).alias("b")
    at = materialise(last.join(placed, [*by, "r", "c"]).groupBy(*place).agg(nearest))
    best = own.join(at, place).groupBy("point_id", *by).agg(F.min("b").alias("b"))
    return best.select("point_id", *by, "b.pixelID", "b.dist")


def _possible(pairs: DataFrame, place: Sequence[str]) -> DataFrame:
    """Of pairs of a place and a box those that can hold the place's nearest cell. A place has at most side squared boxes in each
    box it kept."""
    gap = lambda p, lo, hi: F.greatest(F.col(lo) - F.col(p), F.lit(0.0), F.col(p) - F.col(hi))
    reach = lambda p, lo, hi: F.greatest(F.abs(F.col(p) - F.col(lo)), F.abs(F.col(p) - F.col(hi)))
    near: Column = F.hypot(gap("x", "x0", "x1"), gap("y", "y0", "y1"))
    far: Column = F.hypot(reach("x", "x0", "x1"), reach("y", "y0", "y1"))
    best = F.min(far).over(W.partitionBy(*place))
    return pairs.withColumns({"__near": near, "__best": best}).where(F.col("__near") <= F.col("__best") + 1e-5).drop("__near", "__best")
