"""Provinces as cell tables: parts of one province merged by their hull, large ones cut by k-means, all at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pyrocell.grid import GridSpec
from pyrocell.operators.ranks import joined_by
from pyrocell.operators.spatial import cells_touched, patches
from pyrocell.operators.tiles import fields
from pyrocell.storage import materialise

#: Hulls of so many parts of a group are made apart before the hull of the hulls.
PARTS = 64


def hull_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the convex hull's corners, counter-clockwise from the least x, of those the least y; no corner lies on
    the line between two others."""
    order = np.lexsort((y, x))
    order = order[np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]] if len(order) else order
    if len(order) < 3:
        return order
    sides = []
    for way in (order, order[::-1]):
        side: list[int] = []
        for p in way.tolist():
            while len(side) > 1 and (x[side[-1]] - x[side[-2]]) * (y[p] - y[side[-2]]) <= (y[side[-1]] - y[side[-2]]) * (x[p] - x[side[-2]]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return np.array(sides)


def convex_hulls(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, seq, x, y): the corners of the convex hull of each group of points, counter-clockwise; one or two for a point
    or a line. The hull of hulls is the hull: of each x only the least and greatest y leave a task, parts of a group
    are reduced to their hulls, and one task sees those alone. Rows without x or y count for nothing; null keys are a
    group."""
    by = list(by)
    ends = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*by, F.col("x").cast("double").alias("x")).agg(F.min("y").cast("double").alias("lo"), F.max("y").cast("double").alias("hi"))
    each = ends.select(*by, "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"), F.pmod(F.hash("x"), F.lit(PARTS)).alias("part"))

    def corners(key: tuple, rows: pa.Table) -> pa.Table:
        at = hull_of(rows["x"].to_numpy(), rows["y"].to_numpy())
        return rows.select([*by, "x", "y"]).take(pa.array(at)).append_column("seq", pa.array(np.arange(len(at)), pa.int32()))

    schema = fields(each, [*by, "x", "y"], seq=T.IntegerType())
    some = each.groupBy(*by, "part").applyInArrow(corners, schema)
    whole = (some.groupBy(*by) if by else some.groupBy(F.lit(0).alias("__all"))).applyInArrow(corners, schema)
    return whole.select(*by, "seq", "x", "y")


def merged_provinces(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """(zone, pixelID): zones (zone, pixelID) of several patches, eight neighbours joined, get all the cells that the hull of
    their cells' centres touches; other zones stay as they are. Provinces may overlap then."""
    cells = materialise(cells.select("zone", "pixelID").distinct())
    several = patches(cells, grid, 8, ["zone"]).groupBy("zone").agg((F.min("patch") < F.max("patch")).alias("several")).where("several")
    row = F.floor(grid.row(F.col("pixelID")))
    ends = joined_by(cells, several, ["zone"]).where("several").groupBy("zone", row.alias("row")).agg(F.min("pixelID").alias("a"), F.max("pixelID").alias("b"))
    ends = ends.select("zone", F.explode(F.array("a", "b")).alias("p"))
    hulls = convex_hulls(ends.select("zone", grid.x(F.col("p")).alias("x"), grid.y(F.col("p")).alias("y")), ["zone"])
    return cells.union(cells_touched(hulls, grid, ["zone"]).select("zone", "pixelID")).distinct()


def split_large_zones(cells: DataFrame, max_cells: int, rounds: int = 20) -> DataFrame:
    """Adds part (1, 2, ...) to cells (zone, pixelID, x, y): a zone of more than max_cells cells is cut into
    ceil(cells / max_cells) parts by k-means, parts ordered by least x, then least y; other zones are part 1.

    All zones are cut together. The first centres are those of strips of as many cells across the zone's longer axis;
    a round is one aggregate over the cells, with the few centres of a zone beside each; it ends when no centre
    moves. A centre that no cell is nearest to stays."""
    size = cells.groupBy("zone").agg(F.count("*").alias("n"), (F.coalesce(F.var_pop("x"), F.lit(0.0)) >= F.coalesce(F.var_pop("y"), F.lit(0.0))).alias("wide"))
    large = materialise(size.where(F.col("n") > max_cells).select("zone", "n", "wide", F.ceil(F.col("n") / max_cells).alias("k")))
    tagged = joined_by(cells, large, ["zone"])
    rest = tagged.where("k IS NULL").select(*cells.columns, F.lit(1).alias("part"))
    own = materialise(tagged.where("k IS NOT NULL").withColumn("t", F.when(F.col("wide"), F.col("x")).otherwise(F.col("y"))))
    lines = own.groupBy("zone", "n", "k", "t").agg(F.count("*").alias("c"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("zone").orderBy("t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each line of cells
    strips = lines.withColumn("c0", F.floor(before * F.col("k") / F.col("n")).cast("int")).groupBy("zone", "c0")
    at = lambda total, n: F.round(total / n, 6)
    centres = materialise(strips.agg(at(F.sum("sx"), F.sum("c")).alias("cx"), at(F.sum("sy"), F.sum("c")).alias("cy")).withColumnRenamed("c0", "c"))
    for _ in range(rounds):
        sums = _nearest(own, centres).groupBy("zone", "c").agg(at(F.sum("x"), F.count("*")).alias("nx"), at(F.sum("y"), F.count("*")).alias("ny"))
        moved = materialise(joined_by(centres, sums, ["zone", "c"]))
        centres = moved.select("zone", "c", F.coalesce("nx", "cx").alias("cx"), F.coalesce("ny", "cy").alias("cy"))
        if moved.where("nx <> cx OR ny <> cy").isEmpty():
            break
    cut = materialise(_nearest(own, centres))
    low = cut.groupBy("zone", "c").agg(F.min("x").alias("lx"), F.min("y").alias("ly"))
    named = low.select("zone", "c", F.row_number().over(W.partitionBy("zone").orderBy("lx", "ly", "c")).alias("part"))
    return joined_by(cut, named, ["zone", "c"]).select(*cells.columns, "part").unionByName(rest)


def _nearest(cells: DataFrame, centres: DataFrame) -> DataFrame:
    """Cells with the number c of their zone's nearest centre, of several the least."""
    of_zone = centres.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("c", "cx", "cy"))).alias("centres"))  # k entries
    square = lambda z: (F.col("x") - z["cx"]) * (F.col("x") - z["cx"]) + (F.col("y") - z["cy"]) * (F.col("y") - z["cy"])
    best = F.array_min(F.transform("centres", lambda z: F.struct(square(z).alias("d"), z["c"].alias("c"))))["c"]
    return joined_by(cells, of_zone, ["zone"]).withColumn("c", best).drop("centres")
