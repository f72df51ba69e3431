"""Neighbourhood, block, polygon and patch operators. Neighbour joins are equi joins on computed cell numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pyrocell.grid import GridSpec, neighbours, steps_within
from pyrocell.operators import tiles
from pyrocell.operators.nearest import nearest_cells
from pyrocell.operators.ranks import joined_by
from pyrocell.operators.tiles import Tiling, by_tile, fields
from pyrocell.storage import materialise


def cells_of_points(points: DataFrame, grid: GridSpec, layers: DataFrame | None = None) -> DataFrame:
    """Points with their pixelID (null outside) and the layers there."""
    out = points.withColumn("pixelID", grid.cell_from_xy(F.col("x"), F.col("y")))
    return out.join(layers, "pixelID", "left") if layers is not None else out


def cells_within(cells: DataFrame, radius: float, grid: GridSpec) -> DataFrame:
    """Each row once per cell (``to``) whose centre is within radius of its cell's centre."""
    return neighbours(cells, grid, steps_within(grid, radius))


def nearest_cell_same_fire(points: DataFrame, cells: DataFrame, grid: GridSpec, keys: Sequence[str] = ("year", "ids")) -> DataFrame:
    """Per point (point_id, keys, x, y) the nearest cell of its own fire; ties to the lowest pixelID."""
    return nearest_cells(points, cells, grid, keys)


def nearest_to_centroid(cells: DataFrame, grid: GridSpec, keys: Sequence[str] = ("year", "ids")) -> DataFrame:
    """Per fire the cell nearest the mean of its cell centres; ties to the lowest pixelID."""
    placed = cells.select(*keys, "pixelID", grid.x(F.col("pixelID")).alias("x"), grid.y(F.col("pixelID")).alias("y"))
    centre = placed.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    dist = F.round(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), 6)
    best = F.min(F.struct(dist.alias("dist"), "pixelID")).alias("b")
    return placed.join(centre, list(keys)).groupBy(*keys).agg(best, F.max("n").alias("n")).select(*keys, "b.pixelID", "n")


def _edges(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, y, x2, y2) of each ring, the closing edge included."""
    w = W.partitionBy(*keys).orderBy("seq")
    ring = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return vertices.select(*keys, "x", "y", F.coalesce(F.lead("x").over(w), F.first("x").over(ring)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(ring)).alias("y2"))


def cells_inside(vertices: DataFrame, grid: GridSpec, keys: Sequence[str]) -> DataFrame:
    """(keys, pixelID) of cells whose centre is inside the ring (seq, x, y) of its keys, even-odd. Edges count half open
    (y1 <= yc < y2)."""
    cells = _spans_inside(vertices, grid, keys).select(*keys, F.explode(F.sequence("c0", "c1")).alias("c"), "r")
    return cells.select(*keys, grid.cell(F.col("r"), F.col("c")).alias("pixelID"))


#: Rows of an edge that a task follows at once.
STRIP = 1024


def _by_row(edges: DataFrame, keys: Sequence[str], first: Column, last: Column) -> DataFrame:
    """Each edge once for every row ``r`` from first to last. Long edges are cut into strips of rows, which are dealt to
    a set number of tasks: a few edges of many rows are no few tasks' work."""
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cut = edges.withColumns({"r0": first, "r1": last}).where("r0 <= r1").withColumn("strip", F.explode(F.sequence(F.floor(F.col("r0") / STRIP), F.floor(F.col("r1") / STRIP))))
    rows = F.sequence(F.greatest("r0", F.col("strip") * STRIP), F.least("r1", F.col("strip") * STRIP + (STRIP - 1)))
    return cut.repartition(tasks, *keys, "strip").withColumn("r", F.explode(rows)).drop("r0", "r1", "strip")


def _spans_inside(vertices: DataFrame, grid: GridSpec, keys: Sequence[str]) -> DataFrame:
    """(keys, r, c0, c1): the runs of cells of a row that ``cells_inside`` has."""
    e = _edges(vertices, keys)
    lo, hi = F.least("y", "y2"), F.greatest("y", "y2")
    # rows whose centre line crosses the edge: lo <= yc < hi
    first = F.greatest(F.ceil((F.lit(grid.ymax) - hi) / grid.res_y - 0.5 + 1e-12), F.lit(0))
    last = F.least(F.floor((F.lit(grid.ymax) - lo) / grid.res_y - 0.5), F.lit(grid.nrow - 1))
    crossed = _by_row(e.where(lo < hi), keys, first, last)
    yc = F.lit(grid.ymax) - (F.col("r") + 0.5) * grid.res_y
    at = crossed.where((yc >= lo) & (yc < hi)).select(*keys, "r", (F.col("x") + (yc - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))).alias("xc"))
    order = W.partitionBy(*keys, "r").orderBy("xc")
    pairs = at.withColumns({"n": F.row_number().over(order), "xe": F.lead("xc").over(order)}).where("n % 2 = 1 AND xe IS NOT NULL")
    c0 = F.greatest(F.ceil((F.col("xc") - grid.xmin) / grid.res_x - 0.5), F.lit(0))
    c1 = F.least(F.ceil((F.col("xe") - grid.xmin) / grid.res_x - 0.5) - 1, F.lit(grid.ncol - 1))
    return pairs.select(*keys, "r", c0.alias("c0"), c1.alias("c1")).where("c0 <= c1")


def cells_touched(vertices: DataFrame, grid: GridSpec, keys: Sequence[str]) -> DataFrame:
    """(keys, pixelID), distinct: the cells inside a ring and those its edges pass through. An edge is followed row by row;
    a point on a cell's edge belongs to the cell right of or below it. A ring of one or two corners is a point or a line."""
    u, v = (lambda c: (F.col(c) - grid.xmin) / grid.res_x), (lambda c: (F.lit(grid.ymax) - F.col(c)) / grid.res_y)
    down = _edges(vertices, keys).select(*keys, u("x").alias("ua"), v("y").alias("va"), u("x2").alias("ub"), v("y2").alias("vb"))
    flip = F.col("va") > F.col("vb")
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    down = down.select(*keys, pick("ua", "ub").alias("u1"), pick("va", "vb").alias("v1"), pick("ub", "ua").alias("u2"), pick("vb", "va").alias("v2"))
    each = _by_row(down, keys, F.greatest(F.floor("v1"), F.lit(0)), F.least(F.floor("v2"), F.lit(grid.nrow - 1)))
    at = lambda d: F.col("u1") + (d - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))
    enters = F.when(F.col("v1") >= F.col("r"), F.col("u1")).otherwise(at(F.col("r")))
    leaves = F.when(F.col("v2") <= F.col("r") + 1, F.col("u2")).otherwise(at(F.col("r") + 1))
    spans = each.select(*keys, "r", enters.alias("a"), leaves.alias("b"))
    spans = spans.select(*keys, "r", F.greatest(F.floor(F.least("a", "b")), F.lit(0)).alias("c0"), F.least(F.floor(F.greatest("a", "b")), F.lit(grid.ncol - 1)).alias("c1")).where("c0 <= c1")
    both = spans.union(_spans_inside(vertices, grid, keys)).groupBy(*keys, "r").agg(F.collect_list(F.struct("c0", "c1")).alias("spans"))
    # a row's cells are put together before they become rows: spans are shuffled, not cells
    columns = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["c0"], s["c1"]))))
    return both.select(*keys, "r", F.explode(columns).alias("c")).select(*keys, grid.cell(F.col("r"), F.col("c")).alias("pixelID"))


def rasterize(vertices: DataFrame, grid: GridSpec, field: str, fun: str = "min", background: float | None = None, touches: bool = False) -> DataFrame:
    """(pixelID, field) of cells whose centre is inside a polygon (poly_id), or with ``touches`` of all that it touches;
    reducer min, max or last (greatest poly_id). With a background, other cells of the grid get it."""
    cells = (cells_touched if touches else cells_inside)(vertices, grid, ["poly_id", field])
    reduce_ = {"min": F.min(field), "max": F.max(field), "last": F.max_by(field, "poly_id")}[fun]
    out = cells.groupBy("pixelID").agg(reduce_.alias(field))
    if background is None:
        return out
    every = vertices.sparkSession.range(1, grid.ncell + 1).withColumnRenamed("id", "pixelID")
    return every.join(out, "pixelID", "left").withColumn(field, F.coalesce(field, F.lit(background)))


def zones_touching(zones: DataFrame, study: DataFrame) -> DataFrame:
    """Zones with a cell in the study area."""
    return zones.join(study.select("pixelID").distinct(), "pixelID", "left_semi").select("zone").distinct()


def block_of(grid: GridSpec, fact: int, cell: Column) -> Column:
    """1-based number of the coarse cell, row-major."""
    ncol = -(-grid.ncol // fact)
    return (F.floor(grid.row(cell) / fact) * ncol + F.floor(grid.col(cell) / fact) + 1).cast("long")


def block_mean(df: DataFrame, grid: GridSpec, fact: int, col: str, na_rm: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Mean per block of fact x fact cells; without na_rm a missing cell makes its block null."""
    n = F.count(col)
    whole = F.avg(col) if na_rm else F.when(n == fact * fact, F.avg(col))
    return df.groupBy(*by, block_of(grid, fact, F.col("pixelID")).alias("block")).agg(whole.alias(col))


def block_modal(df: DataFrame, grid: GridSpec, fact: int, col: str) -> DataFrame:
    """Most frequent value per block, nulls left out; ties to the lowest."""
    return df.groupBy(block_of(grid, fact, F.col("pixelID")).alias("block")).agg(F.mode(col, True).alias(col))


def focal_mean_fill(df: DataFrame, grid: GridSpec, col: str, w: int = 3) -> DataFrame:
    """Nulls become the mean of the w x w window; other cells stay, as do other columns. A null window stays null; rows
    that share a cell count each."""
    tiling, columns = Tiling(grid, w // 2), df.columns

    def fill(window: tiles.Window, _: dict, rows: pa.Table) -> pa.Table:
        at, known = window.at(rows["pixelID"]), rows[col].is_valid().to_numpy()
        values = rows[col].cast(pa.float64()).to_numpy(zero_copy_only=False)
        total, n = tiles.box_sums(window.sums(at[known], values[known]), w // 2).ravel(), tiles.box_sums(window.sums(at[known]), w // 2).ravel()
        own = window.is_core[at]
        filled = np.where(known, values, total[at] / np.where(n[at] > 0, n[at], 1))
        out = pa.array(filled[own], mask=~(known | (n[at] > 0))[own])
        kept = rows.filter(pa.array(own)).select(columns)
        return kept.set_column(kept.schema.get_field_index(col), col, out)

    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name == col else f.dataType) for f in df.schema])
    return by_tile(tiling.spread(df), [], tiling, fill, schema)


def focal_modal_fill(df: DataFrame, grid: GridSpec, col: str, w: int = 5, mask: DataFrame | None = None) -> DataFrame:
    """Nulls become the window's mode (ties to the lowest); then only the mask's cells keep a value. A null window stays
    null; rows that share a cell count each."""
    k = w // 2
    tiling, columns = Tiling(grid, k), df.columns

    def fill(window: tiles.Window, _: dict, rows: pa.Table) -> pa.Table:
        at, known = window.at(rows["pixelID"]), rows[col].is_valid().to_numpy()
        values = pc.unique(rows[col].drop_null())
        values = values.take(pc.sort_indices(values))
        code = np.where(known, pc.fill_null(pc.index_in(rows[col], values), 0).to_numpy(), -1)
        own = window.is_core[at]
        asked = np.flatnonzero(own & ~known)
        found = np.full(len(at), -1)
        layer = tiles.layers_of(at[known])
        dense = np.full((1 + int(layer.max(initial=0)), window.h + 2 * k, window.w + 2 * k), -1)  # a layer for each row of a cell
        dense[layer, at[known] // window.w + k, at[known] % window.w + k] = code[known]
        around = [d[at[asked] // window.w + r, at[asked] % window.w + c] for d in dense for r in range(w) for c in range(w)]
        found[asked] = tiles.most_frequent(np.stack(around, axis=1))
        code = np.where(known, code, found)[own]
        kept = rows.filter(pa.array(own)).select(columns)
        out = values.take(pa.array(code, mask=code < 0))
        return kept.set_column(kept.schema.get_field_index(col), col, out)

    out = by_tile(tiling.spread(df), [], tiling, fill, T.StructType(list(df.schema)))
    return out.join(mask.select("pixelID").distinct(), "pixelID", "left_semi") if mask is not None else out


def neighbour_count(cells: DataFrame, mask: DataFrame, grid: GridSpec, col: str) -> DataFrame:
    """Sum of the mask over the cell and its eight neighbours, minus 1, of each distinct cell."""
    tiling = Tiling(grid, 1)
    whole = isinstance(mask.schema[col].dataType, T.IntegralType)
    kind = T.LongType() if whole else T.DoubleType()

    def count(window: tiles.Window, _: dict, rows: pa.Table) -> pa.Table:
        at, value = window.at(rows["pixelID"]), rows["__m"]
        known = value.is_valid().to_numpy()
        n = np.zeros(window.h * window.w, np.int64 if whole else np.float64)
        np.add.at(n, at[known], pc.drop_null(value).to_numpy())
        n = tiles.box_sums(n.reshape(window.h, window.w), 1).ravel() - 1
        asked = np.flatnonzero(window.mask(at[rows["__asked"].to_numpy()]).ravel())
        return pa.Table.from_arrays([pa.array(window.pixels(asked)), pa.array(n[asked])], ["pixelID", "n"])

    asked = cells.where("pixelID IS NOT NULL").select("pixelID", F.lit(None).cast(kind).alias("__m"), F.lit(True).alias("__asked"), tiling.tile(F.col("pixelID")).alias("tile"))
    there = tiling.spread(mask.select("pixelID", F.col(col).cast(kind).alias("__m"), F.lit(False).alias("__asked")))
    return by_tile(asked.unionByName(there), [], tiling, count, fields(mask, [], pixelID=T.LongType(), n=kind))


def patches(cells: DataFrame, grid: GridSpec, directions: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """(by, pixelID, patch): connected cells of one value of ``by``, which may be null, share the least pixelID as label.
    Repeated cells count once, rows without a cell don't; an empty table gives an empty one."""
    return tiles.connected(cells, grid, directions, by)


def drop_small_patches(zone: DataFrame, grid: GridSpec, least: int = 500, by: Sequence[str] = ("zone",)) -> DataFrame:
    """Cells with ``lost`` 1 where their eight-neighbour patch has under ``least`` cells, unless all of a zone's do."""
    labelled = patches(zone, grid, 8, by)
    sizes = labelled.groupBy(*by, "patch").agg(F.count("*").alias("n"))
    some = sizes.groupBy(*by).agg(F.max("n").alias("most"))
    lost = ((F.col("n") < least) & (F.col("most") >= least)).cast("int").alias("lost")
    of_patch = joined_by(sizes, some, by).select(*by, "patch", lost)
    return joined_by(labelled, of_patch, [*by, "patch"])


def buffer_zones(zones: DataFrame, width: float, grid: GridSpec) -> DataFrame:
    """(zone, pixelID, v) of zones (zone, pixelID): 2 on a zone with its holes filled, 1 within width of it. All zones at once.

    Holes are patches of a zone's complement, inside its box widened by a cell, that don't reach the box's edge."""
    wide = GridSpec(0, 0, 1, 1, grid.ncol + 2, grid.nrow + 2)  # one cell more on each side
    tiling = Tiling(wide)
    placed = zones.select("zone", (grid.row(F.col("pixelID")) + 1).alias("r"), (grid.col(F.col("pixelID")) + 1).alias("c")).where("r IS NOT NULL").distinct()
    box = placed.groupBy("zone").agg((F.min("r") - 1).alias("r0"), (F.max("r") + 1).alias("r1"), (F.min("c") - 1).alias("c0"), (F.max("c") + 1).alias("c1"))
    part = lambda x: F.floor(F.col(x) / tiling.side)
    tiled = box.withColumn("tr", F.explode(F.sequence(part("r0"), part("r1")))).withColumn("tc", F.explode(F.sequence(part("c0"), part("c1"))))
    tiled = tiled.select("zone", (F.col("tr") * tiling.across + F.col("tc")).cast("long").alias("tile"), F.lit(None).cast("long").alias("pixelID"), "r0", "r1", "c0", "c1")
    inside = placed.select("zone", wide.cell(F.col("r"), F.col("c")).alias("pixelID"))
    inside = inside.select("zone", tiling.tile(F.col("pixelID")).alias("tile"), "pixelID", *(F.lit(None).cast("long").alias(x) for x in ("r0", "r1", "c0", "c1")))

    def complement(window: tiles.Window, group: dict, rows: pa.Table) -> pa.Table:
        """The cells around a zone in one tile, but for those of patches that the box's edge is seen to end in the tile."""
        bounds = rows.filter(rows["pixelID"].is_null()).slice(0, 1).to_pylist()[0]
        r, c = np.arange(window.h)[:, None] + window.r0, np.arange(window.w)[None, :] + window.c0
        free = (r >= bounds["r0"]) & (r <= bounds["r1"]) & (c >= bounds["c0"]) & (c <= bounds["c1"])
        free &= ~window.mask(window.at(rows["pixelID"].drop_null()))
        root = tiles.labels(free, 4).ravel()
        ends = free & ((r == bounds["r0"]) | (r == bounds["r1"]) | (c == bounds["c0"]) | (c == bounds["c1"]))
        open_, rim = np.zeros(free.size + 1, bool), np.zeros_like(free)
        open_[root[ends.ravel()]] = True
        rim[[0, -1]] = rim[:, [0, -1]] = True
        at = np.flatnonzero(free.ravel() & (~open_[root] | rim.ravel()))
        return pa.Table.from_arrays([pa.array([group["zone"]] * len(at), rows.schema.field("zone").type), pa.array(window.pixels(at)), pa.array(open_[root[at]])], ["zone", "pixelID", "open"])

    both = tiled.unionByName(inside)
    outside = materialise(by_tile(both, ["zone"], tiling, complement, fields(both, ["zone"], pixelID=T.LongType(), open=T.BooleanType())))
    labelled = joined_by(patches(outside, wide, 4, ["zone"]), outside, ["zone", "pixelID"])
    closed = labelled.groupBy("zone", "patch").agg(F.max("open").alias("open")).where("NOT open").select("zone", "patch", F.lit(True).alias("closed"))
    holes = joined_by(labelled, closed, ["zone", "patch"]).where("closed")
    back = grid.cell(wide.row(F.col("pixelID")) - 1, wide.col(F.col("pixelID")) - 1)
    full = materialise(zones.select("zone", "pixelID").union(holes.select("zone", back)).distinct())
    return tiles.reached(full, width, grid, ["zone"]).select("zone", "pixelID", F.when(F.col("own"), 2).otherwise(1).alias("v"))


def buffer_zone(zone: DataFrame, width: float, grid: GridSpec) -> DataFrame:
    """``buffer_zones`` of one zone's cells: (pixelID, v)."""
    return buffer_zones(zone.select(F.lit(0).alias("zone"), "pixelID"), width, grid).drop("zone")
