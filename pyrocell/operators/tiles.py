"""Rasters in tiles: square blocks of cells, each with a rim of its neighbours' cells.

A neighbourhood of a cell is looked up in the dense arrays of the cell's tile, so a cell is shuffled once, and once more
for each tile whose rim it is in: (1 + 2 * rim / side) squared times on average, 1.02 for a 5 x 5 window, whatever the
size of the window. A task holds one tile of one group at a time: at most a tile's cells, however many rows a group has.
Rows without a cell are in no tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyrocell.grid import EIGHT, FOUR, GridSpec, neighbours
from pyrocell.operators.components import components, least_roots
from pyrocell.operators.ranks import joined_by, running_sums
from pyrocell.storage import materialise

SIDE = 512
#: A node of the graph between tiles is a number of its group and a cell.
CELL_BITS = 40


@dataclass(frozen=True)
class Tiling:
    """Tiles of side x side cells of a grid; a window is a tile with ``rim`` cells more on each side, inside the grid."""

    grid: GridSpec
    rim: int = 0
    side: int = SIDE

    @property
    def across(self) -> int:
        return -(-self.grid.ncol // self.side)

    def tile(self, cell):
        """Number of the tile that a cell, a column, belongs to."""
        return (F.floor(self.grid.row(cell) / self.side) * self.across + F.floor(self.grid.col(cell) / self.side)).cast("long")

    def spread(self, df: DataFrame, cell: str = "pixelID") -> DataFrame:
        """Each row once for each ``tile`` whose window holds its cell."""
        if not self.rim:
            return df.where(F.col(cell).isNotNull()).withColumn("tile", self.tile(F.col(cell)))
        row, col = self.grid.row(F.col(cell)), self.grid.col(F.col(cell))
        tiles = lambda at, n: F.explode(F.sequence(F.greatest(F.floor((at - self.rim) / self.side), F.lit(0)), F.least(F.floor((at + self.rim) / self.side), F.lit(-(-n // self.side) - 1))))
        out = df.where(F.col(cell).isNotNull()).withColumn("__r", tiles(row, self.grid.nrow)).withColumn("__c", tiles(col, self.grid.ncol))
        return out.withColumn("tile", (F.col("__r") * self.across + F.col("__c")).cast("long")).drop("__r", "__c")

    def window(self, tile: int) -> Window:
        r, c = divmod(tile, self.across)
        return Window(self, r * self.side, c * self.side)


class Window:
    """A tile's place in the grid; arrays over it are flat, row-major, rim included."""

    def __init__(self, tiling: Tiling, row: int, col: int):
        g, s, k = tiling.grid, tiling.side, tiling.rim
        self.tiling, self.ncol = tiling, g.ncol
        self.r0, self.c0 = max(0, row - k), max(0, col - k)
        self.h, self.w = min(g.nrow, row + s + k) - self.r0, min(g.ncol, col + s + k) - self.c0
        self.core = slice(row - self.r0, min(row + s, g.nrow) - self.r0), slice(col - self.c0, min(col + s, g.ncol) - self.c0)
        self.is_core = np.zeros((self.h, self.w), bool)
        self.is_core[self.core] = True
        self.is_core = self.is_core.ravel()

    def at(self, pixels: pa.ChunkedArray) -> np.ndarray:
        """Flat places of cells."""
        r, c = np.divmod(pixels.to_numpy() - 1, self.ncol)
        return (r - self.r0) * self.w + (c - self.c0)

    def pixels(self, at: np.ndarray) -> np.ndarray:
        r, c = np.divmod(at, self.w)
        return (r + self.r0) * self.ncol + c + self.c0 + 1

    def paste(self, tile: int, bits: bytes, onto: np.ndarray) -> None:
        """Sets the rows and columns ``onto`` where the bits of a tile, as ``packed`` has them, are set."""
        core = Tiling(self.tiling.grid, 0, self.tiling.side).window(tile)
        of = np.unpackbits(np.frombuffer(bits, np.uint8), count=core.h * core.w).reshape(core.h, core.w).astype(bool)
        r0, r1, c0, c1 = max(core.r0, self.r0), min(core.r0 + core.h, self.r0 + self.h), max(core.c0, self.c0), min(core.c0 + core.w, self.c0 + self.w)
        if r0 < r1 and c0 < c1:
            onto[r0 - self.r0 : r1 - self.r0, c0 - self.c0 : c1 - self.c0] |= of[r0 - core.r0 : r1 - core.r0, c0 - core.c0 : c1 - core.c0]

    def mask(self, at: np.ndarray) -> np.ndarray:
        """True where a cell is; rows and columns."""
        out = np.zeros(self.h * self.w, bool)
        out[at] = True
        return out.reshape(self.h, self.w)

    def sums(self, at: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(at, values, self.h * self.w).reshape(self.h, self.w)


def fields(df: DataFrame, of: Sequence[str], **more: T.DataType) -> T.StructType:
    """Columns of df, then more."""
    return T.StructType([*(df.schema[c] for c in of), *(T.StructField(k, t) for k, t in more.items())])


def by_tile(df: DataFrame, by: Sequence[str], tiling: Tiling, f: Callable[[Window, dict, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """f(window, group, rows) for each group of ``by`` and tile of df, which has the column tile. Tiles cost by their cells, not
    by the bytes of their rows, so they are dealt to a set number of tasks, several a core, and not gathered by size."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        *group, tile = (k.as_py() for k in key)
        return f(tiling.window(tile), dict(zip(by, group)), rows)

    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *by, "tile").groupBy(*by, "tile").applyInArrow(run, schema)


def packed(cells: DataFrame, grid: GridSpec, side: int = SIDE) -> DataFrame:
    """(part, bits): for each tile that has some of the cells (pixelID), a bit a cell of it, row-major. Cells may repeat."""
    tiling = Tiling(grid, 0, side)

    def pack(window: Window, _: dict, rows: pa.Table) -> pa.Table:
        tile = window.r0 // side * tiling.across + window.c0 // side
        return pa.Table.from_arrays([pa.array([tile], pa.int64()), pa.array([np.packbits(window.mask(window.at(rows["pixelID"]))).tobytes()], pa.binary())], ["part", "bits"])

    named = tiling.spread(cells.select(F.col("pixelID").cast("long").alias("pixelID")))
    return by_tile(named, [], tiling, pack, T.StructType([T.StructField("part", T.LongType()), T.StructField("bits", T.BinaryType())]))


def around(parts: DataFrame, tiling: Tiling) -> DataFrame:
    """Rows of ``packed`` once for each ``tile`` whose window holds a place of theirs."""
    k, down, across = -(-tiling.rim // tiling.side), -(-tiling.grid.nrow // tiling.side), tiling.across
    near = lambda at, n: F.explode(F.sequence(F.greatest(at - k, F.lit(0)), F.least(at + k, F.lit(n - 1))))
    out = parts.withColumn("__r", near(F.floor(F.col("part") / across), down)).withColumn("__c", near(F.col("part") % across, across))
    return out.withColumn("tile", (F.col("__r") * across + F.col("__c")).cast("long")).drop("__r", "__c")


def box_sums(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over the 2 k + 1 square about each place, nothing beyond the edge."""
    for _ in range(2):
        out = a.copy()
        for step in range(1, min(k, len(a) - 1) + 1):
            out[step:] += a[:-step]
            out[:-step] += a[step:]
        a = out.T
    return a


#: More rows than a window has.
FAR = 1 << 29


def rows_to_nearest(mask: np.ndarray) -> np.ndarray:
    """Rows up or down each column to its nearest true place, FAR or more if it has none."""
    rows = np.arange(len(mask), dtype=np.int32)[:, None]
    last = np.maximum.accumulate(np.where(mask, rows, np.int32(-FAR - len(mask))), axis=0)
    following = np.minimum.accumulate(np.where(mask, rows, np.int32(FAR + len(mask)))[::-1], axis=0)[::-1]
    return np.minimum(rows - last, following - rows)


def squares_to_nearest(mask: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """Exact squared distance from each place to the nearest true one, cells being dy high and dx wide; infinite if
    there is none. Two passes, whatever the distance: down and up the columns, then along each row the lower envelope
    of a parabola for each place of it, all rows in step."""
    h, w = mask.shape
    if not mask.any():
        return np.full((h, w), np.inf)
    f = rows_to_nearest(mask)
    f = np.ascontiguousarray(np.where(f < FAR, (f * float(dy)) ** 2, np.inf).T)  # a row of f: one column, all rows of the window
    x = np.arange(w) * float(dx)
    vertex = np.zeros((w, h), np.int64)  # of each row's envelope, left to right
    start = np.full((w + 1, h), np.inf)  # where each parabola becomes the lowest
    k = np.full(h, -1)
    for q in range(w):
        on = np.flatnonzero(np.isfinite(f[q]))
        while len(on):
            top = k[on]
            v = vertex[np.maximum(top, 0), on]
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(top < 0, -np.inf, ((f[q, on] + x[q] ** 2) - (f[v, on] + x[v] ** 2)) / (2 * (x[q] - x[v])))
            under = (top >= 0) & (s <= start[np.maximum(top, 0), on])
            put, above = on[~under], top[~under] + 1
            vertex[above, put], start[above, put], start[above + 1, put], k[put] = q, s[~under], np.inf, above
            on = on[under]
            k[on] -= 1
    out = np.full((w, h), np.inf)
    some = np.flatnonzero(k >= 0)
    at = np.zeros(h, np.int64)
    for q in range(w):
        on = some
        while len(on := on[start[at[on] + 1, on] < x[q]]):
            at[on] += 1
        v = vertex[at[some], some]
        out[q, some] = f[v, some] + (x[q] - x[v]) ** 2
    return out.T


#: Columns of a radius up to which columns beside each other are compared; beyond, the envelope costs less.
NEAR = 128


def within(mask: np.ndarray, radius: float, grid: GridSpec) -> np.ndarray:
    """Places whose centre is within radius of a true one's. A column's true places reach so many rows beside it as the
    radius leaves for the columns between, so one comparison for each of those does, up to NEAR of them."""
    edge, k = radius + 1e-9, int(radius / grid.res_x + 1e-9)
    if k > NEAR:
        return np.sqrt(squares_to_nearest(mask, grid.res_y, grid.res_x)) <= edge
    rows, out = rows_to_nearest(mask), np.zeros_like(mask)
    for c in range(min(k, mask.shape[1] - 1) + 1):
        reach = int(radius / grid.res_y + 1e-9) + 1
        while reach >= 0 and math.hypot(reach * grid.res_y, c * grid.res_x) > edge:
            reach -= 1
        near = rows <= reach
        out[:, c:] |= near[:, : mask.shape[1] - c]
        out[:, : mask.shape[1] - c] |= near[:, c:]
    return out


def within_square(mask: np.ndarray, k: int) -> np.ndarray:
    """Places within k rows and k columns of a true one."""
    for axis in (0, 1):
        out = mask.copy()
        n = mask.shape[axis]
        for step in range(1, min(k, n - 1) + 1):
            far, near = [slice(None)] * 2, [slice(None)] * 2
            far[axis], near[axis] = slice(step, None), slice(n - step)
            out[tuple(far)] |= mask[tuple(near)]
            out[tuple(near)] |= mask[tuple(far)]
        mask = out
    return mask


def rim_of(radius: float, grid: GridSpec) -> int:
    """Cells that a radius reaches at most."""
    return int(radius / min(grid.res_x, grid.res_y) + 1e-9) + 1


def labels(mask: np.ndarray, directions: int) -> np.ndarray:
    """For each true place the first place, flat, of those connected to it, -1 elsewhere. Runs of a row are nodes; runs
    that touch in two rows are joined, found by where they begin and end."""
    h, w = mask.shape
    out = np.full((h, w), -1)
    begins = mask & ~np.pad(mask, ((0, 0), (1, 0)))[:, :-1]
    ends = mask & ~np.pad(mask, ((0, 0), (0, 1)))[:, 1:]
    first, last, side = np.flatnonzero(begins), np.flatnonzero(ends), int(directions == 8)
    row, a, b = first // w, first % w + 1, last % w + 1
    starts, stops, above = row * (w + 2) + a, row * (w + 2) + b, (row - 1) * (w + 2)  # rows stay apart with a place more on each side
    low, high = np.searchsorted(stops, above + a - side), np.searchsorted(starts, above + b + side, "right")
    n = np.maximum(high - low, 0)
    by = np.repeat(np.arange(len(first)), n)
    root = least_roots(by, np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n), len(first))
    out[mask] = np.repeat(first[root], last - first + 1)
    return out


def connected(cells: DataFrame, grid: GridSpec, directions: int, by: Sequence[str] = (), grown: Callable[[np.ndarray], np.ndarray] | None = None, rim: int = 0, side: int = SIDE) -> DataFrame:
    """(by, pixelID, patch) of the distinct cells of each group of ``by``, nulls being a group: cells that are connected,
    directly or by the places that ``grown`` adds to a mask up to rim cells away, share the least pixelID of all of them.

    Each tile labels what it holds. Only the cells at its edge go into a graph, with those of the next tile."""
    by = list(by)
    tiling = Tiling(grid, rim, side)

    def label(window: Window, group: dict, rows: pa.Table) -> pa.Table:
        mask = window.mask(window.at(rows["pixelID"]))
        whole = (grown(mask) if grown else mask)[window.core]
        root = labels(whole, directions)
        edge = np.zeros_like(whole)
        edge[[0, -1]] = edge[:, [0, -1]] = True
        own = mask[window.core]
        r, c = np.nonzero(own | (whole & edge))
        place = lambda a, b: window.pixels((a + window.core[0].start) * window.w + b + window.core[1].start)
        fixed = [pa.array([group[x]] * len(r), rows.schema.field(x).type) for x in by]
        return pa.Table.from_arrays([*fixed, pa.array(place(r, c)), pa.array(place(*np.divmod(root[r, c], whole.shape[1]))), pa.array(own[r, c]), pa.array(edge[r, c])], [*by, "pixelID", "root", "own", "edge"])

    wide = tiling.spread(cells.select(*by, "pixelID"))
    named = materialise(by_tile(wide, by, tiling, label, fields(wide, by, pixelID=T.LongType(), root=T.LongType(), own=T.BooleanType(), edge=T.BooleanType())))
    rims = named.where("edge").select(*by, "pixelID", "root")
    half = [s for s in (EIGHT if directions == 8 else FOUR) if s > (0, 0)]  # each pair of cells by one step
    out = neighbours(rims, grid, half).where(tiling.tile(F.col("pixelID")) != tiling.tile(F.col("to")))
    there = rims.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("pixelID").alias("__to"), F.col("root").alias("b"))
    met = out.join(there, [F.col("to") == F.col("__to"), *(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by)]).select(*by, F.col("root").alias("a"), "b").distinct()
    met = materialise(met)
    if met.isEmpty():  # no patch leaves its tile
        return named.where("own").select(*by, "pixelID", F.col("root").alias("patch"))
    return relabelled(named.where("own").select(*by, "pixelID", F.col("root").alias("patch")), met, grid, by)


def relabelled(labelled: DataFrame, met: DataFrame, grid: GridSpec, by: Sequence[str]) -> DataFrame:
    """Rows with (by, patch), a patch that met (by, a, b) connects to others getting the least of them as its label."""
    if grid.ncell >= 1 << CELL_BITS:
        raise ValueError(f"a grid of {grid.ncell} cells is too large to label")
    codes = numbers(met, by) if by else None
    coded = joined_by(met, codes, by) if by else met.withColumn("code", F.lit(0).cast("long"))
    node = lambda c: F.shiftleft("code", CELL_BITS) + F.col(c)
    roots = materialise(components(coded.select(node("a").alias("a"), node("b").alias("b"))))
    cell = lambda c: F.col(c).bitwiseAND(F.lit((1 << CELL_BITS) - 1))
    back = roots.select(F.shiftright("node", CELL_BITS).alias("code"), cell("node").alias("patch"), cell("root").alias("__least"))
    if by:
        back = back.join(codes, "code")
    back = materialise(back.select(*by, "patch", "__least"))  # its size is known: a small one is broadcast
    return joined_by(labelled, back, [*by, "patch"]).withColumn("patch", F.coalesce("__least", "patch")).drop("__least")


def numbers(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, code): the distinct keys, numbered from 1 in their order by range partitions; an error if codes and cells
    don't fit 64 bits together."""
    keys = df.select(F.struct(*by).alias("key"), F.lit(1).alias("n")).distinct()
    out = materialise(running_sums(keys, "key", ["n"]).select(*(F.col(f"key.{c}").alias(c) for c in by), F.col("upto_n").alias("code")))
    if out.where(F.col("code") >= 1 << (63 - CELL_BITS)).limit(1).count():
        raise ValueError(f"over {(1 << (63 - CELL_BITS)) - 1} groups of cells")
    return out


def reached(cells: DataFrame, radius: float, grid: GridSpec, by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """(by, pixelID, own): the distinct cells of each group of ``by`` whose centre is within radius of the centre of one of
    the group's cells; own says that the cell is itself one."""
    tiling = Tiling(grid, rim_of(radius, grid), side)

    def run(window: Window, group: dict, rows: pa.Table) -> pa.Table:
        mask = window.mask(window.at(rows["pixelID"]))
        near = np.flatnonzero(within(mask, radius, grid).ravel() & window.is_core)
        return pa.Table.from_arrays([*(pa.array([group[x]] * len(near), rows.schema.field(x).type) for x in by), pa.array(window.pixels(near)), pa.array(mask.ravel()[near])], [*by, "pixelID", "own"])

    wide = tiling.spread(cells.select(*by, "pixelID"))
    return by_tile(wide, list(by), tiling, run, fields(wide, by, pixelID=T.LongType(), own=T.BooleanType()))


def layers_of(at: np.ndarray) -> np.ndarray:
    """How many rows before this one have the same place."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(at) else np.zeros(0, bool)
    run = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)
    out = np.empty(len(at), np.int64)
    out[order] = run
    return out


def most_frequent(codes: np.ndarray) -> np.ndarray:
    """For each row of an array the value most frequent in it, of several the least; -1 counts for nothing and stands
    for a row of nothing else."""
    n, m = codes.shape
    if not n or not m:
        return np.full(n, -1)
    ordered = np.sort(codes, axis=1)
    start = np.ones((n, m), bool)
    start[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    length = np.arange(m) - np.maximum.accumulate(np.where(start, np.arange(m), 0), axis=1) + 1
    length[ordered < 0] = 0
    return np.take_along_axis(ordered, length.argmax(axis=1)[:, None], 1)[:, 0]
