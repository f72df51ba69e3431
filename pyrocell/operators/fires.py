"""Fire perimeters and ignition points: growth to an area target, moves onto burnable cells, loci."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pyrocell.functions.columns import as_integer, multiplier
from pyrocell.grid import EIGHT, GridSpec
from pyrocell.operators.components import least_roots
from pyrocell.operators.ranks import joined_by
from pyrocell.operators.spatial import nearest_cell_same_fire, nearest_to_centroid, neighbour_count
from pyrocell.operators.tables import burned_wins
from pyrocell.operators.tiles import SIDE, Tiling, Window, around, by_tile, connected, fields, labels, packed, reached, rim_of, within, within_square
from pyrocell.storage import materialise

KEY = ["year", "ids"]


def remove_outside(fires: DataFrame, flammable: DataFrame) -> DataFrame:
    """Drops the rows whose cell has no flammability value; 0 is a value."""
    return fires.join(flammable.where("flammable IS NOT NULL").select("pixelID"), "pixelID", "left_semi")


def fire_goal_size(fires: DataFrame, area: Callable[[Column], Column] = multiplier, min_size: float = 500) -> DataFrame:
    """year, ids, actualSize, goalSize = the integer of max(min_size, area(actualSize))."""
    n = fires.groupBy(*KEY).agg(F.count("*").alias("actualSize"))
    return n.withColumn("goalSize", as_integer(F.greatest(F.lit(float(min_size)), area(F.col("actualSize").cast("double")))))


def count_fires(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fires per year before and after a filter, and the difference."""
    a = before.groupBy("year").agg(F.countDistinct("ids").alias("before"))
    b = after.groupBy("year").agg(F.countDistinct("ids").alias("after"))
    out = a.join(b, "year", "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return out.withColumn("lost", F.col("before") - F.col("after"))


def trim_order(seed: int) -> Column:
    """A repeatable shuffle of cells."""
    return (F.col("pixelID") * 7919 + seed) % 104729


#: Rings that a job grows at most, cells around a tile that it sees, cells in a row that are dealt together.
BLOCK, REACH, RUN = 4, 32, 4096
#: Fires that may be broadcast.
FEW = 1 << 13
ROW = ["year", "ids", "pixelID", "ring", "goalSize"]
#: With the number of cells that the fire has.
LIVE = [*ROW, "size"]


def buffer_to_area(fires: DataFrame, grid: GridSpec, area: Callable[[Column], Column] = multiplier, min_size: float = 500, mask: DataFrame | None = None, resolve: bool = True, keep_unfinished: bool = False, seed: int = 0, rounds: int = 100, block: int = BLOCK, side: int = SIDE, reach: int = REACH) -> DataFrame:
    """Burned cells (year, ids, pixelID) grown ring by ring over eight neighbours until a fire exceeds its goal
    size, the last ring trimmed to hit it: year, pixelID, buffer (1 burned), ids. With a mask, through its cells
    alone. A fire that never exceeds its goal has no rows unless keep_unfinished. Finished fires leave the loop. A cell
    two fires reach in a round goes to the lower id; with ``resolve`` every cell ends with one fire of its year, burned
    before buffer.

    Fires grow up to ``block`` rings a job. Those that are over twice as many cells apart can't meet meanwhile, so fires are put in
    groups of what is nearer. A tile sees the cells within ``reach`` of it and grows the groups that begin in it and that it sees
    whole: most rows are dealt once a job, whatever the number of groups. What is left, such as one great fire or a chain of
    fires, grows ring by ring: in one ring a cell depends on the cells beside it alone. If most cells are in such groups, jobs
    get shorter; if one ring ends most fires, the first job is one. The mask goes to tiles as a bit a cell, packed once."""
    # a fire's cells stay together, so that few rows are sent to count them
    run = F.floor(F.col("pixelID") / RUN).alias("run")
    cells = fires.select(*KEY, "pixelID", run).where("pixelID IS NOT NULL").repartition("run").distinct()
    goals = fire_goal_size(cells, area, min_size)
    rows = materialise(cells.join(goals, KEY).select(*KEY, "pixelID", F.lit(0).alias("ring"), "goalSize", F.col("actualSize").alias("size"), (F.col("actualSize") > F.col("goalSize")).alias("over")))
    over, live, clock = [], rows.where("NOT over").select(*LIVE), 0
    if not rows.where("over").isEmpty():
        over.append(_trimmed(rows.where("over").select(*ROW), seed))
    bits = materialise(packed(mask.select("pixelID"), grid, side)) if mask is not None else None
    tiling = Tiling(grid, max(reach, 1), side)
    while clock < rounds and not live.where(F.col("ring") == clock).isEmpty():
        n = 1 if clock == 0 and _one_ring_does(live) else min(block, rounds - clock)
        left, done = live, []
        if n > 1:
            grown, left = _in_tiles(live, bits, clock, n, tiling, seed)
            if 2 * left.count() > live.count():
                block = n // 2
                continue
            done.append(grown)
        for ring in range(clock, clock + n):
            if left.isEmpty():
                break
            grown, torn = _in_tiles(left, bits, ring, 1, tiling, seed)
            stepped = grown if torn.isEmpty() else grown.unionByName(materialise(_judged(torn, seed)))
            done.append(stepped.where("over"))
            left = stepped.where("NOT over").select(*LIVE)
        grown = reduce(DataFrame.unionByName, [*done, left.withColumn("over", F.lit(False))])
        over.append(grown.where("over").select(*ROW))
        live, clock = grown.where("NOT over").select(*LIVE), clock + n
    kept = reduce(DataFrame.unionByName, [*over, (live if keep_unfinished else live.limit(0)).select(*ROW)])
    out = kept.select("year", "pixelID", (F.col("ring") == 0).cast("int").alias("buffer"), "ids")
    # dealt by cells alone, so that a join by cells which follows needs no shuffle
    return burned_wins(out.repartition("pixelID")).select("year", "pixelID", "buffer", "ids") if resolve else out


def _one_ring_does(live: DataFrame) -> bool:
    """Whether square fires of seven eighths of the cells would exceed their goals with one ring more."""
    over = (F.sqrt("size") + 2) ** 2 > F.col("goalSize")
    n, least = live.agg(F.count("*"), F.count(F.when(over, 1))).first()
    return 8 * least >= 7 * n


def _in_tiles(live: DataFrame, bits: DataFrame | None, clock: int, n: int, tiling: Tiling, seed: int) -> tuple[DataFrame, DataFrame]:
    """n rings of the fires that the tile of their least cell sees whole, with the group that they are in if n is over 1: their
    rows with ``over``, those of fires over their goal trimmed to it. And the rows of the others: as they were, or if n is 1
    with their new ones, sizes as they were."""
    rows, masked = tiling.spread(live), bits is not None
    if masked:
        here = around(bits, tiling).join(rows.select("tile").distinct(), "tile", "left_semi")
        rows = rows.unionByName(here, allowMissingColumns=True)
    flags = {"over": T.BooleanType(), "left": T.BooleanType(), "away": T.BooleanType()}

    def run(window: Window, _: dict, table: pa.Table) -> pa.Table:
        free = np.full((window.h, window.w), not masked)
        if masked:
            is_fire = table["ring"].is_valid()
            parts = table.filter(pc.invert(is_fire))
            for part, some in zip(parts["part"].to_pylist(), parts["bits"]):
                window.paste(part, some.as_py(), free)
            table = table.filter(is_fire)
        free = free.ravel()
        table = table.sort_by([("year", "ascending"), ("ids", "ascending")])
        years = pc.fill_null(table["year"].cast(pa.int64()), -(1 << 60)).to_numpy()
        out = [pa.Table.from_arrays([*(table[c].slice(0, 0) for c in LIVE), *([pa.array([], pa.bool_())] * 3)], [*LIVE, *flags])]
        for part in np.split(np.arange(len(years)), np.flatnonzero(np.diff(years)) + 1) if len(years) else []:
            out.append(_of_year(window, free, table.slice(int(part[0]), len(part)), clock, n, seed))
        return pa.concat_tables(out)

    seen = materialise(by_tile(rows, [], tiling, run, fields(live, LIVE, **flags)))
    left = seen.where("left").select(*LIVE)
    if not left.isEmpty():  # a tile can't tell of a fire it sees a part of whether another one sees it whole
        elsewhere = seen.where("away").select(*KEY, "away").distinct()
        left = materialise(joined_by(left, elsewhere, KEY).where("away IS NULL").select(*LIVE))
    return seen.where("NOT left").select(*LIVE, "over"), left


def _of_year(window: Window, free: np.ndarray, t: pa.Table, clock: int, n: int, seed: int) -> pa.Table:
    """What ``_in_tiles`` has of a year's rows, ordered by ids, in a window. ``left`` are cells of the tile, of fires that aren't known here
    to be seen whole by a tile; ``away`` are rows of fires seen whole with a cell that isn't the tile's."""
    names, fire = np.unique(t["ids"].to_numpy(), return_inverse=True)
    at, ring, first = window.at(t["pixelID"]), t["ring"].to_numpy(), np.flatnonzero(np.diff(fire, prepend=-1))
    goal, size = t["goalSize"].to_numpy().astype(np.int64)[first], t["size"].to_numpy()[first]
    part = labels(within_square(window.mask(at), n), 8).ravel()[at] if n > 1 else None
    own, left = _whole(window, at, fire, part, size, n)
    if n > 1:
        as_it_was = window.is_core[at] & left[fire]
        old = at[as_it_was], fire[as_it_was], ring[as_it_was]
        at, fire, ring = at[own[fire]], fire[own[fire]], ring[own[fire]]
    at, fire, ring = _rings(window, free, at, fire, ring, goal, clock, n)
    total = np.bincount(fire, minlength=len(names))
    away = np.bincount(fire[~window.is_core[at]], minlength=len(names)) > 0
    here = window.is_core[at] & left[fire]
    old = old if n > 1 else (at[here], fire[here], ring[here])
    at, fire, ring = (x[own[fire]] for x in (at, fire, ring))
    pixel, whole = window.pixels(at), np.where(own, total, 0)
    order = np.lexsort((pixel, (fire.astype(np.int64) * (clock + n + 1) + ring) * 104729 + (pixel * 7919 + seed) % 104729))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at)) - np.repeat(np.cumsum(whole) - whole, whole)
    keep = rank < goal[fire]
    pixel, by, ring = (np.concatenate(x) for x in ((pixel[keep], window.pixels(old[0])), (fire[keep], old[1]), (ring[keep], old[2])))
    columns = {"year": pa.repeat(t["year"][0], len(by)), "ids": names[by], "pixelID": pixel, "ring": ring, "goalSize": goal[by], "size": np.where(own, total, size)[by]}
    told = (own & (total > goal))[by], ~own[by], (own & away)[by]
    return pa.Table.from_arrays([*(pa.array(columns[c]).cast(t.schema.field(c).type) for c in LIVE), *map(pa.array, told)], [*LIVE, "over", "left", "away"])


def _whole(window: Window, at: np.ndarray, fire: np.ndarray, part: np.ndarray | None, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a year's fires, whose cells are ordered by fire: those that the window's tile sees whole and that begin in it, with the group of
    their parts if there are any; and those that are not known here to be so in another tile."""
    tiling, group = window.tiling, np.arange(len(size))  # of each fire
    first = np.flatnonzero(np.diff(fire, prepend=-1))
    if part is not None:
        root, part = np.unique(part, return_inverse=True)
        lead = part[first]
        apart = part != lead[fire]  # a fire of several parts is in one group
        group = least_roots(lead[fire][apart], part[apart], len(root))[lead]
    of, m = group[fire], int(group.max()) + 1
    torn = np.zeros(m, bool)
    torn[group[np.bincount(fire) < size]] = True
    row, col = np.divmod(at, window.w)
    ends = []
    for x, start in ((row, window.r0), (col, window.c0)):
        low, high = np.full(m, window.h * window.w), np.full(m, -1)
        np.minimum.at(low, of, x)
        np.maximum.at(high, of, x)
        ends += [low + start - n, high + start + n]
    begin = np.full(m, window.h * window.w - 1)
    np.minimum.at(begin, of, at)

    def fits(r: np.ndarray | int, c: np.ndarray | int) -> np.ndarray:
        """Groups that no cell can be in or beside that the tile from r and c on doesn't see."""
        ok = np.ones(m, bool)
        for low, high, start, length in ((*ends[:2], r, tiling.grid.nrow), (*ends[2:], c, tiling.grid.ncol)):
            lo, hi = start - tiling.rim, start + tiling.side + tiling.rim
            ok &= ((lo <= 0) | (low > lo + n)) & ((hi >= length) | (high < hi - n - 1))
        return ok

    r, c = (x // tiling.side * tiling.side for x in (begin // window.w + window.r0, begin % window.w + window.c0))
    mine = window.core[0].start + window.r0, window.core[1].start + window.c0
    sure = fits(*mine) & ~torn
    own = sure & (r == mine[0]) & (c == mine[1])
    return own[group], ~(own | (sure & fits(r, c)))[group]


def _rings(window: Window, free: np.ndarray, at: np.ndarray, fire: np.ndarray, ring: np.ndarray, goal: np.ndarray, clock: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of a year's fires after n more rings. Fires are numbered in the order of their ids."""
    taken = np.bincount(at, minlength=window.h * window.w)
    size, active = np.bincount(fire, minlength=len(goal)), np.ones(len(goal), bool)
    all_ = [(at, fire, ring)]
    for k in range(clock + 1, clock + n + 1):
        ended = active & (size > goal)
        active &= ~ended
        if ended.any():  # their cells are free again
            for a, f, _ in all_:
                np.subtract.at(taken, a[ended[f]], 1)
        a, f, r = all_[-1]
        front = (r == k - 1) & active[f]
        a, f = a[front], f[front]
        if not len(a):
            break
        y = a[:, None] // window.w + np.array([s for s, _ in EIGHT])
        x = a[:, None] % window.w + np.array([s for _, s in EIGHT])
        ok = ((y >= 0) & (y < window.h) & (x >= 0) & (x < window.w)).ravel()
        to, by = (y * window.w + x).ravel()[ok], np.repeat(f, len(EIGHT))[ok]
        ok = free[to] & (taken[to] == 0)
        to, by = to[ok], by[ok]
        order = np.lexsort((by, to))
        to, by = to[order], by[order]
        first = np.ones(len(to), bool)
        first[1:] = to[1:] != to[:-1]
        to, by = to[first], by[first]
        taken[to] += 1
        size += np.bincount(by, minlength=len(goal))
        all_.append((to, by, np.full(len(to), k, ring.dtype)))
    return tuple(np.concatenate(x) for x in zip(*all_))


def _judged(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with their fire's ``size`` and ``over``; fires over their goal are trimmed to it."""
    total = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("goalSize").alias("goal"))
    tagged = joined_by(rows.select(*ROW), total.select(*KEY, F.col("n").alias("size"), (F.col("n") > F.col("goal")).alias("over")), KEY)
    trimmed = _trimmed(tagged.where("over").select(*ROW), seed).withColumns({"size": F.col("goalSize").cast("long"), "over": F.lit(True)})
    return trimmed.unionByName(tagged.where("NOT over").select(*LIVE, "over"))


def _trimmed(rows: DataFrame, seed: int) -> DataFrame:
    """The first goalSize rows of each fire by ring and trim order. Rings and trim numbers are counted, and only the rows of
    the last ring with the last trim number are ranked: no window holds the rows of a fire."""
    counted = rows.withColumn("trim", trim_order(seed))
    per = counted.groupBy(*KEY, "goalSize", "ring", "trim").agg(F.count("*").alias("n"))
    by_ring = per.groupBy(*KEY, "goalSize", "ring").agg(F.sum("n").alias("of_ring"))
    earlier = W.partitionBy(*KEY).orderBy("ring").rowsBetween(W.unboundedPreceding, -1)
    by_ring = by_ring.withColumn("before", F.coalesce(F.sum("of_ring").over(earlier), F.lit(0)))
    last = by_ring.where((F.col("before") < F.col("goalSize")) & (F.col("before") + F.col("of_ring") >= F.col("goalSize"))).select(*KEY, F.col("ring").alias("last"), F.col("goalSize").alias("goal"), "before")
    inside = W.partitionBy(*KEY).orderBy("trim").rowsBetween(W.unboundedPreceding, -1)  # a row for each trim number
    of_last = joined_by(per.select(*KEY, "ring", "trim", "n"), last, KEY).where("ring = last").withColumn("upto", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    cut = of_last.where((F.col("upto") < F.col("goal")) & (F.col("upto") + F.col("n") >= F.col("goal"))).select(*KEY, "last", F.col("trim").alias("last_trim"), (F.col("goal") - F.col("upto")).alias("left"))
    placed = joined_by(counted, cut, KEY)
    whole = placed.where("ring < last OR (ring = last AND trim < last_trim)").select(*ROW)
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy("pixelID"))
    return whole.unionByName(placed.where("ring = last AND trim = last_trim").withColumn("k", rank).where("k <= left").select(*ROW))


def make_fire_ids(fires: DataFrame, grid: GridSpec, radius: float) -> DataFrame:
    """Burned cells (year, pixelID) with ids: cells whose surroundings within radius connect share an id, the least cell of
    those surroundings. The surroundings stay inside the tiles."""
    grown = connected(fires.select("year", "pixelID"), grid, 4, ["year"], lambda m: within(m, radius, grid), rim_of(radius, grid))
    return grown.select("year", "pixelID", F.col("patch").alias("ids"))


def raster_fire_buffers(fires: DataFrame, grid: GridSpec, radius: float, mask: DataFrame, min_size: float = 5000, area: Callable[[Column], Column] = multiplier) -> DataFrame:
    """Ids from connection, then growth through the mask, all years at once."""
    return buffer_to_area(make_fire_ids(fires, grid, radius), grid, area, min_size, mask, resolve=False)


def buffer_ignition_points(points: DataFrame, radius: float, grid: GridSpec) -> DataFrame:
    """Per year the cells within radius of an ignition cell, one row each, with ignited 0/1."""
    at = points.select("year", grid.cell_from_xy(F.col("x"), F.col("y")).alias("pixelID")).distinct()
    return reached(at, radius, grid, ["year"]).select("year", "pixelID", F.col("own").cast("int").alias("ignited"))


def raster_fire_spread_points(buffers: DataFrame, grid: GridSpec) -> DataFrame:
    """Per fire the burned cell nearest its centre: year, FIRE_ID, pixelID, size, POLY_HA."""
    at = nearest_to_centroid(buffers.where("buffer = 1"), grid)
    return at.select("year", F.col("ids").alias("FIRE_ID"), "pixelID", F.col("n").alias("size"), (F.col("n") * (grid.cell_area / 1e4)).alias("POLY_HA"))


def harmonize_buffer_and_points(points: DataFrame, buffers: DataFrame, mask: DataFrame, grid: GridSpec) -> DataFrame:
    """Points (point_id, year, ids, x, y) of fires that have a buffer, with pixelID. A point off every burned cell
    of its year moves to the nearest burned cell of its fire with over six burnable neighbours, else to the one
    with the most; ``moved`` says so."""
    burned = materialise(buffers.where("buffer = 1").select("year", "ids", "pixelID"))  # read four times
    kept = points.join(burned.select(*KEY).distinct(), KEY, "left_semi").withColumn("pixelID", grid.cell_from_xy(F.col("x"), F.col("y")))
    cells = burned.select("year", "pixelID").distinct().withColumn("on", F.lit(1))
    kept = materialise(kept.join(cells, ["year", "pixelID"], "left").select("point_id", *KEY, "x", "y", "pixelID", "on"))
    on = kept.where("on = 1")
    off = materialise(_unmatched(kept.where("on IS NULL OR point_id IS NULL"), on, "point_id").select("point_id", *KEY, "x", "y"))
    # only fires with a point to move are looked at
    mine = materialise(burned.join(materialise(off.select(*KEY).distinct()), KEY, "left_semi"))
    counted = materialise(mine.join(neighbour_count(mine, _beside(mask, mine, grid), grid, "flammable"), "pixelID"))
    most = counted.groupBy(*KEY).agg(F.max("n").alias("most"))
    fit = counted.join(most, KEY).where((F.col("n") > 6) | ((F.col("most") <= 6) & (F.col("n") == F.col("most"))))
    moved = nearest_cell_same_fire(off, fit, grid).select("point_id", *KEY, "pixelID", F.lit(1).alias("moved"))
    return on.select("point_id", *KEY, "pixelID", F.lit(0).alias("moved")).unionByName(moved)


def _unmatched(some: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows of some whose key is in no row of others, as an anti join has them, if few rows of some are likely: others are first
    cut to those that matter."""
    some = materialise(some)
    matched = materialise(others.join(some.select(key), key, "left_semi").select(key))
    return some.join(matched, key, "left_anti")


def _beside(mask: DataFrame, cells: DataFrame, grid: GridSpec, side: int = 16) -> DataFrame:
    """Rows of a mask in the blocks of cells that the given ones or their neighbours are in."""
    tiling = Tiling(grid, 1, side)
    blocks = materialise(tiling.spread(cells.select("pixelID")).select("tile").distinct())
    return mask.withColumn("tile", tiling.tile(F.col("pixelID"))).join(blocks, "tile", "left_semi").drop("tile")


def clean_up_spread_points(points: DataFrame, buffers: DataFrame, flammable: DataFrame, grid: GridSpec) -> tuple[DataFrame, DataFrame]:
    """Points (point_id, year, ids, x, y) on a non-flammable cell move to the nearest flammable burned cell of their
    fire; fires without one lose points and buffer rows. Returns (points with pixelID, buffers)."""
    good = flammable.where("flammable > 0").select("pixelID")
    at = points.withColumn("pixelID", grid.cell_from_xy(F.col("x"), F.col("y")))
    at = materialise(at.join(good.distinct().withColumn("good", F.lit(1)), "pixelID", "left"))
    stay, bad = at.where("good = 1").select("point_id", *KEY, "pixelID"), at.where("good IS NULL").drop("good")
    # only fires with a point to move are looked at
    asked = materialise(bad.select(*KEY).distinct())
    asked = asked.hint("shuffle_hash") if asked.count() > FEW else asked  # cells needn't be sorted to find those of some fires
    burnable = buffers.where("buffer = 1").join(asked, KEY, "left_semi").join(good, "pixelID", "left_semi")
    moved = materialise(nearest_cell_same_fire(bad.drop("pixelID"), burnable, grid).select("point_id", *KEY, "pixelID"))
    lost = materialise(bad.join(moved.select("point_id"), "point_id", "left_anti").select(*KEY).distinct())
    return stay.join(lost, KEY, "left_anti").unionByName(moved.join(lost, KEY, "left_anti")), buffers.join(lost, KEY, "left_anti")


def harmonize_fire_data(fires: DataFrame, points: DataFrame, flammable: DataFrame, grid: GridSpec, area: Callable[[Column], Column] = multiplier, min_size: float = 500) -> tuple[DataFrame, DataFrame]:
    """(buffers, points): fires buffered, cut to the grid's data, points moved onto them; raises unless the fires of
    both agree in number in every year."""
    buffers = materialise(remove_outside(buffer_to_area(fires, grid, area, min_size), flammable))
    years = buffers.select("year").distinct()
    placed = materialise(harmonize_buffer_and_points(points.join(years, "year", "left_semi"), buffers, flammable, grid))
    here = placed.select("point_id", *KEY, grid.x(F.col("pixelID")).alias("x"), grid.y(F.col("pixelID")).alias("y"))
    cleaned, buffers = clean_up_spread_points(here, buffers, flammable, grid)
    cleaned = materialise(cleaned)
    # fires without a point are likely few: rows of the others needn't be shuffled to be kept
    known = materialise(buffers.dropna(subset=KEY).select(*KEY).distinct())
    bare = materialise(known.join(cleaned.select(*KEY).distinct(), KEY, "left_anti"))
    buffers = materialise(buffers.dropna(subset=KEY).join(bare, KEY, "left_anti"))
    off = count_fires(cleaned, known.join(bare, KEY, "left_anti")).where("lost <> 0").limit(1).count()
    if off:
        raise ValueError("points and buffers differ in their number of fires")
    return buffers, cleaned


def make_loci(points: DataFrame, grid: GridSpec, unit: str = "ha", prefix: str = "year") -> DataFrame:
    """cells, size in pixels (half to even), date token and ids of points (ids, year, size, x, y)."""
    divisors = {"ha": 1e4, "m2": 1.0}
    if unit not in divisors:
        raise ValueError(f"unit must be ha or m2, not {unit}")
    size = F.bround(F.col("size") / F.lit(grid.cell_area / divisors[unit]))
    return points.select(size.alias("size"), F.concat(F.lit(prefix), F.col("year").cast("string")).alias("date"), "ids", grid.cell_from_xy(F.col("x"), F.col("y")).alias("cells"))
