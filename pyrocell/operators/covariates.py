"""Covariate pipelines: cohorts, land cover, age and climate to model-ready pixel tables."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyrocell.functions.columns import as_integer, from_x1000, log_min_b, logistic_all, make_mutually_exclusive, rescale_by_magnitude, rescale_known2
from pyrocell.grid import GridSpec, steps_within
from pyrocell.operators.spatial import block_of, focal_mean_fill, rasterize
from pyrocell.operators.tables import asof_period, expand_cohorts_to_pixels, lookup_keep_right, one_hot, years_between
from pyrocell.operators.tiles import Tiling, Window, by_tile, fields, rim_of

# land cover


def make_lcc(src: DataFrame, grid: GridSpec, fact: int, nonflammable: Sequence[int], threshold: float = 0.1) -> DataFrame:
    """(block, lcc, flammableProp): dominant flammable class of a block (ties to the lowest), 0 below the threshold."""
    flag = F.when(F.col("lcc").isNotNull(), (~F.col("lcc").isin(*nonflammable)).cast("int"))
    agg = src.groupBy(block_of(grid, fact, F.col("pixelID")).alias("block")).agg(F.mode(F.when(flag == 1, F.col("lcc")), True).alias("lcc"), F.avg(flag).alias("p"))
    lcc = F.when(F.col("p") < threshold, F.lit(0)).otherwise(F.col("lcc"))
    return agg.select("block", lcc.alias("lcc"), F.when(lcc.isNotNull(), F.col("p")).alias("flammableProp"))


def make_landcover(cells: DataFrame, groups: Mapping[str, Sequence[int]]) -> DataFrame:
    """One row per flammable pixel of a class other than 0, a 0/1 column per named group."""
    kept = cells.where((F.col("lcc") != 0) & (F.col("flammable") == 1)).select("pixelID", "lcc")
    return one_hot(kept, "lcc", groups).drop("lcc")


# cohorts


def cast_cohort_data(cohort: DataFrame, pixel_groups: DataFrame, landcover: DataFrame, species: Sequence[str], missing_lcc: str, age_map: DataFrame | None = None, year: int | None = None, cutoff: int = 15) -> DataFrame:
    """Land-cover pixels with B per species and youngAge. A pixel without a group and without a non-forest class
    gets the missing class; stand age comes from the age map where no cohort gives one. Species columns stay null
    for pixels without cohorts."""
    sums = (F.coalesce(F.sum(F.when(F.col("speciesCode") == s, F.col("B"))), F.lit(0.0)).alias(s) for s in species)
    wide = cohort.groupBy("pixelGroup").agg(F.max("age").alias("standAge"), *sums)
    pixels = lookup_keep_right(wide, pixel_groups.select("pixelID", "pixelGroup"), ["pixelGroup"])
    out = landcover.join(pixels, "pixelID", "left")
    classes = [c for c in landcover.columns if c != "pixelID"]
    bare = F.col("pixelGroup").isNull() & (reduce(lambda a, b: a + b, (F.col(c) for c in classes)) == 0)
    out = out.withColumn(missing_lcc, F.when(bare, F.lit(1)).otherwise(F.col(missing_lcc)))
    if age_map is not None:
        out = out.join(age_map.select("pixelID", F.col("age").alias("__age")), "pixelID", "left").withColumn("standAge", F.coalesce("standAge", "__age")).drop("__age")
    out = out.withColumn("youngAge", (F.col("standAge") <= cutoff).cast("int"))
    out = out.drop("standAge", "pixelGroup")
    return out.withColumn("year", F.lit(year)) if year is not None else out


def biomass_by_class(cohort: DataFrame) -> DataFrame:
    """(FuelClass, pixelGroup, B): integer sum; the young class becomes 1."""
    b = cohort.groupBy("FuelClass", "pixelGroup").agg(as_integer(F.sum("B")).alias("B"))
    return b.withColumn("B", F.when(F.col("FuelClass") == "youngAge", 1).otherwise(F.col("B")))


def cohorts_to_fuel_classes(cohort: DataFrame, pixel_groups: DataFrame, flammable: DataFrame, landcover: DataFrame, equivalence: DataFrame, classes: Sequence[str], cutoff: int = 15) -> DataFrame:
    """(pixelID, class layers): biomass per fuel class, 0 where flammability is known and none grows, 0 on
    non-forest pixels; groups no older than the cutoff count as youngAge alone."""
    layers = [*classes, *([] if "youngAge" in classes else ["youngAge"])]
    known = cohort.join(F.broadcast(equivalence.select("speciesCode", "FuelClass").distinct()), "speciesCode")
    oldest = cohort.groupBy("pixelGroup").agg(F.max("age").alias("maxAge"))
    aged = known.join(oldest, "pixelGroup").withColumn("FuelClass", F.when(F.col("maxAge") <= cutoff, "youngAge").otherwise(F.col("FuelClass")))
    wide = biomass_by_class(aged).groupBy("pixelGroup").pivot("FuelClass", layers).agg(F.max("B"))
    out = flammable.select("pixelID", "flammable").join(pixel_groups.select("pixelID", "pixelGroup"), "pixelID", "left").join(wide, "pixelGroup", "left")
    bare = landcover.select("pixelID", reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) for c in landcover.columns if c != "pixelID")).alias("__nf"))
    out = out.join(bare, "pixelID", "left")
    value = lambda c: F.when(F.col("__nf") > 0, 0).otherwise(F.coalesce(F.col(c), F.when(F.col("flammable").isNotNull(), 0)))
    return out.select("pixelID", *(value(c).alias(c) for c in layers))


def cohort_burn_history(cohort: DataFrame, pixels: DataFrame, burned: DataFrame, lo: int, hi: int) -> DataFrame:
    """Cohort rows per pixel with the earliest burn year of the window (pixelID, burnYear), null if none."""
    first = burned.where(F.col("burnYear").between(lo, hi)).groupBy("pixelID").agg(F.min("burnYear").alias("burnYear"))
    return expand_cohorts_to_pixels(cohort, pixels.select("pixelID", "pixelGroup")).join(first, "pixelID", "left")


def fuel_class_prep(cohort: DataFrame, cells: DataFrame, burned: DataFrame, nonflammable: Sequence[int], nonforest: Sequence[int], lo: int, hi: int) -> DataFrame:
    """Land cover but nonflammable classes, with cohorts by pixel and burned 0/1 in the window; non-forest classes
    have no species; year is the window's start."""
    kept = cells.where(~F.col("lcc").isin(*nonflammable)).select("pixelID", "lcc", "pixelGroup")
    out = kept.join(cohort.select("pixelGroup", "speciesCode", "B"), "pixelGroup", "left")
    first = burned.where(F.col("burnYear").between(lo, hi)).select("pixelID").distinct().withColumn("__b", F.lit(1))
    out = out.join(first, "pixelID", "left")
    species = F.when(F.col("lcc").isin(*nonforest), F.lit(None)).otherwise(F.col("speciesCode"))
    return out.select("pixelID", "lcc", species.alias("speciesCode"), "B", F.coalesce("__b", F.lit(0)).alias("burned"), F.lit(lo).alias("year"))


# age


def make_tsd(cells: DataFrame, year: int, cutoff: int = 15, polygons: DataFrame | None = None, grid: GridSpec | None = None, lcc: DataFrame | None = None) -> DataFrame:
    """(pixelID, tsd) of cells (pixelID, age): time since the last fire before ``year``.

    Fires: the column fireYear, where a year after ``year`` counts as not young; else the polygons (poly_id, YEAR, seq, x, y)
    of the cutoff + 2 years before ``year``, the latest of a cell, and on cells with an age that none covers the
    year cutoff + 1 before. Without either it is an error. Pixels to update, the column update, that are young or
    ageless become cutoff + 1, then a fire within the cutoff sets their age. Pixels that aren't flammable have no value.
    Where cells lack them, update and flammable come from ``lcc`` (pixelID, classes): some class present, a row."""
    if "fireYear" not in cells.columns:
        if polygons is None or grid is None:
            raise ValueError("please provide fire polygons or a raster of fire years (fireYear)")
        burned = rasterize(years_between(polygons, year - cutoff - 2, year - 1, "YEAR"), grid, "YEAR", "max").withColumnRenamed("YEAR", "__fire")
        fire = F.when(F.col("age").isNotNull(), F.coalesce("__fire", F.lit(year - cutoff - 1)))
        cells = cells.join(burned, "pixelID", "left").withColumn("fireYear", fire).drop("__fire")
    lacking = [c for c in ("update", "flammable") if c not in cells.columns]
    if lacking:
        if lcc is None:
            raise ValueError(f"cells lack {', '.join(lacking)} and there is no lcc to take them from")
        known = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in lcc.columns if c != "pixelID"), F.lit(0.0))
        flags = lcc.select("pixelID", known.alias("__sum")).groupBy("pixelID").agg(F.max("__sum").alias("__sum"))
        derived = {"update": F.coalesce(F.col("__sum") > 0, F.lit(False)), "flammable": F.col("__sum").isNotNull().cast("int")}
        cells = cells.join(flags, "pixelID", "left").withColumns({c: derived[c] for c in lacking}).drop("__sum")
    tsd = F.when(F.col("fireYear") > year, cutoff + 1).otherwise(year - F.col("fireYear"))
    old = F.when(F.col("age").isNull() | (F.col("age") <= cutoff), cutoff + 1).otherwise(F.col("age"))
    now = F.when(F.col("update"), F.when(tsd <= cutoff, tsd).otherwise(old)).otherwise(F.col("age"))
    return cells.select("pixelID", F.when(F.col("flammable") == 1, now).cast("int").alias("tsd"))


def age_since_last_burn(years: Sequence[int], cells: DataFrame, burned: DataFrame) -> DataFrame:
    """The cells once per year, with year, k and j: the year's place in the order of years, and that of the pixel's last
    burn before it. A pixel's burns become one short array of places, so one aggregate and one join suffice."""
    place = F.array_position(F.array(*map(F.lit, years)), F.col("year").cast("int")).cast("int") - 1
    hit = burned.where(F.col("year").isin(*years)).groupBy("pixelID").agg(F.collect_set(place).alias("burns"))
    each = F.explode(F.array(*(F.struct(F.lit(y).alias("year"), F.lit(k).alias("k")) for k, y in enumerate(years)))).alias("at")
    rows = cells.join(hit, "pixelID", "left").select(*cells.columns, "burns", each)
    return rows.select(*cells.columns, "at.year", "at.k", F.array_max(F.filter("burns", lambda b: b < F.col("at.k"))).alias("j"))


def calc_young_age(years: Sequence[int], cells: DataFrame, burned: DataFrame, cutoff: int = 15) -> DataFrame:
    """(pixelID, year, youngAge): with k the year's place and j the last burn before it, age is k - j, else age + k;
    a pixel without age is young until its age is known by a burn."""
    aged = age_since_last_burn(years, cells.select("pixelID", "age"), burned)
    now = F.coalesce(F.col("k") - F.col("j"), F.col("age") + F.col("k"))
    return aged.select("pixelID", "year", F.coalesce(now <= cutoff, F.lit(True)).cast("int").alias("youngAge"))


def calc_nonforest_young_age(landcover: DataFrame, tsd: DataFrame, layers: DataFrame, cutoff: int = 15) -> DataFrame:
    """Layers set to 0 on young (age < cutoff) non-forest pixels, and youngAge 1 there, 0 elsewhere, null where the
    first layer is null."""
    classes, names = [c for c in landcover.columns if c != "pixelID"], [c for c in layers.columns if c not in ("pixelID", "youngAge")]
    out = layers.join(landcover, "pixelID", "left").join(tsd, "pixelID", "left")
    young = F.coalesce((reduce(lambda a, b: a + b, (F.col(c) for c in classes)) > 0) & (F.col("tsd") < cutoff), F.lit(False))
    first = F.col(names[0])
    return out.select("pixelID", *(F.when(young, 0).otherwise(F.col(c)).alias(c) for c in names), F.when(young, 1).when(first.isNotNull(), 0).alias("youngAge"))


# composites


def covariates_create(fuel: DataFrame, landcover: DataFrame, classes: Sequence[str], exclusive: Mapping[str, Sequence[str]], missing_group: str, tsd: DataFrame | None = None, cutoff: int = 15) -> DataFrame:
    """Land-cover pixels with fuel layers: fails on a null layer, rows of zeros get the missing group, exclusive
    columns are zeroed, class biomass goes to log scale, young non-forest pixels become youngAge."""
    groups = [c for c in landcover.columns if c != "pixelID"]
    out = landcover.join(fuel, "pixelID", "left")
    cols = [*classes, "youngAge", *groups]
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in cols))
    out = out.withColumn("youngAge", F.when(missing, F.raise_error(F.lit("a covariate is null")).cast("int")).otherwise(F.col("youngAge")))
    empty = reduce(lambda a, b: a + b, (F.col(c) for c in cols)) == 0
    out = out.withColumn(missing_group, F.when(empty, 1).otherwise(F.col(missing_group)))
    out = make_mutually_exclusive(out, exclusive)
    out = out.withColumns({c: log_min_b(F.col(c)) for c in classes})
    if tsd is not None:
        out = out.join(tsd, "pixelID", "left")
        young = (F.col("tsd") <= cutoff) & (reduce(lambda a, b: a + b, (F.col(g) for g in groups)) > 0)
        out = out.withColumn("youngAge", F.when(young, 1).otherwise(F.col("youngAge"))).drop("tsd")
    return out


def ignitions_per_cell(points: DataFrame, cells: DataFrame, by: Sequence[str] = ("pixelID", "year")) -> DataFrame:
    """cells with the number of points in each, 0 if none."""
    n = points.groupBy(*by).agg(F.count("*").alias("ignitions"))
    return cells.join(n, list(by), "left").withColumn("ignitions", F.coalesce("ignitions", F.lit(0)))


def stack_and_extract(climate: DataFrame, static: DataFrame, points: DataFrame | None, years: Sequence[int]) -> DataFrame:
    """Climate of the years with the static layers, complete rows only, ignitions counted (0 without points)."""
    rows = climate.where(F.col("year").isin(*years)).join(static, "pixelID").dropna("any")
    return ignitions_per_cell(points, rows) if points is not None else rows.withColumn("ignitions", F.lit(0).cast("long"))


def merge_prepared_covs(parts: Sequence[DataFrame], cover: Sequence[str], climate: Sequence[str], lightning: DataFrame | None = None) -> DataFrame:
    """The periods' tables together, rows of no cover dropped, lightning joined; keys and climate come first. Each part joins by
    itself, so that tables bucketed by pixelID (``sources.tables.write_bucketed``) meet without a shuffle."""
    parts = [p.where(reduce(lambda a, b: a + b, (F.col(c) for c in cover)) > 0) for p in parts]
    out = reduce(lambda a, b: a.unionByName(b), (p.join(lightning, "pixelID") if lightning is not None else p for p in parts))
    first = ["pixelID", "year", "ignitions", *climate, "youngAge"]
    return out.select(*first, *(c for c in out.columns if c not in first))


def coarse(df: DataFrame, grid: GridSpec, fact: int, cols: Sequence[str], by: Sequence[str] = (), na_rm: bool = False) -> DataFrame:
    """Block means of several layers in one aggregate."""
    n = fact * fact
    means = [(F.avg(c) if na_rm else F.when(F.count(c) == n, F.avg(c))).alias(c) for c in cols]
    return df.groupBy(*by, block_of(grid, fact, F.col("pixelID")).alias("block")).agg(*means)


def lightning_grid(points: DataFrame, grid: GridSpec, coarse_grid: GridSpec, value: str) -> DataFrame:
    """Density on the coarse grid (the lowest row id of a cell counts), nulls filled from around, for every cell of
    the fine grid by the coarse cell its centre is in."""
    at = points.withColumn("pixelID", coarse_grid.cell_from_xy(F.col("x"), F.col("y"))).where("pixelID IS NOT NULL")
    one = at.groupBy("pixelID").agg(F.min_by(value, "point_id").alias(value))
    spark = points.sparkSession
    every = spark.range(1, coarse_grid.ncell + 1).withColumnRenamed("id", "pixelID").join(one, "pixelID", "left")
    filled = focal_mean_fill(every, coarse_grid, value).withColumnRenamed("pixelID", "big")
    cells = spark.range(1, grid.ncell + 1).withColumnRenamed("id", "pixelID")
    return cells.withColumn("big", coarse_grid.cell_from_xy(grid.x(F.col("pixelID")), grid.y(F.col("pixelID")))).join(filled, "big", "left").select("pixelID", value)


def rescale_covariates(df: DataFrame, algorithm: str, keep: Sequence[str] = ("yearChar", "ignitions", "escapes")) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """xgb: z-scores of every other column, with (centre, scale); else: columns whose maximum is outside [0, 10]
    divided by the power of ten at or below it, with (0, divisor). One aggregate row reaches the driver."""
    cols = [c for c, t in df.dtypes if c not in keep and t != "string"]
    if algorithm == "xgb":
        r = df.agg(*(x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}")))).first()
        scales = {c: (r[f"m_{c}"], r[f"s_{c}"]) for c in cols}
        return df.withColumns({c: F.try_divide(F.col(c) - F.lit(m), F.lit(s)) for c, (m, s) in scales.items()}), scales
    cols = [c for c in cols if c not in ("pixelID", "year", "yr")]
    r = df.agg(*(F.max(c).cast("double").alias(c) for c in cols)).first()
    scales = {c: (0.0, 10.0 ** math.floor(math.log10(abs(r[c])))) for c in cols if r[c] is not None and r[c] != 0 and not 0 <= r[c] <= 10}
    return rescale_by_magnitude(df, {c: s for c, (_, s) in scales.items()}), scales


def spread_covariates(annual: DataFrame, non_annual: DataFrame, ranges: Mapping[str, tuple[float, float]], exclusive: Mapping[str, Sequence[str]], check: bool = True) -> DataFrame:
    """Annual fixed-point covariates with those of the period in force, rescaled to [0, 1] by the ranges (x 1000),
    exclusive columns zeroed. With ``check`` a covariate outside [0, 1] is an error: one aggregate."""
    joined = asof_period(annual, non_annual.select("start").distinct()).join(non_annual, ["start", "pixelID"])
    scaled = joined.withColumns({c: rescale_known2(F.col(c).cast("double"), 0.0, 1000.0, lo * 1000.0, hi * 1000.0) for c, (lo, hi) in ranges.items()})
    out = from_x1000(make_mutually_exclusive(scaled, exclusive), list(ranges))
    return check_unit_range(out, list(ranges)) if check else out


def check_unit_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """df if every column lies in [0, 1] at three decimals; one aggregate row; raises else."""
    r = df.agg(*(x for c in cols for x in (F.round(F.min(c), 3).alias(f"lo_{c}"), F.round(F.max(c), 3).alias(f"hi_{c}")))).first()
    bad = [c for c in cols if r[f"lo_{c}"] is not None and (r[f"lo_{c}"] < 0 or r[f"hi_{c}"] > 1)]
    if bad:
        raise ValueError(f"rescaled covariates outside [0, 1]: {', '.join(bad)}")
    return df


def spread_probability(covs: DataFrame, names: Sequence[str], logistic: Sequence[float], coefs: Sequence[float], lower: float = 0.1, max_spread: float = 0.28) -> DataFrame:
    """Adds spreadProb; warns if the first logistic parameter, the highest value, is over ``max_spread``."""
    if logistic[0] > max_spread:
        warnings.warn(f"the first parameter of the logistic, {logistic[0]}, is over {max_spread} and should be lowered", stacklevel=2)
    return covs.withColumn("spreadProb", logistic_all([F.col(c) for c in names], logistic, coefs, lower))


def predict_ignition(df: DataFrame, response: Column, rescale: float, lambda_rescale: float) -> DataFrame:
    """A model's response times both factors; null where the response is null."""
    return df.withColumn("ignition", response * F.lit(float(rescale)) * F.lit(float(lambda_rescale)))


def mean_around_points(points: DataFrame, layer: DataFrame, radius: float, grid: GridSpec, col: str) -> DataFrame:
    """Mean of a layer over the cells within radius of each point's cell; null if their values are, no row for a point
    without a cell there. The distinct cells of the points are looked up in tiles."""
    at = points.select("point_id", grid.cell_from_xy(F.col("x"), F.col("y")).alias("pixelID")).where("pixelID IS NOT NULL")
    tiling, steps = Tiling(grid, rim_of(radius, grid)), np.array(steps_within(grid, radius))

    def means(window: Window, _: dict, rows: pa.Table) -> pa.Table:
        place, value, k = window.at(rows["pixelID"]), rows["__v"], tiling.rim
        known = value.is_valid().to_numpy()
        of_layer = ~rows["__asked"].to_numpy()
        total, n, there = (np.pad(x, k).ravel() for x in (window.sums(place[known], value.drop_null().to_numpy()), window.sums(place[known]), window.sums(place[of_layer])))
        asked = np.flatnonzero(window.mask(place[~of_layer]).ravel())
        width = window.w + 2 * k
        middle = (asked // window.w + k) * width + asked % window.w + k
        sums, counts, cells = np.zeros((3, len(asked)))
        for step in (steps @ [width, 1]).tolist():
            sums += total[middle + step]
            counts += n[middle + step]
            cells += there[middle + step]
        some = cells > 0
        mean = pa.array(sums[some] / np.maximum(counts[some], 1), mask=counts[some] == 0)
        return pa.Table.from_arrays([pa.array(window.pixels(asked[some])), mean], ["pixelID", col])

    wanted = at.select("pixelID", F.lit(None).cast("double").alias("__v"), F.lit(True).alias("__asked")).distinct().withColumn("tile", tiling.tile(F.col("pixelID")))
    layer_ = tiling.spread(layer.select("pixelID", F.col(col).cast("double").alias("__v"), F.lit(False).alias("__asked")))
    found = by_tile(wanted.unionByName(layer_), [], tiling, means, fields(layer, [], pixelID=T.LongType(), **{col: T.DoubleType()}))
    return at.join(found, "pixelID").select("point_id", col)
