"""Joins, filters, reshapes, windows and set operations on pixel tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyrocell.functions.columns import as_integer, to_x1000, token_from_year, year_from_token

# joins and filters


def lookup_keep_right(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of y with x's columns, null where x has none. Rows of a null key, which match nothing, stay out of the
    shuffle, where they would all meet in one task."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return y.where(known).join(x, list(keys), "left").unionByName(y.where(~known), allowMissingColumns=True)


def anti_join(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> DataFrame:
    return x.join(y.select(*keys).distinct(), list(keys), "left_anti")


def semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def not_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ids; null keys stay, as no id equals null."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def update_from(df: DataFrame, other: DataFrame, key: str, col: str) -> DataFrame:
    """df with col taken from other; null where other has no row."""
    return df.drop(col).join(other.select(key, col), key, "left")


def inner_join(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> DataFrame:
    return x.join(y, list(keys))


merge_on = inner_join


def expand_cohorts_to_pixels(cohort: DataFrame, pixels: DataFrame) -> DataFrame:
    """A row per pixel and cohort of its group; large groups are split by the adaptive skew join."""
    return pixels.join(cohort, "pixelGroup")


def asof_period(df: DataFrame, periods: DataFrame) -> DataFrame:
    """df (year, ...) with the columns of the period (start, ...) of greatest start at or before its year.

    The choice is made once per year of df, a small dimension, and joined back."""
    years = df.select("year").distinct()
    starts = periods.select("start").distinct()
    chosen = years.join(F.broadcast(starts), F.col("start") <= F.col("year")).groupBy("year").agg(F.max("start").alias("start"))
    return df.join(chosen, "year")


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def years_between(df: DataFrame, lo: int, hi: int, col: str = "year") -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


# reshapes


def climate_to_long(layers: Mapping[str, DataFrame], index: DataFrame | None = None) -> DataFrame:
    """Wide year layers of each variable to (pixelID, year, variables); variables meet on pixel and year."""
    out = []
    for var, df in layers.items():
        years = [c for c in df.columns if c != "pixelID"]
        df = df.join(index.select("pixelID").distinct(), "pixelID", "left_semi") if index is not None else df
        long = df.unpivot("pixelID", years, "token", "v")
        out.append(long.select("pixelID", year_from_token(F.col("token")).alias("year"), as_integer(F.col("v")).alias(var)))
    return reduce(lambda a, b: a.join(b, ["pixelID", "year"]), out)


def pivot_cohorts(df: DataFrame, species: Sequence[str]) -> DataFrame:
    """Sum of B per (pixelGroup, standAge) and species, 0 where absent."""
    return df.groupBy("pixelGroup", "standAge").pivot("speciesCode", list(species)).agg(F.sum("B")).na.fill(0, list(species))


def one_hot(df: DataFrame, col: str, groups: Mapping[str, Sequence[int]]) -> DataFrame:
    """A 0/1 column per named group of classes."""
    return df.withColumns({g: F.coalesce(F.col(col).isin(*classes).cast("int"), F.lit(0)) for g, classes in groups.items()})


def covs_x1000(annual: DataFrame, non_annual: DataFrame, buffered: DataFrame, loci: DataFrame, order: Sequence[str], inverse: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both covariate tables in fixed point with columns in parameter order; fire tables pass through."""
    if inverse:
        raise NotImplementedError("the inverse direction is not yet implemented")

    def ordered(df: DataFrame) -> DataFrame:
        keys = [c for c in ("year", "pixelID") if c in df.columns]
        mine = [c for c in order if c in df.columns]
        rest = [c for c in df.columns if c not in keys and c not in mine]
        return to_x1000(df.select(*keys, *mine, *rest), omit=keys)

    return ordered(annual), ordered(non_annual), buffered, loci


def segregate(df: DataFrame, layer: str, classes: Sequence[int], omit: Sequence[int] = ()) -> DataFrame:
    """A 0/1 layer per class, in numeric order, named layer.class; null stays null."""
    kept = sorted(c for c in classes if c not in omit)
    return df.select("pixelID", *((F.col(layer) == c).cast("int").alias(f"{layer}_{c}") for c in kept))


def put_back_into_raster(layers: Sequence[str], landcover: DataFrame, template: DataFrame, value: str) -> DataFrame:
    """Per layer: 0 on template cells with data, the layer's value where landcover lists the pixel."""
    all_ = template.select("pixelID", F.col(value).alias("__t")).join(landcover.select("pixelID", *layers), "pixelID", "left")
    return all_.select("pixelID", *(F.coalesce(F.col(c), F.when(F.col("__t").isNotNull(), 0)).alias(c) for c in layers))


def population_long(pop: DataFrame, par: str, terms: Sequence[str]) -> DataFrame:
    """(iter, member, variable, value) of an array of parameters."""
    each = pop.select("iter", "member", F.posexplode(par).alias("i", "value"))
    return each.select("iter", "member", F.element_at(F.array(*map(F.lit, terms)), F.col("i") + 1).alias("variable"), "value")


def split_by_year(df: DataFrame) -> DataFrame:
    """The year as a layer token; one table in place of a list of tables."""
    return df.withColumn("token", token_from_year(F.col("year")))


# windows


def group_max_age(cohort: DataFrame) -> DataFrame:
    return cohort.withColumn("maxAge", F.max("age").over(W.partitionBy("pixelGroup")))


def group_size(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows per key, on every row; by an aggregate joined back, so a hot key is no hot window."""
    return df.join(df.groupBy(*([key] if isinstance(key, str) else key)).agg(F.count("*").alias("N")), key, "left")


def burned_wins(fires: DataFrame, keys: Sequence[str] = ("year", "pixelID")) -> DataFrame:
    """One row per pixel: burned (buffer 1) before buffer (0), then the lowest id. Plain numbers are aggregated, by hash and
    without a sort."""
    of = lambda b: F.min(F.when(b, F.col("ids")))
    top = F.max("buffer")
    ids = F.when(top == 1, of(F.col("buffer") == 1)).when(top == 0, of(F.col("buffer") == 0)).otherwise(of(F.col("buffer").isNull()))
    return fires.groupBy(*keys).agg(top.alias("buffer"), ids.alias("ids"))


def dedupe_start_pixels(fires: DataFrame, cell: str = "cells", order: Column | None = None) -> DataFrame:
    """One fire per cell, the largest; ties keep the first."""
    w = W.partitionBy(cell).orderBy(F.col("size").desc(), order if order is not None else F.col("ids"))
    return fires.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def largest_years(fires: DataFrame, n: int = 2) -> DataFrame:
    """(year, total, largest): the n years of most burned pixels against the rest; ties to the earlier year."""
    totals = fires.groupBy("year").agg(F.sum("size").alias("total"))
    top = totals.orderBy(F.col("total").desc(), "year").limit(n).select("year", F.lit(1).alias("largest"))
    return totals.join(F.broadcast(top), "year", "left").withColumn("largest", F.coalesce("largest", F.lit(0)))


def largest_fires(fires: DataFrame, n: int = 4) -> DataFrame:
    return fires.orderBy(F.col("size").desc(), "ids").limit(n)


def order_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys)


# sets


def union_by_name(dfs: Sequence[DataFrame], fill: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), dfs)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
