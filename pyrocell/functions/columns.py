"""Column functions over pixel tables: fixed point, rescaling, curves, exclusivity, names. No action is run here
but by ``rescale_known`` and ``min_max_normalize``, whose scalars come from one aggregate joined back."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def as_integer(x: Column) -> Column:
    """floor(x + 0.5) as a 32-bit integer."""
    return F.floor(x + F.lit(0.5)).cast("int")


def to_x1000(df: DataFrame, omit: Sequence[str] = ("pixelID",)) -> DataFrame:
    """Every column but ``omit`` times 1000 as an integer."""
    return df.select(*(c if c in omit else as_integer(F.col(c) * 1000).alias(c) for c in df.columns))


def from_x1000(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(1000.0) for c in cols})


def replace_na_with_0(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])) for c in (cols or df.columns)})


def annual_stack_x1000(df: DataFrame, keep: DataFrame, layers: Sequence[str], all_layers: bool = False) -> DataFrame:
    """The listed pixels of keep, nulls 0, the first layer (or all of them) in fixed point."""
    kept = replace_na_with_0(df.join(keep.select("pixelID").distinct(), "pixelID", "left_semi"), list(layers))
    scaled = set(layers if all_layers else layers[:1])
    return kept.select("pixelID", *(as_integer(F.col(c) * 1000).alias(c) if c in scaled else as_integer(F.col(c)).alias(c) for c in layers))


def greatest_or_null(x: Column, least: Column) -> Column:
    """greatest() that keeps null."""
    return F.when(x.isNotNull(), F.greatest(x, least))


def log_min_b(x: Column) -> Column:
    """ln(max(x, exp(ln(100) - 1)))."""
    return F.log(greatest_or_null(x.cast("double"), F.exp(F.log(F.lit(100.0)) - 1)))


def pw(v: Column, knot: Column | float) -> Column:
    """Hinge max(v - knot, 0)."""
    return greatest_or_null(v - knot, F.lit(0.0))


def oom(x: Column) -> Column:
    """The power of ten at or above |x|."""
    return F.pow(F.lit(10.0), F.ceil(F.log10(F.abs(x))))


def rescale_known2(x: Column, min_new, max_new, min_orig, max_orig) -> Column:
    """(x - min_orig) * (max_new - min_new) / (max_orig - min_orig); min_new is not added."""
    return F.try_divide((x - min_orig) * (F.lit(max_new) - F.lit(min_new)), F.lit(max_orig) - F.lit(min_orig))


def rescale_known(df: DataFrame, col: str, max_new: float, min_orig: float) -> DataFrame:
    """(x - min_orig) * max_new / max(x - min_orig) over the column; a column of zeros stays zero."""
    top = df.agg(F.max(F.col(col) - min_orig).alias("__top"))
    shifted = F.col(col) - min_orig
    return df.crossJoin(F.broadcast(top)).withColumn(col, F.when(F.col("__top") == 0, shifted).otherwise(shifted * max_new / F.col("__top"))).drop("__top")


def min_max_normalize(df: DataFrame, col: str) -> DataFrame:
    """(x - min) / (max - min); one aggregate row is broadcast."""
    ends = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(col, F.try_divide(F.col(col) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def _curve(x: Column, p1, p2, scale, slope, power) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    p1, p2, scale, slope, power = map(lit, (p1, p2, scale, slope, power))
    return p1 + (p2 - p1) / F.pow(1 + F.pow(F.exp(x) / scale, -slope), power)


def logistic5p(x: Column, p: Sequence) -> Column:
    return _curve(x, *p)


def logistic4p(x: Column, p: Sequence) -> Column:
    return _curve(x, p[0], p[1], 1.0, p[2], p[3])


def logistic3p(x: Column, p: Sequence, par1: float = 0.1) -> Column:
    return _curve(x, par1, p[0], 1.0, p[1], p[2])


def logistic2p(x: Column, p: Sequence, par1: float = 0.1, par4: float = 0.5) -> Column:
    return _curve(x, par1, p[0], 1.0, p[1], par4)


def logistic_all(covs: Sequence[Column], logistic: Sequence, coefs: Sequence, lower: float = 0.1) -> Column:
    """The curve of the linear predictor; 2 or 3 logistic parameters, any other number raises."""
    if len(logistic) not in (2, 3):
        raise ValueError(f"logistic_all takes 2 or 3 logistic parameters, not {len(logistic)}")
    x = sum((c * b for c, b in zip(covs, coefs, strict=True)), F.lit(0.0))
    return (logistic2p if len(logistic) == 2 else logistic3p)(x, logistic, lower)


def params_separate(par: Column, n_cov: int) -> tuple[Column, Column]:
    """(logistic, covariate) parameters of an array: the last n_cov are the covariates'."""
    return F.slice(par, F.lit(1), F.size(par) - n_cov), F.slice(par, F.size(par) - n_cov + 1, F.lit(n_cov))


def param_terms(n_params: int, terms: Sequence[str]) -> list[str]:
    """logit1..k, then the terms."""
    return [*(f"logit{i + 1}" for i in range(n_params - len(terms))), *terms]


def label_params(df: DataFrame, par: str, labels: Sequence[str], key: str) -> DataFrame:
    """(key, label, value) of an array column."""
    each = df.select(key, F.posexplode(par).alias("i", "value"))
    return each.select(key, F.element_at(F.array(*map(F.lit, labels)), F.col("i") + 1).alias("label"), "value")


def multiplier(size: Column, min_size: float = 1000, base: float = 5) -> Column:
    """max(min_size, round half to even(max(base, 14 - ln(size)) * size))."""
    grown = F.bround(F.greatest(F.lit(float(base)), F.lit(14.0) - F.log(size)) * size)
    return F.when(size.isNotNull(), F.greatest(F.lit(float(min_size)), grown))


def rescale_by_magnitude(df: DataFrame, rescalers: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(v)) for c, v in rescalers.items()})


def make_mutually_exclusive(df: DataFrame, exclusive: Mapping[str, Sequence[str]], exact: bool = False) -> DataFrame:
    """Where the key column isn't 0, every column that a pattern matches becomes 0; patterns apply in order."""
    for key, patterns in exclusive.items():
        for pattern in patterns:
            hit = [c for c in df.columns if (c == pattern if exact else re.search(pattern, c))]
            on = F.coalesce(F.col(key) != 0, F.lit(False))
            df = df.withColumns({c: F.when(on, F.lit(0)).otherwise(F.col(c)).cast(dict(df.dtypes)[c]) for c in hit}) if hit else df
    return df


def beta_shape2(low: float, up: float, mean: float, shape1: float) -> float:
    m1 = (mean - low) / (up - low)
    return shape1 * (1 - m1) / m1


def _uniform(key: np.ndarray, seed: int, place: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key, seed and place alone: mixed counters, no generator to move on."""
    with np.errstate(over="ignore"):
        z = key + np.uint64(seed) * np.uint64(0xD1342543DE82EF95) + np.uint64(place + 1) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _gamma(key: np.ndarray, shape: np.ndarray, seed: int, place: int) -> np.ndarray:
    """A gamma draw of each shape, all at once: a cubed normal is taken or refused; the refused draw again."""
    low = shape < 1
    d = np.where(low, shape + 1, shape) - 1 / 3
    c, out = 1 / np.sqrt(9 * d), np.empty(len(key))
    left, k = np.arange(len(key)), place
    while len(left):
        u, v, w = (_uniform(key[left], seed, k + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        t = (1 + c[left] * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            taken = (t > 0) & (np.log(w) < x * x / 2 + d[left] * (1 - t + np.log(t)))
        out[left[taken]] = (d[left] * t)[taken]
        left, k = left[~taken], k + 3
    return np.where(low, out * _uniform(key, seed, place + (1 << 20)) ** (1 / shape), out)


def rbeta_between(key: Column, low: Column, up: Column, mean: Column, shape1: float, shape2: float | None = None, seed: int = 42) -> Column:
    """A beta draw scaled to [low, up], by default of the given mean; a row's draw depends on its key, a non-negative
    integer, and the seed alone. Null where an input is null or the mean isn't inside the bounds. A beta draw is a gamma
    draw's share of two, and a batch's rows draw together."""

    @F.arrow_udf("double")
    def draw(keys: pa.Array, lows: pa.Array, ups: pa.Array, means: pa.Array) -> pa.Array:
        lo, hi, m = (x.to_numpy(zero_copy_only=False).astype(float) for x in (lows, ups, means))
        fits = keys.is_valid().to_numpy(zero_copy_only=False) & (lo < m) & (m < hi)
        k, lo, hi, m = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)[fits], lo[fits], hi[fits], m[fits]
        second = np.full(len(k), shape2, float) if shape2 is not None else beta_shape2(lo, hi, m, shape1)
        one, two = _gamma(k, np.full(len(k), float(shape1)), seed, 0), _gamma(k, second, seed, 1 << 21)
        out = np.full(len(fits), np.nan)
        out[fits] = lo + (hi - lo) * one / (one + two)
        return pa.array(out, mask=~fits)

    return draw(key.cast("long"), low.cast("double"), up.cast("double"), mean.cast("double"))


def update_stack_year_names(df: DataFrame, years: Sequence[int], key: str = "pixelID") -> DataFrame:
    """Layer names must end in the desired years, in order; they become yearYYYY."""
    layers = [c for c in df.columns if c != key]
    found = [re.search(r"(\d{4})$", c) for c in layers]
    if not all(found):
        raise ValueError("every layer name must end in a year of four digits")
    if [int(m[1]) for m in found] != list(years):
        raise ValueError("the layers' years differ from the years asked for")
    return df.select(key, *(F.col(c).alias(f"year{m[1]}") for c, m in zip(layers, found)))


def year_from_token(token: Column) -> Column:
    return F.regexp_replace(token, "[A-Za-z]+", "").cast("int")


def token_from_year(year: Column) -> Column:
    return F.concat(F.lit("year"), year.cast("string"))


def explode_year_key(df: DataFrame, key: str) -> DataFrame:
    """One row per part of year1991_year1992: ind (0-based) and date."""
    return df.select("*", F.posexplode(F.split(key, "_")).alias("ind", "date"))


def abbreviate_name(name: Column) -> Column:
    """Genus_spe to Gn_sp: lower-case vowels go after the first letter of the genus, two letters stay of it and of
    the species part; a name without an underscore keeps at most five characters."""
    genus, species = F.split_part(name, F.lit("_"), F.lit(1)), F.split_part(name, F.lit("_"), F.lit(2))
    short = F.substring(F.concat(F.substring(genus, 1, 1), F.regexp_replace(F.substring(genus, 2, 1000), "[aeiou]", "")), 1, 2)
    plain = F.substring(F.concat(F.substring(name, 1, 1), F.regexp_replace(F.substring(name, 2, 1000), "[aeiou]", "")), 1, 5)
    return F.when(F.contains(name, F.lit("_")), F.concat(short, F.lit("_"), F.substring(species, 1, 2))).otherwise(plain)


def abbreviate_species(df: DataFrame, species: str = "species", assigned: str = "assignedFuelClass", order: str = "pos", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: for species assigned to another class, the class's short names joined by '.', in the order of
    ``order``; the class name itself for the others. Classes are those of one value of the columns ``by``."""
    moved = F.col(assigned) != F.col(species)
    named = df.where(moved).groupBy(*by, assigned).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), abbreviate_name(F.col(species)).alias("n")))), lambda s: s["n"]), ".").alias("__name"))
    return df.join(named, [*by, assigned], "left").withColumn("name", F.when(moved, F.col("__name")).otherwise(F.col(assigned))).drop("__name")


def t_critical(z: float, freedom: Column) -> Column:
    """The quantile of Student's t where the normal one is z, by the series in 1 / freedom; off by under 0.2 % from
    five degrees of freedom on. Null without freedom."""
    v = F.when(freedom > 0, freedom.cast("double"))
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return sum((F.lit(t) / F.pow(v, F.lit(float(k))) for k, t in enumerate(terms, 1)), F.lit(z))


def inverse_logit(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
