"""Summaries of burns, climate, optimizer history and scores, as single aggregates."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocell.functions.columns import multiplier, t_critical
from pyrocell.operators.ranks import joined_by, quantiles, running_sums
from pyrocell.operators.tables import dedupe_start_pixels

# burns


def percent_burned_by_class(cells: DataFrame) -> DataFrame:
    """Available and burned cells per land-cover class and the percentage, three decimals half to even."""
    agg = cells.groupBy("lcc").agg(F.count("*").alias("available"), F.sum("burned").alias("nburned"))
    return agg.withColumn("percentBurned", F.bround(F.col("nburned") / F.col("available") * 100, 3))


def compare_climate(hist: DataFrame, proj: DataFrame, flammable: DataFrame, value: str, first_hist: int = 2001, first_proj: int = 2011) -> DataFrame:
    """(year, stat, value): exact median over flammable cells per layer, historical and projected."""
    burnable = flammable.where("flammable > 0").select("pixelID")
    one = lambda df, first, stat: df.join(burnable, "pixelID", "left_semi").transform(lambda d: quantiles(d, ["layer"], value, {value: 0.5})).select((F.col("layer") + (first - 1)).alias("year"), F.lit(stat).alias("stat"), value)
    return one(hist, first_hist, "historical").unionByName(one(proj, first_proj, "projected"))


def observed_burns(polys: DataFrame, pixel_size: float) -> DataFrame:
    """Per year the area and number of fires over the pixel size."""
    return polys.where(F.col("SIZE_HA") > pixel_size).groupBy("year").agg(F.sum("POLY_HA").alias("area"), F.count("*").alias("n"))


def projected_burns(burns: DataFrame, pixel_size: float) -> DataFrame:
    """Per year of escapes their number and the area burned."""
    area = burns.groupBy("year").agg(F.sum("areaBurnedHa").alias("area"))
    n = burns.where(F.col("areaBurnedHa") > pixel_size).groupBy("year").agg(F.count("*").alias("n"))
    return n.join(area, "year", "left").select("year", "area", "n")


def ignition_counts(points: DataFrame, burns: DataFrame) -> DataFrame:
    """(year, stat, n): observed points and projected rows."""
    one = lambda df, s: df.groupBy("year").agg(F.count("*").alias("n")).select("year", F.lit(s).alias("stat"), "n")
    return one(points, "observed").unionByName(one(burns, "projected"))


def burn_summary_long(burns: DataFrame, pixel_size: float) -> DataFrame:
    """(year, rep, var, val): area burned, number of fires and mean fire size over the pixel size."""
    agg = burns.groupBy("year", "rep").agg(
        F.sum("areaBurnedHa").alias("areaBurned"), F.count("*").cast("double").alias("nFires"), F.avg(F.when(F.col("areaBurnedHa") > pixel_size, F.col("areaBurnedHa"))).alias("meanSize")
    )
    return agg.unpivot(["year", "rep"], ["areaBurned", "nFires", "meanSize"], "var", "val").where("val IS NOT NULL")


def burn_trends(long: DataFrame) -> DataFrame:
    """Per variable the linear trend on year: slope, intercept, r2, t statistic and whether it differs from none at
    p < 0.01 (two-sided t test of n - 2 degrees of freedom, which equals the F test); nulls are left out, a variable of
    under three values has no verdict."""
    y, x = F.col("val"), F.col("year").cast("double")
    agg = long.groupBy("var").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("val").alias("n"))
    t = F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))
    return agg.withColumn("t", t).withColumn("significant", (F.abs("t") > t_critical(2.5758293035489004, F.col("n") - 2)).cast("int"))


def cumulative_burn(maps: DataFrame, n_reps: int, study: DataFrame) -> DataFrame:
    """Mean over replicates per cell of the study area."""
    return maps.join(study.select("pixelID").distinct(), "pixelID", "left_semi").groupBy("pixelID").agg((F.sum("burned") / n_reps).alias("burned"))


# optimizer history


def population_summary(pop: DataFrame) -> DataFrame:
    """Per iteration and variable: mean, exact 2.5 and 97.5 % quantiles, variance, and the width between the quantiles."""
    by = ["iter", "variable"]
    g = joined_by(pop.groupBy(*by).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance")), quantiles(pop, by, "value", {"lo": 0.025, "hi": 0.975}), by)
    g = g.select(*by, "mean", "lo", "hi", "variance")
    return g.withColumn("width", F.col("hi") - F.col("lo"))


def plateau(best: DataFrame, width: int = 175, step: int = 25) -> DataFrame:
    """(segment, slope, t, flat) of overlapping segments of iterations (iter from 0, value): flat if the slope's
    two-sided p exceeds 0.1 in a t test of width - 2 degrees of freedom; a constant segment is flat."""
    last = F.floor(F.col("iter") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("iter") - width + 1) / step))
    seg = best.withColumn("segment", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    y, x = F.col("value"), F.col("iter").cast("double")
    agg = seg.groupBy("segment").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2")).where(F.col("n") == width)
    t = F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))
    return agg.select("segment", "slope", t.alias("t")).withColumn("flat", F.coalesce((F.abs("t") < t_critical(1.6448536269514722, F.lit(width - 2))).cast("int"), F.lit(1)))


def has_plateaued(segments: DataFrame, iterations: int, least: int = 349) -> bool:
    """The last two segments are flat and there were more than ``least`` iterations."""
    rows = segments.orderBy(F.col("segment").desc()).limit(2).collect()
    return iterations > least and len(rows) == 2 and all(r.flat for r in rows)


def parameter_histograms(pop: DataFrame, bounds: DataFrame, bins: int = 15) -> DataFrame:
    """(variable, bin, n) within each variable's [lower, upper]; the upper bound is in the last bin."""
    joined = pop.join(F.broadcast(bounds), "variable").where("value BETWEEN lower AND upper")
    b = F.least(F.width_bucket("value", "lower", "upper", F.lit(bins)), F.lit(bins))
    return joined.groupBy("variable", b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


# fuel


def relative_abundance(landscape: DataFrame, cut: float = 0.1) -> DataFrame:
    """Per species and class: share of pixel-years where it has over ``cut`` of the pixel's biomass."""
    total = landscape.groupBy("pixelID", "year").agg(F.sum("B").alias("totalBiomass"))
    n = total.agg(F.count("*").alias("cells"))
    share = landscape.join(total, ["pixelID", "year"]).groupBy("speciesCode", "FuelClass").agg(F.sum((F.col("B") / F.col("totalBiomass") > cut).cast("int")).alias("above"))
    return share.crossJoin(F.broadcast(n)).select("speciesCode", "FuelClass", (F.col("above") / F.col("cells")).alias("relAbundance"))


def nonforest_burn_rate(landscape: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Mean of burned per class; classes off the list together as missingForest."""
    name = F.when(F.col("lcc").isin(*classes), F.col("lcc").cast("string")).otherwise("missingForest")
    return landscape.groupBy(name.alias("lcc")).agg(F.avg("burned").alias("coef"))


def species_stats(fits: DataFrame, abundance: DataFrame, p_value: float = 0.001) -> DataFrame:
    """Sign of each coefficient (neutral if not significant), with relative abundance."""
    sign = F.when(F.col("p") >= p_value, "neutral").when(F.col("coef") > 0, "positive").otherwise("negative")
    return fits.withColumn("sign", sign).join(abundance, "speciesCode", "left")


def large_zones(zones: DataFrame, min_cells: int = 100) -> DataFrame:
    """Zones of more cells than min_cells, with their number."""
    return zones.groupBy("zone").agg(F.count("*").alias("n")).where(F.col("n") > min_cells)


# spread scores over a table of simulated sizes


def simulated_sizes(sim: DataFrame, n_reps: int) -> DataFrame:
    """Mean simulated size per start cell, half to even."""
    return sim.groupBy("initialLocus").agg(F.bround(F.sum("N") / n_reps).alias("simSize"), F.count("*").alias("fires"))


def burn_probability(sim: DataFrame, buffers: DataFrame, n_reps: int) -> DataFrame:
    """Per buffer cell: p = min(N / reps + 0.001, 0.99), the Bernoulli log likelihood of burned, class 0/1/2."""
    out = buffers.join(sim, "pixelID", "left").withColumn("p", F.least(F.coalesce("N", F.lit(0)) / n_reps + 0.001, F.lit(0.99)))
    ll = F.when(F.col("buffer") == 1, F.log("p")).otherwise(F.log(1 - F.col("p")))
    return out.withColumns({"logLik": ll, "class": F.when(F.col("ignited") == 1, 2).otherwise(F.col("buffer"))})


def historical_fires(fires: DataFrame, min_size: float = 2) -> DataFrame:
    """Fires of at least min_size, one per start cell and year."""
    return dedupe_start_pixels(fires.where(F.col("size") >= min_size))


def score_mad(observed: DataFrame, simulated: DataFrame) -> DataFrame:
    """Mean absolute difference per batch and weighted by fires over the batches; joined on the start cell."""
    both = observed.join(simulated, observed.cells == simulated.initialLocus)
    per = both.groupBy("batch").agg(F.avg(F.abs(F.col("size") - F.col("simSize"))).alias("mad"), F.count("*").alias("n"))
    return per.agg((F.sum(F.col("mad") * F.col("n")) / F.sum("n")).alias("mad"), F.sum("n").alias("n"))


def score_ad(values: DataFrame, batch: int | None = None) -> DataFrame:
    """Two-sample Anderson-Darling statistic x 50 of values (value, sample 0/1), over the pooled distinct values. With
    ``batch``, of the rows of that batch alone (the small fires are batch 2). Where the test has no value, as with a sample
    of no rows or one value in all, it counts as 1e6, x 50."""
    if batch is not None:
        values = values.where(F.col("batch") == batch)
    values = values.where("value IS NOT NULL")
    per = values.groupBy("value").agg(F.count("*").alias("l"), F.sum((F.col("sample") == 0).cast("int")).alias("f"))
    run = running_sums(per, "value", ["l", "f"]).withColumnsRenamed({"upto_l": "H", "upto_f": "first"})
    tot = per.agg(F.sum("l").alias("total"), F.sum("f").alias("n"))
    z = run.crossJoin(F.broadcast(tot)).where("H < total").withColumn("m", F.col("total") - F.col("n"))
    term = F.col("l") / F.col("total") * F.pow(F.col("total") * F.col("first") - F.col("n") * F.col("H"), F.lit(2.0)) / (F.col("H") * (F.col("total") - F.col("H")))
    share = F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), F.col("m"))
    return z.agg((F.coalesce(F.sum(term) * F.max(share), F.lit(1e6)) * 50).alias("ad"))


def score_snll_fs(observed: DataFrame, sim: DataFrame, x_scale: str = "raw", by: Sequence[str] = ()) -> DataFrame:
    """(by, snll_fs, n), over all fires or those of each group of ``by``: per fire the Gaussian kernel density (nrd0 bandwidth) of sqrt(N) over replicates with N > 1 at
    the observed size, times ln(size), floor 1e-29, summed as -ln; a fire with one such replicate has density 0."""
    s = sim.where("N > 1").select("initialLocus", F.sqrt(F.col("N").cast("double")).alias("v"))
    stats = s.groupBy("initialLocus").agg(F.count("*").alias("k"), F.stddev_samp("v").alias("sd"), F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.75)).alias("q3"), F.min(F.abs("v")).alias("a"))
    spread = F.least("sd", (F.col("q3") - F.col("q1")) / 1.34)
    lo = F.when(spread > 0, spread).when(F.col("sd") > 0, F.col("sd")).when(F.col("a") > 0, F.col("a")).otherwise(1.0)
    stats = stats.where("k > 1").withColumn("h", 0.9 * lo * F.pow(F.col("k").cast("double"), F.lit(-0.2)))
    at = F.sqrt(F.col("size").cast("double")) if x_scale == "sqrt" else F.col("size").cast("double")
    z = (at - F.col("v")) / F.col("h")
    dens = observed.join(s, observed.cells == s.initialLocus).join(stats, "initialLocus").groupBy("cells").agg(F.avg(F.exp(-z * z / 2) / (F.col("h") * 2.5066282746310002)).alias("d"))
    out = observed.join(dens, "cells", "left")
    return out.groupBy(*by).agg(F.sum(-F.log(F.greatest(F.coalesce("d", F.lit(0.0)) * F.log(F.col("size").cast("double")), F.lit(1e-29)))).alias("snll_fs"), F.count("*").alias("n"))


def batch_scores(yearly: DataFrame, thresh: float) -> DataFrame:
    """(batch, years, snll_fs, bail) of yearly scores (batch, year, snll_fs): their sum, rounded half to even. A first batch whose
    sum is over thresh, rounded, for each of its years scores 1e6 and bails: no later batch is worth running."""
    per = yearly.groupBy("batch").agg(F.count("*").alias("years"), F.bround(F.sum("snll_fs")).alias("total"))
    bail = (F.col("batch") == 1) & (F.col("total") > F.bround(F.lit(float(thresh))) * F.col("years"))
    return per.select("batch", "years", F.when(bail, 1e6).otherwise(F.col("total")).alias("snll_fs"), bail.cast("int").alias("bail"))


def score_snll(probs: DataFrame) -> DataFrame:
    """Negative sum of the cells' log likelihoods over 6e4."""
    return probs.agg((-F.sum("logLik") / 6e4).alias("snll"))


def buffer_size_check(buffers: DataFrame, least: float = 2000) -> DataFrame:
    """The 30 % quantile of available cells per fire and whether it is under ``least``."""
    n = buffers.groupBy("year", "ids").agg(F.count("*").alias("n"))
    return quantiles(n, [], "n", {"q30": 0.3}).withColumn("small", (F.col("q30") < least).cast("int"))


def max_sizes(fires: DataFrame) -> DataFrame:
    return fires.withColumn("maxSize", multiplier(F.col("size").cast("double")))


def landscape_gate(probs: DataFrame, lower: float, upper: float, logit1: float, n_fires: str = "n_fires") -> DataFrame:
    """Per (param_id, year): is the map acceptable? The median of all cells lies in [lower, upper]; over the cells
    off the floor (over lower * 1.025 or logit1 * 0.99) the spread (q90 - q10) / median exceeds 0.025 and the first
    quartile is under 0.265. A failing year scores fires * -ln(1e-29)."""
    off = F.when((F.col("spreadProb") > lower * 1.025) | (F.col("spreadProb") > logit1 * 0.99), F.col("spreadProb"))
    by = ["param_id", "year"]
    over = quantiles(probs.withColumn("off", off), by, "off", {"m": 0.5, "q10": 0.1, "q90": 0.9, "q25": 0.25})
    g = joined_by(joined_by(probs.groupBy(*by).agg(F.max(n_fires).alias("fires")), quantiles(probs, by, "spreadProb", {"med": 0.5}), by), over, by)
    spread = F.coalesce(F.try_divide(F.col("q90") - F.col("q10"), F.col("m")), F.lit(0.0))
    ok = F.col("med").between(lower, upper) & (spread > 0.025) & (F.col("q25") < 0.265)
    ok = F.coalesce(ok, F.lit(False))
    return g.select("param_id", "year", "med", spread.alias("spread"), ok.cast("int").alias("pass"), F.when(~ok, F.col("fires") * 66.77496769682733).alias("score"))


# ignition likelihood


LINKS = {"identity": lambda eta: eta, "log": np.exp, "logit": lambda eta: 1 / (1 + np.exp(-eta))}


def ignition_nll(df: DataFrame, candidates: DataFrame, y: str, covs: Sequence[str], coefs: Sequence[str], offset: float = 0.0, knots: dict[str, str] | None = None, family: str = "poisson", link: str = "identity", block: int = 1 << 18) -> DataFrame:
    """(param_id, nll): negative log likelihood of counts (poisson, without its constant term) or of shares (binomial) with
    mean mu, the inverse link of sum of covariate times coefficient + offset, under every candidate; 1e20 if some mu is
    null or not a positive finite number (with knots, the hinge of a covariate at the candidate's knot: is negative), or
    over 1 for shares. Rows without y count for nothing else.

    Rows of equal covariates and y score the same, so they are counted first and each is scored once, times its
    count. A pass over those takes up to ``block`` candidates, which its tasks hold; a task sends one partial sum a
    candidate, so neither side is multiplied out in a shuffle. They cost by candidates, not by the bytes of their rows, so they
    are dealt to a set number of tasks."""
    knots, inverse = knots or {}, LINKS[link]
    if family not in ("poisson", "binomial"):
        raise ValueError(f"family must be poisson or binomial, not {family}")
    spark = df.sparkSession
    rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covs)), F.col(y).cast("double").alias("y"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    data = rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("times")).repartition(tasks)
    names = ["param_id", *coefs, *(knots[c] for c in covs if c in knots)]

    def passed(rows: list) -> DataFrame:
        ids = pa.array([r[0] for r in rows])
        sent_table = spark.sparkContext.broadcast(np.array([r[1:] for r in rows], np.float64).T)  # block columns at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = sent_table.value
            hinge = dict(zip((c for c in covs if c in knots), table[len(coefs) :]))
            bad, total, n, step = np.zeros(len(ids), bool), np.zeros(len(ids)), 0, 1024
            for batch in batches:
                n += batch.num_rows
                xs = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                for at, of in itertools.product(range(0, batch.num_rows, step), range(0, len(ids), step)):
                    eta = np.full((min(step, batch.num_rows - at), min(step, len(ids) - of)), float(offset))
                    for i, c in enumerate(covs):
                        x = xs[i][at : at + step, None]
                        eta += (np.maximum(x - hinge[c][of : of + step], 0.0) if c in hinge else x) * table[i, of : of + step]
                    with np.errstate(all="ignore"):
                        mu, seen, times = inverse(eta), xs[-2][at : at + step, None], xs[-1][at : at + step, None]
                        wrong = ~np.isfinite(mu) | (mu < 0 if knots else mu <= 0) | ((mu > 1) if family == "binomial" else False)
                        each = mu - seen * np.log(np.maximum(mu, 1e-300)) if family == "poisson" else -seen * np.log(np.maximum(mu, 1e-300)) - (1 - seen) * np.log(np.maximum(1 - mu, 1e-300))
                    bad[of : of + step] |= wrong.any(0)
                    total[of : of + step] += np.nansum(np.where(wrong, 0.0, each * times), 0)
            if n:
                yield pa.RecordBatch.from_arrays([ids, pa.array(bad), pa.array(total)], ["param_id", "bad", "nll"])

        return data.mapInArrow(run, f"param_id {sent}, bad boolean, nll double").withColumn("param_id", F.col("param_id").cast(kind))

    kind = dict(candidates.dtypes)["param_id"]
    sent = "string" if kind == "string" else "bigint"
    parts, held = [], []
    for r in candidates.select(*names).toLocalIterator():
        held.append(tuple(r))
        if len(held) == block:
            parts.append(passed(held))
            held = []
    if held or not parts:
        parts.append(passed(held) if held else spark.createDataFrame([], f"param_id {kind}, bad boolean, nll double"))
    return reduce(DataFrame.unionByName, parts).groupBy("param_id").agg(F.when(F.bool_or("bad"), 1e20).otherwise(F.sum("nll")).alias("nll"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by the rank sum, ties at their mean rank; ranks run over distinct scores."""
    per = df.groupBy(score).agg(F.count("*").alias("c"), F.sum(label).alias("p"))
    ranked = running_sums(per, score, ["c"]).withColumn("r", F.col("upto_c") - (F.col("c") - 1) / 2)
    return ranked.agg(((F.sum(F.col("r") * F.col("p")) - F.sum("p") * (F.sum("p") + 1) / 2) / (F.sum("p") * (F.sum("c") - F.sum("p")))).alias("auc"))
