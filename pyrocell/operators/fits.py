"""Model fits of Spark ML over pixel tables: species regressions, non-forest groups, burn classes, ignitions.

Rows with a null in a used column are left out of fits and predictions. Only coefficients, centres, counts of zones
over the limit and the like, whose number the caller's columns, zones and k bound, reach the driver.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrocell.functions.columns import abbreviate_species
from pyrocell.grid import GridSpec
from pyrocell.operators.mixtures import Mixture, fit_mixtures
from pyrocell.operators.provinces import merged_provinces, split_large_zones
from pyrocell.operators.ranks import joined_by
from pyrocell.operators.regressions import logistic_by
from pyrocell.operators.spatial import buffer_zones, drop_small_patches, focal_modal_fill
from pyrocell.operators.summaries import auc, ignition_nll, large_zones, nonforest_burn_rate, relative_abundance, species_stats
from pyrocell.operators.tables import group_size
from pyrocell.storage import materialise


def _assembled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="__x", handleInvalid="skip").transform(df)


def fit_fuel_glm(landscape: DataFrame, species: Sequence[str]) -> DataFrame:
    """(speciesCode, coef, p): logistic regression of burned on B / 100, one per listed species, all fitted together. A
    species without rows, or with one outcome or one biomass only, has nulls."""
    own = landscape.where(F.col("speciesCode").isin(*species)).select("speciesCode", (F.col("B") / 100).alias("b"), "burned")
    listed = landscape.sparkSession.createDataFrame([(s,) for s in species], "speciesCode string")
    return joined_by(listed, logistic_by(own, ["speciesCode"], "b", "burned"), ["speciesCode"]).select("speciesCode", "coef", "p")


def cluster_nonforest(rates: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(lcc, group) over burn rates (lcc, coef): k-means of the coefficients, groups named nfLCC_ and their sorted
    classes; missingForest joins the group of the class with the closest coefficient (ties: the least class)."""
    rates = materialise(rates.select("lcc", "coef"))  # a row a class, read in every round
    known = rates.where("lcc <> 'missingForest' and coef is not null")
    if known.isEmpty():
        return rates.select("lcc", F.lit(None).cast("string").alias("group"))
    near = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__c").fit(_assembled(known, ["coef"])).transform(_assembled(known, ["coef"]))
    names = near.groupBy("__c").agg(F.concat(F.lit("nfLCC_"), F.array_join(F.transform(F.array_sort(F.collect_list(F.col("lcc").cast("long"))), lambda x: x.cast("string")), "_")).alias("group"))
    grouped = near.join(names, "__c").select("lcc", "coef", "group")
    missing = rates.where("lcc = 'missingForest'").select(F.col("coef").alias("__m"))
    # one row on the broadcast side: missingForest is one class of the rates
    closest = grouped.join(F.broadcast(missing)).groupBy(F.lit("missingForest").alias("lcc")).agg(F.min_by("group", F.struct(F.abs(F.col("coef") - F.col("__m")), F.col("lcc").cast("long"))).alias("group"))
    return grouped.select("lcc", "group").unionByName(closest)


def burn_class_fit(train: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(4, 10), seed: int = 1) -> tuple[Mixture, int]:
    """The Gaussian mixture of best BIC over ``cols``, and its k; all k are fitted side by side."""
    _, k, model = max(fit_mixtures(train, cols, list(ks), seed), key=lambda f: f[:2])
    return model, k


def burn_class_predict(model: Mixture, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """df's rows, complete in ``cols``, with burnClass: the component of greatest weight times density, ties to the lower.
    Columns of the model that aren't listed are unknown, and left out of the density."""
    scores = model.scores(cols)
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    place = F.array_position(F.array(*scores), best) - 1
    return df.dropna(subset=list(cols)).withColumn("burnClass", place.cast("int"))


def burn_class_auc(df: DataFrame, cols: Sequence[str], known: Sequence[str], ks: Sequence[int] = range(4, 10), seed: int = 1) -> DataFrame:
    """(auc): how well burn classes fitted to 75 % of df's rows tell which of the other rows burned, from the columns
    ``known`` alone."""
    train, test = materialise(df).randomSplit([0.75, 0.25], seed)
    model, _ = burn_class_fit(train, cols, ks, seed)
    summary = burn_class_summary(burn_class_predict(model, train, cols), cols)
    classed = burn_prob_from_class(burn_class_predict(model, test.dropna(subset=["burned"]), known), summary)
    return auc(classed, "burnProb", "burned")


def burn_class_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of every column per burnClass."""
    return df.groupBy("burnClass").agg(*(F.avg(c).alias(c) for c in cols))


def burn_prob_from_class(classed: DataFrame, summary: DataFrame) -> DataFrame:
    """Each row's burnProb: the mean of burned in its class. A class has one row, so the means are few."""
    return classed.join(F.broadcast(summary.select("burnClass", F.col("burned").alias("burnProb"))), "burnClass", "left")


def fit_ignition(df: DataFrame, y: str, covs: Sequence[str], family: str = "poisson", link: str = "identity") -> GeneralizedLinearRegressionModel:
    """Regression of counts (poisson) or shares (binomial, link logit) on covariates."""
    data = _assembled(df.withColumn("__y", F.col(y).cast("double")).dropna(subset=["__y"]), covs)
    return GeneralizedLinearRegression(family=family, link=link, featuresCol="__x", labelCol="__y", predictionCol="fitted").fit(data)


def search_ignition(df: DataFrame, y: str, covs: Sequence[str], bounds: Mapping[str, tuple[float, float]], knots: Mapping[str, str] | None = None, family: str = "poisson", link: str = "identity", offset: float = 0.0, points: int = 5, rounds: int = 20, keep: float = 0.6) -> DataFrame:
    """(term, value): the parameters inside their bounds, and "nll", that fit best of a coarse-to-fine search.

    bounds: of a coefficient for each covariate, in that order, then of each knot that ``knots`` (covariate -> name) names; a
    covariate with a knot counts by what it is over it. A round scores a lattice of ``points`` values of each parameter
    in one pass over the data, then narrows the box to ``keep`` of its size about the best so far, inside the bounds. After
    ``rounds`` rounds a box is keep ** rounds of its first size. Of equal scores the first of the lattice counts."""
    knots, names = dict(knots or {}), list(bounds)
    if points ** sum(lo < hi for lo, hi in bounds.values()) > 1 << 18:
        raise ValueError("too many parameters for a lattice: over 262144 candidates a round")
    coefs, spark = names[: len(covs)], df.sparkSession
    data = materialise(df.select(*dict.fromkeys([*covs, y])))
    box, best = dict(bounds), (math.inf, ())
    for _ in range(rounds):
        axes = [np.linspace(lo, hi, points).tolist() if lo < hi else [lo] for lo, hi in box.values()]
        lattice = list(itertools.product(*axes))
        candidates = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(lattice)], "param_id long, " + ", ".join(f"`{n}` double" for n in names))
        scores = ignition_nll(data, candidates, y, covs, coefs, offset, knots, family, link)
        found = scores.agg(F.min(F.struct("nll", "param_id")).alias("b")).first().b
        if found is None:
            raise ValueError("no row to fit to")
        best = min(best, (found.nll, lattice[found.param_id]))
        half = {n: (hi - lo) * keep / 2 for n, (lo, hi) in box.items()}
        box = {n: (max(bounds[n][0], v - half[n]), min(bounds[n][1], v + half[n])) for n, v in zip(names, best[1])}
    return spark.createDataFrame([*zip(names, map(float, best[1])), ("nll", float(best[0]))], "term string, value double")


def ignition_response(model: GeneralizedLinearRegressionModel, df: DataFrame, covs: Sequence[str]) -> DataFrame:
    """df's complete rows with ``fitted``, the response-scale prediction."""
    return model.transform(_assembled(df, covs)).drop("__x")


def slivers_reassigned(zones: DataFrame, lost: DataFrame) -> DataFrame:
    """(zone, pixelID, v, lost_by): cells that zones (zone, pixelID, v; 2 is core, 1 buffer) lost as small patches go, all
    cells of a losing zone together, to a zone that has one of the lost core cells; of those to the one whose
    number of cells changes least, which has the most of the lost cells already (ties: the least zone). ``lost_by``
    names the zone that lost them. A cell that the target has keeps the greater v. Cells lost by a zone without such a
    target are left out: the caller sees them by an anti join."""
    mine = lost.select(F.col("zone").alias("lost_by"), "pixelID", "v")
    there = zones.where("v > 0").select("zone", "pixelID")
    over = mine.join(there, "pixelID").where("zone <> lost_by").groupBy("lost_by", "zone").agg(F.count("*").alias("n"), F.max("v").alias("v")).where("v = 2")
    target = over.groupBy("lost_by").agg(F.min_by("zone", F.struct(-F.col("n"), F.col("zone"))).alias("zone"))
    moved = mine.join(target, "lost_by").select("zone", "pixelID", "v", "lost_by")
    both = zones.select("zone", "pixelID", "v", F.lit(None).cast(dict(lost.dtypes)["zone"]).alias("lost_by")).unionByName(moved)
    return both.groupBy("zone", "pixelID").agg(F.max("v").alias("v"), F.max("lost_by").alias("lost_by"))


def _merged(own: list[dict], target: int, low: float) -> tuple[list[int], set[int]]:
    """The species (places in own) in the order they are dealt with, and those that join their class."""
    size = Counter(s["FuelClass"] for s in own)
    sparse = [i for i, s in enumerate(own) if s["above"] < low and size[s["FuelClass"]] > 1]
    merged = set(sparse)
    for i in sparse:
        sign = own[i]["sign"]
        friends = [j for j, s in enumerate(own) if s["FuelClass"] == own[i]["FuelClass"] and j not in sparse]
        if friends:
            merged.add(min(friends, key=lambda j: (own[j]["sign"] != sign, own[j]["sign"], own[j]["above"], j)))
    needed = len(own) - target - len(sparse)
    if needed <= 0:
        return [*range(len(own))], merged
    order = [i for i, s in enumerate(own) if size[s["FuelClass"]] == 1]
    left = [i for i in range(len(own)) if i not in order]
    left.sort(key=lambda i: (own[i]["FuelClass"] if i in merged else "", own[i]["above"], i))
    while left and needed:
        i = left.pop(0)
        order.append(i)
        like = {own[i]["sign"], "neutral"} if own[i]["sign"] != "neutral" else {s["sign"] for s in own}
        fit = [j for j in left if own[j]["FuelClass"] == own[i]["FuelClass"] and own[j]["sign"] in like]
        if fit:
            merged |= {i, min(fit, key=lambda j: abs(own[j]["coef"] - own[i]["coef"]))}
            needed -= 1
    return [*order, *left], merged


def combine_fuel_classes(stats: DataFrame, target: int = 5, low: float = 0.05) -> DataFrame:
    """(area, species, FuelClass, assignedFuelClass, N): species merged inside their fuel classes until about ``target``
    classes are left; N species share an assigned class, which is named by their short names.

    stats: area, pos (the species' order), species, FuelClass, coef, sign, above (share of pixels where it counts). A study
    area has a handful of species and is one group; areas are spread over the cluster. Step 1: a species under
    ``low`` joins the others of its class, with it the least abundant friend of like sign, else of the next sign. Step
    2: from the least abundant on, a species joins the one of its class with the closest coefficient among those of
    like sign, neutral fitting any, until enough are joined. Classes of one species stay. Ties go by pos."""

    def run(own):
        own = own.sort_values("pos", kind="stable")
        rows = own.to_dict("records")
        order, merged = _merged(rows, target, low)
        out = own.iloc[order][["area", "species", "FuelClass"]].copy()
        out["pos"] = range(len(order))
        out["assignedFuelClass"] = [rows[i]["FuelClass" if i in merged else "species"] for i in order]
        return out

    kind = dict(stats.dtypes)["area"]
    cols = ["area", "pos", "species", "FuelClass", "coef", "sign", "above"]
    out = stats.select(*cols).groupBy("area").applyInPandas(run, f"area {kind}, species string, FuelClass string, pos int, assignedFuelClass string")
    named = abbreviate_species(out, by=["area"]).select("area", "species", "FuelClass", F.col("name").alias("assignedFuelClass"))
    return group_size(named, ["area", "assignedFuelClass"])


def assess_fuel_classes(landscape: DataFrame, equivalence: DataFrame, nonforest: Sequence[int], target_nonforest: int = 2, target: int = 5, p_value: float = 0.001) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fuel classes, non-forest groups, the group of missingForest) of a landscape (pixelID, year, lcc, speciesCode, B,
    burned) with equivalence (speciesCode, FuelClass). Rows without B are grouped by their burn rates; the others,
    off the non-forest classes, give each species a regression of burned on B, its sign and its abundance, from
    which fuel classes are merged. Species names, a short list, reach the driver."""
    landscape = materialise(landscape.select("pixelID", "year", "lcc", "speciesCode", "B", "burned"))
    groups = cluster_nonforest(nonforest_burn_rate(landscape.where("B IS NULL"), nonforest), target_nonforest)
    forest = landscape.where(F.col("B").isNotNull() & ~F.col("lcc").isin(*nonforest) & F.col("speciesCode").isNotNull())
    classes = equivalence.select("speciesCode", "FuelClass").distinct()
    species = sorted(r.speciesCode for r in forest.select("speciesCode").distinct().collect())
    stats = species_stats(fit_fuel_glm(forest, species), relative_abundance(forest.join(classes, "speciesCode")), p_value)
    order = F.array_position(F.array(*map(F.lit, species)), F.col("speciesCode")).cast("int") if species else F.lit(0)
    # a species whose regression can't be fitted has no slope and fits any sign
    stats = stats.select(F.lit("all").alias("area"), order.alias("pos"), F.col("speciesCode").alias("species"), "FuelClass", F.coalesce("coef", F.lit(0.0)).alias("coef"), F.when(F.col("p").isNull(), "neutral").otherwise(F.col("sign")).alias("sign"), F.col("relAbundance").alias("above"))
    missing = groups.where("lcc = 'missingForest'").select("group")
    return combine_fuel_classes(stats, target).drop("area"), groups.where("lcc <> 'missingForest'"), missing


def make_zones(layer: DataFrame, mask: DataFrame, grid: GridSpec, width: float, max_cells: int, least_patch: int = 500, least_zone: int = 100) -> tuple[DataFrame, DataFrame]:
    """(zones, lost) of a layer (pixelID, zone): holes filled from around within the mask, small zones left out, those of
    several patches merged by their hull, large ones cut, each buffered by width within the mask, small patches moved to the zone that has them (zone, pixelID, v,
    lost_by). ``lost``: (zone, pixelID) of patches that no zone takes. Zones are named zone.part."""
    filled = focal_modal_fill(layer, grid, "zone", 5, mask).where("zone IS NOT NULL")
    kept = filled.join(large_zones(filled, least_zone).select("zone"), "zone", "left_semi")
    whole = merged_provinces(kept, grid)
    cells = whole.select("zone", "pixelID", grid.x(F.col("pixelID")).alias("x"), grid.y(F.col("pixelID")).alias("y"))
    parts = split_large_zones(materialise(cells), max_cells)
    named = materialise(parts.select(F.concat_ws(".", F.col("zone").cast("string"), F.col("part").cast("string")).alias("zone"), "pixelID"))
    zones = materialise(buffer_zones(named, width, grid).join(mask.select("pixelID").distinct(), "pixelID", "left_semi"))
    labelled = materialise(drop_small_patches(zones, grid, least_patch))
    small = labelled.where("lost = 1").select("zone", "pixelID")
    lost = zones.join(small, ["zone", "pixelID"], "left_semi")
    out = slivers_reassigned(zones.join(small, ["zone", "pixelID"], "left_anti"), lost)
    taken = out.where("lost_by IS NOT NULL").select(F.col("lost_by").alias("zone"), "pixelID")
    return out, small.join(taken, ["zone", "pixelID"], "left_anti")
