"""Registered queries of model fits, fuel classes, zones and the operators around them, with SQL twins where SQL has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyrocell.functions import columns as C
from pyrocell.grid import GridSpec
from pyrocell.operators import covariates as H
from pyrocell.operators import fires as N
from pyrocell.operators import fits as M
from pyrocell.operators import provinces as R
from pyrocell.operators import spatial as D
from pyrocell.operators import summaries as E
from pyrocell.operators import tables as T
from pyrocell.plans.queries import CLASSES, FUEL_BODY, NROW, PLACED, compact_fires, fire_grid, fire_starts, fuel_layers, grid_of, query, r6
from pyrocell.storage import materialise

# names, years, windows


@query("""WITH e AS (SELECT speciesCode AS species, FuelClass, min(speciesCode) OVER (PARTITION BY FuelClass) AS assignedFuelClass FROM spp_equiv),
 a AS (SELECT *, concat(substr(concat(substr(split_part(species, '_', 1), 1, 1), regexp_replace(substr(split_part(species, '_', 1), 2), '[aeiou]', '', 'g')), 1, 2), '_', substr(split_part(species, '_', 2), 1, 2)) AS n FROM e)
 SELECT species, assignedFuelClass, CASE WHEN species <> assignedFuelClass THEN (SELECT string_agg(b.n, '.' ORDER BY b.species) FROM a b WHERE b.assignedFuelClass = a.assignedFuelClass AND b.species <> b.assignedFuelClass) ELSE assignedFuelClass END AS name FROM a""")
def abbreviate_species(v):
    e = v.spp_equiv
    first = e.groupBy("FuelClass").agg(F.min("speciesCode").alias("assignedFuelClass"))
    table = e.join(first, "FuelClass").select(F.col("speciesCode").alias("species"), F.col("speciesCode").alias("pos"), "assignedFuelClass")
    return C.abbreviate_species(table).drop("pos")


@query("SELECT pixelID, year, MDC, concat('year', year) AS token FROM climate")
def split_by_year(v):
    return T.split_by_year(v.climate.select("pixelID", "year", "MDC"))


@query("""WITH s AS (SELECT pixelID, r, c, flammable, CASE WHEN lcc <> 4 THEN lcc END AS lcc FROM cell), n AS (SELECT a.pixelID, b.lcc, count(*) AS k FROM s a JOIN s b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 WHERE a.lcc IS NULL AND b.lcc IS NOT NULL GROUP BY a.pixelID, b.lcc),
 m AS (SELECT pixelID, lcc, row_number() OVER (PARTITION BY pixelID ORDER BY k DESC, lcc) AS o FROM n) SELECT s.pixelID, coalesce(s.lcc, m.lcc) AS lcc FROM s LEFT JOIN m ON m.pixelID = s.pixelID AND m.o = 1 WHERE s.flammable IS NOT NULL""")
def focal_modal_fill(v):
    layer = v.cell.select("pixelID", F.when(F.col("lcc") != 4, F.col("lcc")).alias("lcc"))
    return D.focal_modal_fill(layer, grid_of(v), "lcc", 5, v.cell.where("flammable IS NOT NULL"))


@query("SELECT pixelID, CAST(floor(nf_low * 1000 + 0.5) AS INT) AS nf_low, CAST(floor(nf_high * 1000 + 0.5) AS INT) AS nf_high FROM landcover")
def covs_x1000_static(v):
    return T.covs_x1000(v.climate, v.landcover, v.fire_buffered, v.historical, ["CMDsm", "MDC", "nf_low"])[1]


@query("SELECT pixelID, year, MDC / (SELECT pow(10.0, floor(log10(max(MDC)))) FROM climate) AS MDC FROM climate")
def rescale_covariates_magnitude(v):
    return H.rescale_covariates(v.climate.select("pixelID", "year", F.col("MDC").cast("double").alias("MDC")), "glm")[0]


# covariates

LOGS = ", ".join(f"round(ln(greatest({k}, exp(ln(100.0) - 1))), 6) AS {k}" for k in CLASSES)


@query(f"""WITH {FUEL_BODY}, j AS (SELECT l.nf_low, l.nf_high, f.*, c.age FROM landcover l JOIN fuel f ON f.pixelID = l.pixelID JOIN cell c ON c.pixelID = l.pixelID),
 z AS (SELECT *, CASE WHEN nf_low + nf_high + youngAge + {" + ".join(CLASSES)} = 0 THEN 1 ELSE nf_high END AS hi FROM j),
 y AS (SELECT *, CASE WHEN youngAge <> 0 THEN 0 ELSE nf_low END AS lo2, CASE WHEN youngAge <> 0 THEN 0 ELSE hi END AS hi2 FROM z)
 SELECT pixelID, lo2 AS nf_low, hi2 AS nf_high, {LOGS}, CASE WHEN coalesce(age <= 15 AND lo2 + hi2 > 0, FALSE) THEN 1 ELSE youngAge END AS youngAge FROM y""")
def covariates_create(v):
    tsd = v.cell.select("pixelID", F.col("age").alias("tsd"))
    out = H.covariates_create(fuel_layers(v), v.landcover, CLASSES, {"youngAge": ["^nf_"]}, "nf_high", tsd)
    return out.withColumns({c: r6(c) for c in CLASSES})


@query(f"""WITH p AS (SELECT CAST(floor(-y / 10000) AS BIGINT) AS r, CAST(floor(x / 10000) AS BIGINT) AS c, arg_min(SIZE_HA, FIRE_ID) AS v FROM fire_points GROUP BY 1, 2),
 g AS (SELECT r.i AS r, c.i AS c, p.v FROM range(0, CAST(ceil({NROW} / 40.0) AS BIGINT)) r(i) CROSS JOIN range(0, 3) c(i) LEFT JOIN p ON p.r = r.i AND p.c = c.i),
 f AS (SELECT a.r, a.c, coalesce(any_value(a.v), avg(b.v)) AS v FROM g a LEFT JOIN g b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c)
 SELECT CAST(k.i AS BIGINT) AS pixelID, round(f.v, 6) AS size FROM range(1, 100 * {NROW} + 1) k(i) JOIN f ON f.r = CAST(floor((floor((k.i - 1) / 100) + 0.5) / 40) AS BIGINT) AND f.c = CAST(floor(((k.i - 1) % 100 + 0.5) / 40) AS BIGINT)""")
def lightning_grid(v):
    g = grid_of(v)
    return H.lightning_grid(v.points, g, GridSpec(0.0, 0.0, 10000.0, 10000.0, 3, -(-g.nrow // 40)), "size").withColumn("size", r6("size"))


@query("SELECT pixelID, year, round((MDC * 0.01 + CMDsm * 0.002) * 0.25 * 1.5, 6) AS ignition FROM climate")
def predict_ignition(v):
    response = F.col("MDC") * 0.01 + F.col("CMDsm") * 0.002
    return H.predict_ignition(v.climate, response, 0.25, 1.5).select("pixelID", "year", r6("ignition").alias("ignition"))


@query(f"""WITH p AS ({PLACED}), q AS (SELECT point_id, (pixelID - 1) % 100 AS c, CAST(floor((pixelID - 1) / 100) AS BIGINT) AS r FROM p WHERE pixelID IS NOT NULL),
 o AS (SELECT a.d AS dr, b.d AS dc FROM (SELECT unnest(range(-2, 3)) AS d) a, (SELECT unnest(range(-2, 3)) AS d) b WHERE a.d * a.d + b.d * b.d <= 4)
 SELECT point_id, round(avg(k.age), 6) AS age FROM q CROSS JOIN o JOIN cell k ON k.pixelID = (q.r + dr) * 100 + q.c + dc + 1 WHERE q.c + dc BETWEEN 0 AND 99 AND q.r + dr >= 0 GROUP BY point_id""")
def mean_around_points(v):
    return H.mean_around_points(v.points, v.cell, 500.0, grid_of(v), "age").withColumn("age", r6("age"))


# fuel classes


def landscape(v):
    return H.fuel_class_prep(v.cohort, v.cell, v.burn_year, (0, 8), (1, 2), 1995, 1997)


@query()
def cluster_nonforest(v):
    b = v.burn_year.select("pixelID").distinct().withColumn("burned", F.lit(1))
    rates = E.nonforest_burn_rate(v.cell.join(b, "pixelID", "left").na.fill(0, ["burned"]), [1, 2, 3, 4, 5])
    return M.cluster_nonforest(rates, 2)


ABUNDANCE = """l AS (SELECT p.pixelID, c.speciesCode, e.FuelClass, c.B FROM cell p JOIN cohort c ON c.pixelGroup = p.pixelGroup JOIN spp_equiv e USING (speciesCode)), t AS (SELECT pixelID, sum(B) AS tb FROM l GROUP BY pixelID),
 ab AS (SELECT speciesCode, FuelClass, sum(CASE WHEN B / tb > 0.1 THEN 1 ELSE 0 END) / (SELECT count(*) FROM t) AS relAbundance FROM l JOIN t USING (pixelID) GROUP BY ALL)"""


def abundance(v):
    return E.relative_abundance(T.expand_cohorts_to_pixels(v.cohort, v.cell.select("pixelID", "pixelGroup")).join(v.spp_equiv, "speciesCode").withColumn("year", F.lit(2001)))


@query(f"""WITH {ABUNDANCE}, f AS (SELECT speciesCode, round((avg(age) - 25) / 100, 6) AS coef, (count(*) % 3) / 1500.0 AS p FROM cohort GROUP BY speciesCode)
 SELECT speciesCode, coef, round(p, 6) AS p, CASE WHEN p >= 0.001 THEN 'neutral' WHEN coef > 0 THEN 'positive' ELSE 'negative' END AS sign, FuelClass, round(relAbundance, 6) AS relAbundance FROM f LEFT JOIN ab USING (speciesCode)""")
def species_stats(v):
    fits = v.cohort.groupBy("speciesCode").agg(r6((F.avg("age") - 25) / 100).alias("coef"), (F.count("*") % 3 / F.lit(1500.0)).alias("p"))
    return E.species_stats(fits, abundance(v)).withColumns({"p": r6("p"), "relAbundance": r6("relAbundance")})


@query()
def combine_fuel_classes(v):
    """A study area for each tenth of the pixel groups."""
    area = F.floor(F.col("pixelGroup") % 10).cast("int")
    s = v.cohort.groupBy(area.alias("area"), F.col("speciesCode").alias("species")).agg(((F.avg("age") - 25) / 100).alias("coef"), (F.sum((F.col("B") > 50000).cast("int")) / F.count("*")).alias("above"))
    s = s.join(v.spp_equiv.withColumnRenamed("speciesCode", "species"), "species").withColumn("sign", F.when(F.abs("coef") < 0.002, "neutral").when(F.col("coef") > 0, "positive").otherwise("negative"))
    return M.combine_fuel_classes(s.withColumn("pos", F.col("species")), 4)


@query()
def assess_fuel_classes(v):
    """All three tables under each other."""
    classes, groups, missing = M.assess_fuel_classes(landscape(v), v.spp_equiv, [1, 2, 3])
    none = F.lit(None).cast("string")
    rows = [classes.select(F.lit("fuel").alias("part"), F.col("species").alias("name"), "FuelClass", F.col("assignedFuelClass").alias("group"), F.col("N").cast("long").alias("n"))]
    rows.append(groups.select(F.lit("nonforest").alias("part"), F.col("lcc").cast("string").alias("name"), none.alias("FuelClass"), "group", F.lit(None).cast("long").alias("n")))
    rows.append(missing.select(F.lit("missing").alias("part"), none.alias("name"), none.alias("FuelClass"), "group", F.lit(None).cast("long").alias("n")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# burn classes, ignitions


def burn_table(v):
    """Written once: the fit, the classes and their means all read it."""
    b = v.burn_year.select("pixelID").distinct().withColumn("burned", F.lit(1))
    return materialise(v.cell.join(b, "pixelID", "left").na.fill(0, ["burned"]).select("pixelID", F.col("age").cast("double").alias("age"), F.col("lcc").cast("double").alias("lcc"), F.col("burned").cast("double").alias("burned")))


BURN = ["age", "lcc", "burned"]


def burn_model(table):
    return M.burn_class_fit(table.randomSplit([0.75, 0.25], 42)[0], BURN)[0]


@query()
def burn_class_summary(v):
    table = burn_table(v)
    return M.burn_class_summary(M.burn_class_predict(burn_model(table), table, BURN), BURN)


@query()
def burn_prob_from_class(v):
    """New rows don't know burned: their class comes from the other columns."""
    table = burn_table(v)
    model = burn_model(table)
    summary = M.burn_class_summary(M.burn_class_predict(model, table, BURN), BURN)
    return M.burn_prob_from_class(M.burn_class_predict(model, table.drop("burned"), ["age", "lcc"]), summary)


@query()
def burn_class_auc(v):
    return M.burn_class_auc(burn_table(v), BURN, ["age", "lcc"])


@query("""SELECT param_id, CASE WHEN bool_or(b1 + b2 * greatest(nf_low - b2, 0) < 0) THEN 1e20 ELSE round(sum(b1 + b2 * greatest(nf_low - b2, 0) - nf_high * ln(greatest(b1 + b2 * greatest(nf_low - b2, 0), 1e-300))), 3) END AS nll FROM landcover CROSS JOIN candidates GROUP BY param_id""")
def ignition_nll_pw(v):
    out = E.ignition_nll(v.landcover.withColumn("one", F.lit(1)), v.candidates.withColumn("knot", F.col("b2")), "nf_high", ["one", "nf_low"], ["b1", "b2"], knots={"nf_low": "knot"})
    return out.withColumn("nll", F.round("nll", 3))


@query("""WITH m AS (SELECT param_id, nf_high, 1 / (1 + exp(-(b1 - 1 + b2 * nf_low))) AS mu FROM landcover CROSS JOIN candidates)
 SELECT param_id, CASE WHEN bool_or(mu <= 0 OR mu > 1) THEN 1e20 ELSE round(sum(-nf_high * ln(mu) - (1 - nf_high) * ln(1 - mu)), 3) END AS nll FROM m GROUP BY param_id""")
def ignition_nll_binomial(v):
    out = E.ignition_nll(v.landcover.withColumn("one", F.lit(1)), v.candidates, "nf_high", ["one", "nf_low"], ["b1", "b2"], offset=-1.0, family="binomial", link="logit")
    return out.withColumn("nll", F.round("nll", 3))


@query()
def search_ignition(v):
    """Counts by dryness over a knot."""
    table = ignition_table(v).withColumn("one", F.lit(1.0))
    return M.search_ignition(table, "ignitions", ["one", "MDC"], {"level": (0.001, 2.0), "slope": (0.0, 2.0), "knot": (0.0, 150.0)}, {"MDC": "knot"}, rounds=6)


def coefficients(v, model, names):
    return v.spark.createDataFrame([("intercept", float(model.intercept)), *((n, float(c)) for n, c in zip(names, model.coefficients))], "term string, coef double")


def ignition_table(v):
    return H.stack_and_extract(v.climate.select("pixelID", "year", "MDC", "CMDsm"), v.landcover, v.fire_buffered.select("pixelID", "year"), range(1992, 1999)).withColumns({"MDC": F.col("MDC") / 100, "CMDsm": F.col("CMDsm") / 100})


@query()
def fit_ignition(v):
    return coefficients(v, M.fit_ignition(ignition_table(v), "ignitions", ["MDC", "CMDsm"]), ["MDC", "CMDsm"])


@query()
def fit_escape(v):
    t = ignition_table(v).withColumn("escaped", (F.col("ignitions") > 1).cast("double"))
    return coefficients(v, M.fit_ignition(t, "escaped", ["MDC", "nf_low"], "binomial", "logit"), ["MDC", "nf_low"])


@query()
def ignition_response(v):
    t = ignition_table(v)
    return M.ignition_response(M.fit_ignition(t, "ignitions", ["MDC", "CMDsm"]), t, ["MDC", "CMDsm"]).select("pixelID", "year", "fitted")


# fires and zones


@query()
def harmonize_fire_data(v):
    g = fire_grid(v)
    at = fire_starts(v, g)
    points = at.select(F.col("ids").alias("point_id"), "year", "ids", g.x(F.col("pixelID")).alias("x"), g.y(F.col("pixelID")).alias("y"))
    fires = materialise(compact_fires(v, g))  # these three are read again and again
    points = materialise(points.join(fires.select("year", "ids").distinct(), ["year", "ids"], "left_semi"))
    flammable = materialise(fires.select("pixelID").distinct().select("pixelID", (F.col("pixelID") % 11 != 0).cast("int").alias("flammable")))
    buffers, placed = N.harmonize_fire_data(fires, points, flammable, g, lambda n: n * 2, 8)
    buffers = buffers.select(F.lit("buffers").alias("part"), "year", "ids", "pixelID", "buffer", F.lit(None).cast("long").alias("point_id"))
    return buffers.unionByName(placed.select(F.lit("points").alias("part"), "year", "ids", "pixelID", F.lit(None).cast("int").alias("buffer"), "point_id"))


@query()
def buffer_zones(v):
    return D.buffer_zones(v.zone.where("v = 2").select("zone", "pixelID"), 500.0, grid_of(v))


@query()
def drop_small_patches(v):
    return D.drop_small_patches(v.zone.where("v = 2").select("zone", "pixelID"), grid_of(v), 5)


def broken_provinces(v):
    """Provinces of 20 columns, each of many patches."""
    return v.cell.where("flammable = 1 AND lcc <> 4").select(F.floor(F.col("c") / 20).cast("int").alias("zone"), "pixelID")


@query()
def convex_hulls(v):
    g = grid_of(v)
    return R.convex_hulls(v.zone.where("v = 2").select("zone", g.x(F.col("pixelID")).alias("x"), g.y(F.col("pixelID")).alias("y")), ["zone"])


@query()
def merged_provinces(v):
    return R.merged_provinces(broken_provinces(v), grid_of(v))


@query()
def split_large_zones(v):
    g = grid_of(v)
    cells = v.zone.where("v = 2").select("zone", "pixelID", g.x(F.col("pixelID")).alias("x"), g.y(F.col("pixelID")).alias("y"))
    return R.split_large_zones(cells, g.ncell // 4)


@query()
def make_zones(v):
    """Provinces of 20 columns, with gaps, in the flammable land."""
    g = grid_of(v)
    layer = v.cell.select("pixelID", F.when(F.col("lcc") != 4, F.floor(F.col("c") / 20).cast("int")).alias("zone"))
    zones, lost = M.make_zones(layer, v.cell.where("flammable IS NOT NULL"), g, 500.0, g.ncell // 8, 20)
    return zones.withColumn("lost", F.lit(0)).unionByName(lost.withColumn("lost", F.lit(1)), allowMissingColumns=True)
