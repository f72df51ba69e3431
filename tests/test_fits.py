import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pyrocell.operators import fits as M
from pyrocell.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_fuel_glm(spark):
    rows = [("a", float(100 * (i % 7)), int((i * 7 + i % 5) % 3 == 0)) for i in range(60)]
    got = {r.speciesCode: r for r in M.fit_fuel_glm(spark.createDataFrame([*rows, ("c", 1.0, 1)], "speciesCode string, B double, burned int"), ["a", "c", "d"]).collect()}
    assert abs(got["a"].coef + 0.134591) < 1e-5 and got["c"].coef is None and got["d"].p is None


def test_nonforest_groups(spark):
    rates = spark.createDataFrame([("1", 0.1), ("2", 0.11), ("5", 0.9), ("missingForest", 0.8)], "lcc string, coef double")
    assert {r.lcc: r.group for r in M.cluster_nonforest(rates, 2).collect()} == {"1": "nfLCC_1_2", "2": "nfLCC_1_2", "5": "nfLCC_5", "missingForest": "nfLCC_5"}
    assert M.cluster_nonforest(rates.limit(0), 2).count() == 0


KINDS = ["spruce", "pine", "leaf", "leaf", "fir", "fir", "fir"]
NAMES = ["Pica_nig", "Pina_con", "Pope_tri", "Beta_pum", "Pico_eng", "Pico_alb", "Abia_lat"]
COEFS = [-0.012, 0.002, -0.02, -0.002, -0.018, -0.009, -0.005]
SHARES = [0.07, 0.6, 0.2, 0.06, 0.1, 0.3, 0.5]


def assigned(spark, names=NAMES, kinds=KINDS, coefs=COEFS, shares=SHARES, neutral=(), **how):
    rows = [("q", i, n, k, c, "neutral" if n in neutral else "positive" if c > 0 else "negative", s) for i, (n, k, c, s) in enumerate(zip(names, kinds, coefs, shares))]
    # a second area of the same species must not mix with the first
    rows += [("other", *r[1:]) for r in rows]
    table = spark.createDataFrame(rows, "area string, pos int, species string, FuelClass string, coef double, sign string, above double")
    got = [(r.species, r.assignedFuelClass, r.N) for r in M.combine_fuel_classes(table, **how).where("area = 'q'").collect()]
    assert len(got) == len(names) and all(n == sum(x == c for _, x, _ in got) for _, c, n in got)
    return {s: c for s, c, _ in got}


def test_fuel_classes_merge_inside_their_class(spark):
    got = assigned(spark)
    assert got["Beta_pum"] == got["Pope_tri"] == "Bt_pu.Pp_tr" and got["Pico_eng"] == got["Pico_alb"] == "Pc_en.Pc_al" and got["Abia_lat"] == "Abia_lat"
    assert got["Pica_nig"] == "Pica_nig" and got["Pina_con"] == "Pina_con"


def test_fuel_classes_respect_the_sign(spark):
    got = assigned(spark, coefs=[*COEFS[:2], 0.02, 0.002, *COEFS[4:]][:2] + [-0.02, 0.002] + COEFS[4:])
    assert got["Beta_pum"] == "Beta_pum" and got["Abia_lat"] == got["Pico_alb"] == got["Pico_eng"]
    assert assigned(spark, coefs=[*COEFS[:2], -0.02, 0.002, *COEFS[4:]], neutral=["Beta_pum"])["Beta_pum"] == "Bt_pu.Pp_tr"


def test_sparse_species_join_first_whatever_their_sign(spark):
    coefs, shares = [*COEFS[:2], 0.02, *COEFS[3:]], [*SHARES[:3], 0.04, *SHARES[4:]]
    got = assigned(spark, coefs=coefs, shares=shares)
    assert got["Beta_pum"] == got["Pope_tri"] == "Bt_pu.Pp_tr" or got["Beta_pum"] == got["Pope_tri"] == "Pp_tr.Bt_pu"
    assert got["Pico_eng"] == got["Pico_alb"] != got["Abia_lat"]


def test_the_sparse_friend_is_the_scarcest_of_like_sign(spark):
    names, kinds = ["Popo_bal", "Betu_all", *NAMES[1:]], ["leaf", "leaf", *KINDS[1:]]
    coefs, shares = [0.013, -0.02, 0.002, 0.02, 0.002, -0.018, -0.009, -0.005], [0.07, 0.06, 0.6, 0.2, 0.04, 0.1, 0.3, 0.5]
    got = assigned(spark, names, kinds, coefs, shares)
    assert got["Beta_pum"] == got["Popo_bal"] == got["Pope_tri"] != got["Betu_all"] == "Betu_all" and got["Pico_eng"] == got["Pico_alb"]
    wide = assigned(spark, names, kinds, coefs, shares, low=0.11)
    assert wide["Betu_all"] != "Betu_all" and len(set(wide.values())) == 4


def test_all_species_are_kept_apart_if_they_are_few(spark):
    assert assigned(spark, NAMES[:3], KINDS[:3], COEFS[:3], SHARES[:3]) == dict(zip(NAMES[:3], NAMES[:3]))


def test_slivers_go_where_the_count_changes_least(spark):
    cells = lambda rows: spark.createDataFrame(rows, "zone int, pixelID long, v int")
    zones = cells([(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (2, 3, 2), (3, 3, 2)])
    lost = cells([(9, 1, 2), (9, 2, 1), (9, 3, 1), (8, 3, 1), (8, 7, 2)])
    got = {(r.zone, r.pixelID): (r.v, r.lost_by) for r in M.slivers_reassigned(zones, lost).collect()}
    assert got[2, 2] == (1, 9) and got[2, 1] == (2, 9) and got[2, 3] == (2, 9) and got[1, 1] == (1, None) and not any(by == 8 for _, by in got.values())


def test_classes_without_the_unknown_column(spark):
    rng = np.random.default_rng(1)
    rows = [(float(c * 20 + rng.normal()), float(c * 5 + rng.normal()), float(c == 1)) for c in (0, 1) for _ in range(200)]
    table = spark.createDataFrame(rows, "a double, b double, burned double")
    model, k = M.burn_class_fit(table.withColumn("burned", F.col("burned") + F.rand(3) / 100), ["a", "b", "burned"], (2,))
    known = M.burn_class_predict(model, table.drop("burned"), ["a", "b"])
    got = {(r.a > 10, r.burnClass) for r in known.collect()}
    assert k == 2 and len(got) == 2
    summary = M.burn_class_summary(M.burn_class_predict(model, table, ["a", "b", "burned"]), ["a", "b", "burned"])
    assert {round(r.burnProb) for r in M.burn_prob_from_class(known, summary).where("a > 10").collect()} == {1}


def test_ignition_fit_equals_reweighted_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(1, 3, 300)
    y = rng.poisson(0.5 + 2 * x)
    model = M.fit_ignition(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int"), "y", ["x"])
    X, beta = np.stack([np.ones_like(x), x], 1), np.array([1.0, 1.0])
    for _ in range(100):
        w = 1 / np.maximum(X @ beta, 1e-6)
        beta = np.linalg.solve((X.T * w) @ X, (X.T * w) @ y)
    assert np.allclose([model.intercept, model.coefficients[0]], beta, atol=1e-4)


def test_slivers_equal_sql(spark):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "supplier", "part", "nation", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT zone, pixelID, v, lost_by FROM ({ORACLES['slivers_reassigned']})").fetchall()
    got = [tuple(r) for r in QUERIES["slivers_reassigned"](spark, SF).select("zone", "pixelID", "v", "lost_by").collect()]
    assert len(want) > 0 and sorted(map(str, got)) == sorted(map(str, want))


def test_fuel_glm_query(spark):
    assert QUERIES["fit_fuel_glm"](spark, SF).count() == 6


def test_regressions_of_all_groups_equal_sparks(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    from pyrocell.operators.regressions import logistic_by

    rng = np.random.default_rng(3)
    rows = [(g, float(x), int(rng.random() < 1 / (1 + np.exp(-(a + b * x))))) for g, a, b in (("a", -1, 0.5), (None, 0.3, -1.2), ("c", 0, 0)) for x in rng.normal(1, 2, 150).round(2)]
    rows += [("one", 1.0, 1)] * 3 + [("a", None, 1), ("a", 1.0, None)]
    table = spark.createDataFrame(rows, "g string, x double, y int")
    got = {r.g: r for r in logistic_by(table, ["g"], "x", "y").collect()}
    assert got["one"].coef is None and got["one"].p is None and len(got) == 4
    for g in ("a", None, "c"):
        own = VectorAssembler(inputCols=["x"], outputCol="v").transform(table.where(F.col("g").eqNullSafe(F.lit(g))).dropna(subset=["x", "y"]))
        model = GeneralizedLinearRegression(family="binomial", featuresCol="v", labelCol="y", tol=1e-12).fit(own)
        assert np.allclose([got[g].intercept, got[g].coef, got[g].p], [model.intercept, model.coefficients[0], model.summary.pValues[0]], atol=1e-6)
    assert logistic_by(table.limit(0), ["g"], "x", "y").count() == 0


def test_the_number_of_burn_classes_is_found(spark):
    rng = np.random.default_rng(8)
    centres = [(0, 0), (12, 1), (1, 14), (15, 15), (-14, 8)]
    points = np.concatenate([rng.normal(c, 1.0 + i / 4, (240, 2)) for i, c in enumerate(centres)])
    table = spark.createDataFrame([(float(a), float(b)) for a, b in points] + [(None, 1.0)], "a double, b double")
    model, k = M.burn_class_fit(table, ["a", "b"])
    assert k == 5 and sorted(map(tuple, model.means.round().astype(int).tolist())) == sorted(centres)
    assert np.allclose(model.weights, 0.2, atol=0.01)
    classed = {(r.a, r.b): r.burnClass for r in M.burn_class_predict(model, table, ["a", "b"]).collect()}
    density = model.log_densities(points)
    assert [classed[tuple(p)] for p in points.tolist()] == density.argmax(axis=1).tolist()


def test_held_out_auc_of_burn_classes(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal(10 * c, 1)), float(rng.normal(c, 1)), float(rng.random() < 0.1 + 0.8 * (c == 1))) for c in (0, 1) for _ in range(300)]
    got = M.burn_class_auc(spark.createDataFrame(rows, "a double, b double, burned double"), ["a", "b", "burned"], ["a", "b"], (2, 3)).first().auc
    assert 0.75 < got <= 1


def test_binomial_likelihood_and_links(spark):
    from pyrocell.operators import summaries as E

    rng = np.random.default_rng(6)
    x, y = rng.uniform(0, 1, 50), rng.integers(0, 2, 50)
    table = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int").withColumn("one", F.lit(1))
    candidates = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-1.5, 1.5, (1500, 2)))]
    got = {r.param_id: r.nll for r in E.ignition_nll(table, spark.createDataFrame(candidates, "param_id int, a double, b double"), "y", ["one", "x"], ["a", "b"], family="binomial", link="logit", block=700).collect()}
    for i, a, b in candidates:
        mu = 1 / (1 + np.exp(-(a + b * x)))
        assert np.isclose(got[i], -(y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum())
    some = spark.createDataFrame([(0, 0.5, 0.6), (1, 0.5, 0.1)], "param_id int, a double, b double")
    shares = {r.param_id: r.nll for r in E.ignition_nll(table, some, "y", ["one", "x"], ["a", "b"], family="binomial").collect()}
    assert shares[0] == 1e20 and shares[1] < 1e3


def test_a_planted_knot_is_found(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 10, 4000)
    y = rng.poisson(0.5 + 1.5 * np.maximum(x - 4, 0))
    table = spark.createDataFrame([(1.0, float(a), int(b)) for a, b in zip(x, y)], "one double, x double, y int")
    got = {r.term: r.value for r in M.search_ignition(table, "y", ["one", "x"], {"level": (0.01, 3.0), "slope": (0.0, 4.0), "knot": (0.0, 10.0)}, {"x": "knot"}, rounds=12).collect()}
    assert abs(got["knot"] - 4) < 0.15 and abs(got["slope"] - 1.5) < 0.08 and abs(got["level"] - 0.5) < 0.08
    held = {r.term: r.value for r in M.search_ignition(table, "y", ["one", "x"], {"level": (0.01, 3.0), "slope": (0.0, 1.0), "knot": (2.0, 2.0)}, {"x": "knot"}, rounds=8).collect()}
    assert held["slope"] <= 1.0 and held["knot"] == 2.0


def test_equal_rows_are_scored_once(spark, monkeypatch):
    """Counts, nulls among them, stand for the rows: the likelihood is that of all, the work that of the distinct ones."""
    from pyrocell.operators import summaries as E

    scored = spark.sparkContext.accumulator(0)

    def link(eta):
        scored.add(eta.size)
        return eta

    monkeypatch.setitem(E.LINKS, "noted", link)
    table = spark.range(10000).select(F.lit(1.0).alias("one"), (F.col("id") % 2).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("y"))
    candidates = spark.createDataFrame([(0, 0.5, 0.25), (1, 0.5, -0.5)], "param_id int, a double, b double")
    got = {r.param_id: r.nll for r in E.ignition_nll(table, candidates, "y", ["one", "x"], ["a", "b"], link="noted").collect()}
    want = sum(0.5 + 0.25 * (i % 2) - i % 3 * math.log(0.5 + 0.25 * (i % 2)) for i in range(10000) if i % 5)
    assert math.isclose(got[0], want, rel_tol=1e-9) and got[1] == 1e20
    assert scored.value == 2 * 8


def test_equal_rows_take_part_in_a_mixture_once(spark, monkeypatch):
    """A row that occurs several times is one row of that weight in the same mixture."""
    from pyrocell.operators import mixtures as X

    seen, sums = [], X._sums

    def noted(data, models):
        seen.append(data.count())
        return sums(data, models)

    monkeypatch.setattr(X, "_sums", noted)
    distinct = [(float(i % 7 + 20 * (i % 2)), float(i % 5)) for i in range(70)]
    table = spark.createDataFrame([r for i, r in enumerate(distinct) for _ in range(1 + 30 * (i % 3))], "a double, b double")
    ((bic, _, got),) = X.fit_mixtures(table, ["a", "b"], [2], rounds=1)
    assert seen == [70, 70]
    x = np.array([r for i, r in enumerate(distinct) for _ in range(1 + 30 * (i % 3))])
    p = got.log_densities(x)
    assert math.isclose(bic, 2 * np.log(np.exp(p).sum(1)).sum() - 11 * math.log(len(x)), rel_tol=1e-9)
    assert np.allclose(got.weights.sum(), 1) and np.allclose(got.weights @ got.means, x.mean(0))
