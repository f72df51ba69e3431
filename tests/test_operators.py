import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyrocell.functions import columns as C
from pyrocell.grid import GridSpec
from pyrocell.operators import covariates as H
from pyrocell.operators import fires as N
from pyrocell.operators import spatial as D
from pyrocell.operators import summaries as E
from pyrocell.operators import tables as T
from pyrocell.operators import zones as Z
from pyrocell.operators.ranks import quantiles

GRID = GridSpec(0, 0, 1, 1, 10, 10)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_column_functions(spark):
    assert [one(spark, C.oom(F.lit(x))) for x in (11.0, 0.5, -50.0)] == [100, 1, 100]
    assert one(spark, C.pw(F.lit(7.0), 5.0)) == 2
    assert one(spark, C.log_min_b(F.lit(0.0))) == pytest.approx(3.605170185988092)
    assert one(spark, C.logistic2p(F.lit(0.0), [1.0, 1.0], 0.2, 1.0)) == pytest.approx(0.6)
    assert [one(spark, C.multiplier(F.lit(x), 1)) for x in (1e6,)] == [5e6]
    with pytest.raises(ValueError):
        C.logistic_all([], [1, 2, 3, 4], [])


def test_cast_cohort_data(spark):
    groups = {1: 4, 2: None, 3: 6, 4: 4, 5: 9, 6: None}
    pixels = spark.createDataFrame(list(groups.items()), "pixelID long, pixelGroup long")
    cohort = spark.createDataFrame([(4, "oak", 15, 7.0), (4, "oak", 3, 2.0), (4, "elm", 8, 1.5), (6, "elm", 90, 4.0)], "pixelGroup long, speciesCode string, age int, B double")
    land = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0), (5, 0, 0), (6, 0, 1)], "pixelID long, low int, high int")
    ages = spark.createDataFrame([(2, 12), (5, 40)], "pixelID long, age int")
    got = {r.pixelID: (r.low, r.high, r.oak, r.elm, r.youngAge, r.year) for r in H.cast_cohort_data(cohort, pixels, land, ["oak", "elm"], "high", ages, 2005).collect()}
    assert got == {
        1: (0, 0, 9.0, 1.5, 1, 2005), 2: (0, 1, None, None, 1, 2005), 3: (1, 0, 0.0, 4.0, 0, 2005), 5: (0, 0, None, None, 0, 2005), 6: (0, 1, None, None, None, 2005),
    }


def test_dedupe_start_pixels(spark):
    f = spark.createDataFrame([(8, 3, 1), (8, 3, 0), (9, 1, 2), (9, 6, 5), (4, 2, 7)], "cells int, size int, ids int")
    assert sorted((r.cells, r["size"], r.ids) for r in T.dedupe_start_pixels(f).collect()) == [(4, 2, 7), (8, 3, 0), (9, 6, 5)]
    assert T.dedupe_start_pixels(f.limit(0)).count() == 0


def test_patches_against_flood_fill(spark):
    cells = {1, 2, 11, 15, 25, 26, 99, 100, 37}
    got = {r.pixelID: r.patch for r in D.patches(spark.createDataFrame([(c,) for c in cells], "pixelID long"), GRID, 4).collect()}
    assert got == {1: 1, 2: 1, 11: 1, 15: 15, 25: 15, 26: 15, 99: 99, 100: 99, 37: 37}


def test_growth_hits_its_goal(spark):
    fires = spark.createDataFrame([(2001, 7, 45), (2001, 7, 46)], "year int, ids long, pixelID long")
    out = N.buffer_to_area(fires, GRID, area=lambda n: n * 5, min_size=1).collect()
    assert len(out) == 10 and sum(r.buffer for r in out) == 2


def test_young_age_equals_the_year_loop(spark):
    cells = spark.createDataFrame([(1, 14), (2, None), (3, 40)], "pixelID long, age int")
    burned = spark.createDataFrame([(3, 1995)], "pixelID long, year int")
    got = {(r.pixelID, r.year): r.youngAge for r in H.calc_young_age([1995, 1996, 1997], cells, burned).collect()}
    assert [got[1, y] for y in (1995, 1996, 1997)] == [1, 1, 0] and got[2, 1997] == 1 and [got[3, y] for y in (1995, 1996)] == [0, 1]


def test_zones(spark):
    zone = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 1, 1), (3, 2, 1), (1, 3, 0), (1, 4, None), (1, 9, 2)], "zone int, pixelID long, v int")
    got = Z.zones_in_study_area(zone, spark.range(1, 6).withColumnRenamed("id", "pixelID"), F.col("zone")).collect()
    assert {r.pixelID: r.code for r in got} == {1: 2, 2: 3, 3: 0}
    assert Z.zone_polygons(zone).count() == 5
    ids, fits = (spark.createDataFrame([(x,) for x in xs], "ID string") for xs in (["1.2", "3.1", "4.1", "4.1", None], ["3.1", "1.2", "3.1", None]))
    assert {r.ID: r.status for r in Z.zone_status(ids, fits).collect()} == {"1.2": 2, "3.1": 2, "4.1": 1, None: 1}
    assert [r.ID for r in Z.fitted_names(ids, fits).collect()] == ["3.1"]
    assert Z.zone_status(ids.limit(0), fits).count() == 0


def test_growth_against_a_loop_over_rings(spark):
    grid, rng = GridSpec(0, 0, 1, 1, 30, 30), np.random.default_rng(6)
    fires = {(2000 + y, i): {int(c) for c in [p, p + 1]} for y in (0, 1) for i, p in enumerate(rng.integers(1, 900, 12))}
    owner = {}
    for (y, i), cells in sorted(fires.items()):
        for c in cells:
            owner.setdefault((y, c), i)
    rows = [(y, i, c) for (y, c), i in owner.items()]
    goal, seen = {}, {}
    for y, i, c in rows:
        seen.setdefault((y, i), {})[c] = 0
    goal = {k: max(4 * len(v), 10) for k, v in seen.items()}
    out, ring, front = {}, 0, {k: set(v) for k, v in seen.items()}
    while front:
        ring += 1
        for k in [k for k in seen if len(seen[k]) > goal[k]]:
            order = sorted(seen[k], key=lambda c: (seen[k][c], c * 7919 % 104729, c))
            out[k] = {c: seen[k][c] == 0 for c in order[: goal[k]]}
            del seen[k]
        taken = {(k[0], c) for k, v in seen.items() for c in v}
        new = {}
        for k in sorted(seen):
            for c in front.get(k, ()):
                r, q = divmod(c - 1, 30)
                for a in range(r - 1, r + 2):
                    for b in range(q - 1, q + 2):
                        cell = a * 30 + b + 1
                        if 0 <= a < 30 and 0 <= b < 30 and (k[0], cell) not in taken:
                            new[k[0], cell] = min(new.get((k[0], cell), k[1]), k[1])
        front = {}
        for (y, c), i in new.items():
            front.setdefault((y, i), set()).add(c)
            seen[y, i][c] = ring
    best = {}
    for (y, i), cells in out.items():
        for c, burned in cells.items():
            best[y, c] = min(best.get((y, c), (2, 0)), (0 if burned else 1, i))
    table = spark.createDataFrame(rows, "year int, ids long, pixelID long")
    got = {(r.year, r.pixelID): (1 - r.buffer, r.ids) for r in N.buffer_to_area(table, grid, area=lambda n: n * 4, min_size=10).collect()}
    assert got == best and len(out) > 10


def test_zones_are_filled_and_buffered(spark):
    ring = [12, 13, 14, 22, 24, 32, 33, 34]
    zones = spark.createDataFrame([(1, c) for c in ring] + [(2, 13), (2, 100)], "zone int, pixelID long")
    got = {(r.zone, r.pixelID): r.v for r in D.buffer_zones(zones, 1.0, GRID).collect()}
    assert {c for (z, c), v in got.items() if z == 1 and v == 2} == {*ring, 23}
    assert {c for (z, c), v in got.items() if z == 1 and v == 1} == {2, 3, 4, 11, 15, 21, 25, 31, 35, 42, 43, 44}
    assert {c for (z, c), v in got.items() if z == 2} == {13, 3, 12, 14, 23, 100, 90, 99}
    assert D.buffer_zones(zones.limit(0), 1.0, GRID).count() == 0


def test_ranks_against_numpy(spark):
    rng = np.random.default_rng(9)
    score, label = rng.integers(0, 50, 400) / 7, rng.integers(0, 2, 400)
    table = spark.createDataFrame([(float(a), int(b)) for a, b in zip(score, label)], "s double, y int")
    high, low = score[label == 1], score[label == 0]
    want = ((high[:, None] > low).mean() + (high[:, None] == low).mean() / 2)
    assert E.auc(table, "s", "y").first().auc == pytest.approx(want)
    values = table.select(F.col("s").alias("value"), F.col("y").alias("sample"))
    both, n, m = np.sort(score), (label == 0).sum(), (label == 1).sum()
    ad = 0.0
    for v in np.unique(score)[:-1]:
        h, f = (both <= v).sum(), (low <= v).sum()
        ad += (both == v).sum() / 400 * (400 * f - n * h) ** 2 / (h * (400 - h))
    assert E.score_ad(values).first().ad == pytest.approx(ad * (1 / n + 1 / m) * 50)


def test_student_quantiles(spark):
    assert one(spark, C.t_critical(2.5758293035489004, F.lit(98))) == pytest.approx(2.6269, abs=1e-3)
    assert one(spark, C.t_critical(1.6448536269514722, F.lit(173))) == pytest.approx(1.6537, abs=1e-3)
    assert one(spark, C.t_critical(2.5758293035489004, F.lit(0))) is None


def test_null_keys_are_looked_up_as_nothing(spark):
    x = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    y = spark.createDataFrame([(1, 1), (None, 2), (3, 3)], "k int, w int")
    assert sorted((r.w, r.v) for r in T.lookup_keep_right(x, y, ["k"]).collect()) == [(1, "a"), (2, None), (3, None)]


def test_likelihood_in_blocks(spark):
    data = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 0.5, 0.0)], "one double, x double, y double")
    cand = spark.createDataFrame([(i, 0.5 * i, 1.0) for i in range(5)] + [(9, -5.0, 1.0)], "param_id int, a double, b double")
    got = {r.param_id: r.nll for r in E.ignition_nll(data, cand, "y", ["one", "x"], ["a", "b"], block=2).collect()}
    assert got[9] == 1e20
    for i in range(5):
        mu = [0.5 * i + 2.0, 0.5 * i + 0.5]
        assert got[i] == pytest.approx(sum(mu) - 3 * math.log(mu[0]))
    broken = data.union(spark.createDataFrame([(1.0, None, 1.0)], data.schema))
    assert {r.nll for r in E.ignition_nll(broken, cand, "y", ["one", "x"], ["a", "b"]).collect()} == {1e20}
    assert E.ignition_nll(data, cand.limit(0), "y", ["one", "x"], ["a", "b"]).count() == 0


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(g, None if i % 11 == 0 else float(v)) for g in ("a", "b", None) for i, v in enumerate(np.round(rng.normal(size=300), 1))] + [("lone", 2.5), ("void", None)]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"low": 0.025, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "lone", "void"}
    assert (got["void"].low, got["void"].mid) == (None, None)
    for g in ("a", "b", None, "lone"):
        values = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(got[g][1:], np.quantile(values, [0.025, 0.5, 1.0]))
    assert quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", {"mid": 0.5}).count() == 0


def test_time_since_disturbance_needs_a_fire_source(spark):
    cells = spark.createDataFrame([(1, 10), (2, 50), (3, None), (4, 5)], "pixelID long, age int")
    lcc = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1)], "pixelID long, low int, high int")
    with pytest.raises(ValueError, match="fire polygons or a raster of fire years"):
        H.make_tsd(cells, 2020, lcc=lcc)
    fires = spark.createDataFrame([(1, 2018), (2, 2025), (3, 2010), (4, 2018)], "pixelID long, fireYear int")
    with pytest.raises(ValueError, match="update, flammable"):
        H.make_tsd(cells.join(fires, "pixelID"), 2020)
    by_raster = {r.pixelID: r.tsd for r in H.make_tsd(cells.join(fires, "pixelID"), 2020, lcc=lcc).collect()}
    assert by_raster == {1: 2, 2: 50, 3: 10, 4: None}  # a fire to come is none; a pixel that isn't in the land cover has no value
    flags = cells.join(fires, "pixelID").withColumns({"update": F.col("pixelID") < 3, "flammable": F.lit(1)})
    assert {r.pixelID: r.tsd for r in H.make_tsd(flags, 2020, lcc=lcc).collect()} == {1: 2, 2: 50, 3: None, 4: 5}  # flags given beat the land cover
    square = [(1, 2010, s, x, y) for s, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, -1.0), (0.0, -1.0)])] + [(2, 1980, s, x, y) for s, (x, y) in enumerate([(0.0, 0.0), (9.0, 0.0), (9.0, -9.0), (0.0, -9.0)])]
    polygons = spark.createDataFrame(square, "poly_id int, YEAR int, seq int, x double, y double")
    got = {r.pixelID: r.tsd for r in H.make_tsd(cells, 2020, polygons=polygons, grid=GridSpec(0, 0, 1, 1, 4, 1), lcc=lcc).collect()}
    assert got == {1: 10, 2: 10, 3: 16, 4: None}  # cells of no age are outside the polygons' raster


def test_checks_name_what_is_wrong(spark):
    from pyrocell.sources import tables as A

    with pytest.raises(ValueError, match="fires is missing"):
        A.load_checks(None, ["size"], "fires")
    with pytest.raises(ValueError, match="fires lacks size"):
        A.load_checks(spark.range(3), ["size"], "fires")
    with pytest.raises(ValueError, match="fires has no rows"):
        A.load_checks(spark.range(0).withColumnRenamed("id", "size"), ["size"], "fires")
    annual = spark.createDataFrame([(1, 2001, 500_000)], "pixelID long, year int, MDC int")
    periods = spark.createDataFrame([(1, 2000, 1)], "pixelID long, start int, nf int")
    with pytest.raises(ValueError, match="MDC"):
        H.spread_covariates(annual, periods, {"MDC": (0.0, 400.0)}, {})
    covs = H.spread_covariates(annual, periods, {"MDC": (0.0, 600.0)}, {})
    with pytest.warns(UserWarning, match="should be lowered"):
        H.spread_probability(covs, ["MDC"], [0.5, 1.0], [2.0])


def test_beta_draws(spark):
    rows = spark.range(40_000).select("id", C.rbeta_between(F.col("id"), F.lit(1.0), F.lit(5.0), F.lit(2.0), 2.0).alias("a"), C.rbeta_between(F.col("id"), F.lit(0.0), F.lit(1.0), F.lit(0.5), 0.4, 0.7).alias("b"))
    table = rows.toPandas()
    assert table.a.between(1, 5).all() and abs(table.a.mean() - 2) < 0.02 and abs((table.a / 4).var() - 0.25 * 0.75 / 9) < 0.001
    assert abs(table.b.mean() - 0.4 / 1.1) < 0.01 and abs(table.b.var() - 0.4 * 0.7 / (1.1**2 * 2.1)) < 0.005
    again = rows.repartition(7).toPandas().sort_values("id")
    assert (again.a.to_numpy() == table.sort_values("id").a.to_numpy()).all()
    odd = spark.createDataFrame([(1, 1.0, 5.0, 5.0), (2, None, 5.0, 2.0), (None, 1.0, 5.0, 2.0)], "k long, lo double, up double, m double")
    assert [r.v for r in odd.select(C.rbeta_between(F.col("k"), F.col("lo"), F.col("up"), F.col("m"), 2.0).alias("v")).collect()] == [None] * 3


def test_scores_of_batches_and_failures(spark):
    yearly = spark.createDataFrame([(1, 2000, 100.4), (1, 2001, 300.2), (2, 2000, 9000.0)], "batch int, year int, snll_fs double")
    assert {r.batch: (r.years, r.snll_fs, r.bail) for r in E.batch_scores(yearly, 200.2).collect()} == {1: (2, 1e6, 1), 2: (1, 9000.0, 0)}
    assert {r.batch: (r.snll_fs, r.bail) for r in E.batch_scores(yearly, 201).collect()} == {1: (401.0, 0), 2: (9000.0, 0)}
    values = spark.createDataFrame([(float(i % 9), i % 2, 2) for i in range(40)] + [(500.0, 0, 1)], "value double, sample int, batch int")
    assert E.score_ad(values, 2).first().ad == E.score_ad(values.where("batch = 2").drop("batch")).first().ad < 1e6
    assert E.score_ad(values, 1).first().ad == 5e7 and E.score_ad(values.limit(0)).first().ad == 5e7


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    from pyrocell.sources import tables as A

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        part = lambda y: spark.range(60).selectExpr("id % 30 AS pixelID", f"{y} + CAST(id / 30 AS INT) AS year", "1L AS ignitions", "id * 1.5 AS MDC", "0 AS youngAge", "CAST(id % 2 AS INT) AS nf")
        light = spark.range(30).selectExpr("id AS pixelID", "id * 10 AS density")
        plain = [part(2000), part(2005), light]
        dealt = [A.write_bucketed(df, f"bucketed_{k}", 4, path=f"file://{tmp_path}/{k}") for k, df in enumerate(plain)]
        merged = [H.merge_prepared_covs(t[:2], ["nf"], ["MDC"], t[2]) for t in (plain, dealt)]
        plans = [m._jdf.queryExecution().executedPlan().toString() for m in merged]
        assert "Exchange hashpartitioning(pixelID" in plans[0] and "Exchange" not in plans[1]
        assert sorted(map(tuple, merged[0].collect())) == sorted(map(tuple, merged[1].collect())) and merged[1].count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for k in range(3):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{k}")
