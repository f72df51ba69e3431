"""The registered queries of the pixel-table operators, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrocell.functions import columns as C
from pyrocell.grid import GridSpec, densify
from pyrocell.operators import covariates as H
from pyrocell.operators import fires as N
from pyrocell.operators import fits as M
from pyrocell.operators import spatial as D
from pyrocell.operators import summaries as E
from pyrocell.operators import tables as T
from pyrocell.operators import zones as Z
from pyrocell.plans.views import Views, with_views
from pyrocell.sources import tables as A
from pyrocell.storage import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPECIES = ("Pice_mar", "Pinu_con", "Popu_tre", "Betu_pap", "Pice_gla", "Abie_las")
CLASSES = ("BlkSprc", "LdJkPine", "PopBrch", "SprcFrLrch")
YEARS = (1995, 1996, 1997, 1998)


def query(sql: str | None = None):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_views(sql.strip())
        return f

    return add


def t_quantile(z: float, v: str) -> str:
    """SQL of the series that ``t_critical`` sums."""
    return f"({z} + {(z**3 + z) / 4} / {v} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / pow({v}, 2) + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / pow({v}, 3))"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def grid_of(v: Views) -> GridSpec:
    """100 columns of 250 m cells; as many rows as orders fill. One number reaches the driver."""
    return GridSpec(0.0, 0.0, 250.0, 250.0, 100, -(-v.orders.count() // 100))


NROW = "(SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) FROM orders)"

# sources and grid


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_pixels(v):
    return A.scan_pixels(v.spark, f"{v.sf_dir}/orders.parquet", ["o_custkey", "o_totalprice"], "o_orderkey")


@query(f"SELECT CAST(i AS BIGINT) AS pixelID, c.lcc FROM range(1, 100 * ({NROW} + 2) + 1) t(i) LEFT JOIN cell c ON c.pixelID = i")
def densify_grid(v):
    g = grid_of(v)
    return densify(v.cell.select("pixelID", "lcc"), GridSpec(0, 0, 250, 250, 100, g.nrow + 2))


@query(f"""SELECT FIRE_ID, CASE WHEN floor(-y / 250) < {NROW} THEN CAST(floor(-y / 250) * 100 + floor(x / 250) + 1 AS BIGINT) END AS pixelID FROM fire_points""")
def cell_from_xy(v):
    return v.fire_points.select("FIRE_ID", grid_of(v).cell_from_xy(F.col("x"), F.col("y")).alias("pixelID"))


@query("SELECT pixelID, (c + 0.5) * 250.0 AS x, -(r + 0.5) * 250.0 AS y FROM cell")
def xy_from_cell(v):
    g = grid_of(v)
    return v.cell.select("pixelID", g.x(F.col("pixelID")).cast("double").alias("x"), g.y(F.col("pixelID")).cast("double").alias("y"))


@query("""SELECT CAST(event_id % 90 AS DOUBLE) AS Lat, CAST(event_id % 180 AS DOUBLE) AS "Long", round(value, 3) AS LightningDensity FROM events WHERE event_id % 7 <> 0""")
def read_lightning(v):
    e = v.events.select("event_id", F.concat_ws(",", (F.col("event_id") % 90).cast("double"), (F.col("event_id") % 180).cast("double"), F.when(F.col("event_id") % 7 != 0, F.round("value", 3).cast("string")).otherwise("")).alias("t"))
    line = e.groupBy(F.floor(F.col("event_id") / 3).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t"))), lambda s: s["t"]), ",").alias("value"))
    path = scratch(v.spark, "lightning")
    line.select("value").write.text(path)
    return A.read_lightning(v.spark, path, 3)


@query("SELECT rep, year, N, areaBurnedHa FROM burn_summary")
def read_burn_summaries(v):
    path = scratch(v.spark, "burns")
    for rep in range(1, 6):
        v.burn_summary.where(F.col("rep") == rep).drop("rep").write.option("header", True).csv(f"{path}/rep{rep:02d}")
    return A.read_burn_summaries(v.spark, path)


@query("""SELECT FIRE_ID, YEAR AS date, SIZE_HA AS size_ha, CAST(floor(SIZE_HA / 62500.0 * 1e4 + 0.5) AS INT) AS size, x, y FROM fire_points WHERE YEAR BETWEEN 1996 AND 1999""")
def fire_points_read(v):
    return A.fire_points(v.fire_points, 1996, 1999, 250.0)


VERTICES = """SELECT CAST(n_nationkey AS INT) AS poly_id, 1995 + n_nationkey % 7 AS "YEAR", s AS seq,
 CAST((n_nationkey % 5) * 4000 + CASE s WHEN 0 THEN 130 WHEN 1 THEN 2630 WHEN 2 THEN 2630 + (n_nationkey % 2) * 700 ELSE 130 + (n_nationkey % 2) * 700 END AS DOUBLE) AS x,
 -CAST(CAST(floor(n_nationkey / 5.0) AS INT) * 700 + CASE WHEN s < 2 THEN 30 ELSE 1530 END AS DOUBLE) AS y
 FROM nation, (VALUES (0), (1), (2), (3)) q(s)"""


def vertices(v: Views) -> DataFrame:
    n, s = F.col("n_nationkey"), F.col("seq")
    d = v.nation.select("n_nationkey", F.explode(F.array(*map(F.lit, range(4)))).alias("seq"))
    x = (n % 5) * 4000 + F.when(s == 0, 130).when(s == 1, 2630).when(s == 2, 2630 + (n % 2) * 700).otherwise(130 + (n % 2) * 700)
    y = -(F.floor(n / 5) * 700 + F.when(s < 2, 30).otherwise(1530))
    return d.select(n.alias("poly_id"), (1995 + n % 7).alias("YEAR"), "seq", x.cast("double").alias("x"), y.cast("double").alias("y"))


@query(f"""WITH vs AS ({VERTICES}), e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) nx, coalesce(lead(y) OVER w, first_value(y) OVER w) ny FROM vs WINDOW w AS (PARTITION BY poly_id ORDER BY seq))
 SELECT poly_id, concat('year', "YEAR") AS year, round_even(abs(sum(x * ny - nx * y)) / 2 / 10000, 2) AS POLY_HA FROM e WHERE "YEAR" IN (1995, 1996, 1997) GROUP BY poly_id, "YEAR" """)
def fire_polygons(v):
    return A.fire_polygons(vertices(v), (1995, 1996, 1997))


@query("SELECT max_by(name, regexp_extract(name, '_(\\d{8})_', 1)) AS name FROM listing")
def latest_release(v):
    return A.latest_release(v.listing, "name", "none")


@query("SELECT pixelID, MDC, CMDsm, year FROM climate")
def write_pixels(v):
    path = scratch(v.spark, "pixels")
    A.write_pixels(v.climate, path)
    return v.spark.read.parquet(path)


@query("SELECT cells, year, ids, size FROM historical")
def load_checks(v):
    return A.load_checks(v.historical, ["size"], "fires")


# column functions

X = "CAST(floor(l_extendedprice) AS DOUBLE)"


@query("SELECT pixelID, CAST(floor(MDC * 1000 + 0.5) AS INT) AS MDC, CAST(floor(CMDsm * 1000 + 0.5) AS INT) AS CMDsm FROM climate")
def to_x1000(v):
    return C.to_x1000(v.climate.select("pixelID", "MDC", "CMDsm"))


@query("SELECT pixelID, MDC / 1000.0 AS MDC FROM climate")
def from_x1000(v):
    return C.from_x1000(v.climate.select("pixelID", "MDC"), ["MDC"])


@query("SELECT pixelID, CAST(floor(coalesce(age, 0) * 1000 + 0.5) AS INT) AS age, coalesce(flammable, 0) AS flammable FROM cell WHERE pixelID IN (SELECT pixelID FROM fire_raster)")
def annual_stack_x1000(v):
    return C.annual_stack_x1000(v.cell.select("pixelID", "age", "flammable"), v.fire_raster, ["age", "flammable"])


@query("SELECT pixelID, coalesce(age, 0) AS age, coalesce(flammable, 0) AS flammable FROM cell")
def replace_na_with_0(v):
    return C.replace_na_with_0(v.cell.select("pixelID", "age", "flammable"))


@query("SELECT pixelID, round(ln(greatest(age, exp(ln(100.0) - 1))), 6) AS b FROM cell WHERE age IS NOT NULL UNION ALL SELECT pixelID, NULL FROM cell WHERE age IS NULL")
def log_min_b(v):
    return v.cell.select("pixelID", r6(C.log_min_b(F.col("age"))).alias("b"))


@query("SELECT pixelID, CASE WHEN age IS NOT NULL THEN greatest(age - 20.0, 0.0) END AS h FROM cell")
def pw(v):
    return v.cell.select("pixelID", C.pw(F.col("age").cast("double"), 20.0).alias("h"))


@query("SELECT event_id, pow(10.0, ceil(log10(abs(value)))) AS o FROM events WHERE value <> 0")
def oom(v):
    return v.events.where("value <> 0").select("event_id", C.oom(F.col("value")).alias("o"))


@query("SELECT event_id, round((value - 5.0) * 1000.0 / 45.0, 6) AS s FROM events")
def rescale_known2(v):
    return v.events.select("event_id", r6(C.rescale_known2(F.col("value"), 0.0, 1000.0, 5.0, 50.0)).alias("s"))


@query("SELECT event_id, round((value - 1.0) * 10.0 / (SELECT max(value - 1.0) FROM events), 6) AS value FROM events")
def rescale_known(v):
    return C.rescale_known(v.events.select("event_id", "value"), "value", 10.0, 1.0).withColumn("value", r6("value"))


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS value FROM events")
def min_max_normalize(v):
    return C.min_max_normalize(v.events.select("event_id", "value"), "value").withColumn("value", r6("value"))


@query("""SELECT event_id, round(0.1 + 0.8 / pow(1 + pow(exp(value / 100) / 2.0, -1.5), 0.7), 6) AS p5, round(0.2 + 0.7 / pow(1 + pow(exp(value / 100), -1.5), 0.7), 6) AS p4,
 round(0.1 + 0.8 / pow(1 + pow(exp(value / 100), -1.5), 0.7), 6) AS p3, round(0.1 + 0.8 / pow(1 + pow(exp(value / 100), -1.5), 0.5), 6) AS p2 FROM events""")
def logistic_curves(v):
    x = F.col("value") / 100
    return v.events.select("event_id", r6(C.logistic5p(x, [0.1, 0.9, 2.0, 1.5, 0.7])).alias("p5"), r6(C.logistic4p(x, [0.2, 0.9, 1.5, 0.7])).alias("p4"), r6(C.logistic3p(x, [0.9, 1.5, 0.7])).alias("p3"), r6(C.logistic2p(x, [0.9, 1.5])).alias("p2"))


@query("SELECT pixelID, year, round(0.1 + 0.8 / pow(1 + pow(exp(MDC * 0.01 + CMDsm * -0.02), -1.5), 0.5), 6) AS p FROM climate")
def logistic_all(v):
    return v.climate.select("pixelID", "year", r6(C.logistic_all([F.col("MDC"), F.col("CMDsm")], [0.9, 1.5], [0.01, -0.02])).alias("p"))


@query("""WITH a AS (SELECT param_id, [b1, b2, b1 + b2] AS p FROM candidates), b AS (SELECT param_id, unnest(['logit1', 'MDC', 'CMDsm']) AS label, unnest(p) AS value FROM a)
 SELECT param_id, label, round(value, 3) AS value, 1 AS n_logistic FROM b""")
def param_terms(v):
    df = v.candidates.select("param_id", F.array(F.col("b1"), F.col("b2"), F.col("b1") + F.col("b2")).alias("p"))
    logistic, _ = C.params_separate(F.col("p"), 2)
    out = C.label_params(df, "p", C.param_terms(3, ["MDC", "CMDsm"]), "param_id").join(df.select("param_id", F.size(logistic).alias("n_logistic")), "param_id")
    return out.withColumn("value", F.round("value", 3))


@query("SELECT cells, greatest(1000.0, round_even(greatest(5.0, 14.0 - ln(size)) * size, 0)) AS m FROM historical WHERE size > 0")
def multiplier(v):
    return v.historical.where("size > 0").select("cells", C.multiplier(F.col("size").cast("double")).alias("m"))


@query("SELECT pixelID, MDC / 100.0 AS MDC FROM climate")
def rescale_by_magnitude(v):
    return C.rescale_by_magnitude(v.climate.select("pixelID", "MDC"), {"MDC": 100.0})


@query("SELECT pixelID, CASE WHEN flammable <> 0 THEN 0 ELSE lcc END AS lcc, flammable, age FROM cell")
def make_mutually_exclusive(v):
    return C.make_mutually_exclusive(v.cell.select("pixelID", "lcc", "flammable", "age"), {"flammable": ["^lc"]})


@query()
def rbeta_between(v):
    up = 2.0 + F.col("age")
    return v.cell.select("pixelID", C.rbeta_between(F.col("pixelID"), F.lit(1.0), up, 1.0 + up / 4, 2.0).alias("value"))


@query("SELECT pixelID, lcc AS year2001, flammable AS year2002 FROM cell")
def update_stack_year_names(v):
    return C.update_stack_year_names(v.cell.select("pixelID", F.col("lcc").alias("layer_2001"), F.col("flammable").alias("layer_2002")), [2001, 2002])


@query("SELECT pixelID, year FROM climate")
def year_from_token(v):
    return T.split_by_year(v.climate.select("pixelID", "year")).select("pixelID", C.year_from_token(F.col("token")).alias("year"))


@query("SELECT pixelID, CAST(unnest([0, 1]) AS INT) AS ind, unnest([concat('year', year), concat('year', year + 1)]) AS date FROM climate")
def explode_year_key(v):
    df = v.climate.select("pixelID", F.concat(F.lit("year"), F.col("year"), F.lit("_year"), F.col("year") + 1).alias("k"))
    return C.explode_year_key(df, "k").drop("k")


@query("SELECT event_id, round(1 / (1 + exp(-(value / 100 - 0.5))), 6) AS p FROM events")
def inverse_logit(v):
    return v.events.select("event_id", r6(C.inverse_logit(F.col("value") / 100 - 0.5)).alias("p"))


# reshapes, joins, windows, sets


@query("""SELECT pixelID, 1995 AS year, age AS a, lcc AS b FROM cell WHERE age IS NOT NULL AND pixelID IN (SELECT pixelID FROM fire_raster)
 UNION ALL SELECT pixelID, 1996, age + 1, lcc FROM cell WHERE age IS NOT NULL AND pixelID IN (SELECT pixelID FROM fire_raster)""")
def climate_to_long(v):
    c = v.cell.where("age IS NOT NULL")
    a = c.select("pixelID", F.col("age").alias("year1995"), (F.col("age") + 1).alias("year1996"))
    b = c.select("pixelID", F.col("lcc").alias("year1995"), F.col("lcc").alias("year1996"))
    return T.climate_to_long({"a": a, "b": b}, v.fire_raster)


PIVOT = ", ".join(f"coalesce(sum(CASE WHEN speciesCode = '{s}' THEN B END), 0) AS {s}" for s in SPECIES)


@query(f"WITH s AS (SELECT pixelGroup, max(age) AS standAge FROM cohort GROUP BY pixelGroup) SELECT pixelGroup, standAge, {PIVOT} FROM cohort JOIN s USING (pixelGroup) GROUP BY pixelGroup, standAge")
def pivot_cohorts(v):
    c = v.cohort
    return T.pivot_cohorts(c.join(c.groupBy("pixelGroup").agg(F.max("age").alias("standAge")), "pixelGroup"), SPECIES)


@query("SELECT pixelID, CASE WHEN lcc IN (1, 2) THEN 1 ELSE 0 END AS low, CASE WHEN lcc IN (3, 4) THEN 1 ELSE 0 END AS high FROM cell")
def one_hot(v):
    return T.one_hot(v.cell.select("pixelID", "lcc"), "lcc", {"low": [1, 2], "high": [3, 4]}).drop("lcc")


@query("SELECT year, pixelID, CAST(floor(CMDsm * 1000 + 0.5) AS INT) AS CMDsm, CAST(floor(MDC * 1000 + 0.5) AS INT) AS MDC FROM climate")
def covs_x1000(v):
    return T.covs_x1000(v.climate, v.landcover, v.fire_buffered, v.historical, ["CMDsm", "MDC", "nf_low"])[0]


@query("SELECT pixelID, CASE WHEN lcc = 1 THEN 1 ELSE 0 END AS lcc_1, CASE WHEN lcc = 3 THEN 1 ELSE 0 END AS lcc_3 FROM cell")
def segregate(v):
    return T.segregate(v.cell, "lcc", [3, 1, 2], [2])


@query("SELECT c.pixelID, coalesce(l.nf_low, CASE WHEN c.flammable IS NOT NULL THEN 0 END) AS nf_low, coalesce(l.nf_high, CASE WHEN c.flammable IS NOT NULL THEN 0 END) AS nf_high FROM cell c LEFT JOIN landcover l ON l.pixelID = c.pixelID")
def put_back_into_raster(v):
    return T.put_back_into_raster(["nf_low", "nf_high"], v.landcover, v.cell, "flammable")


@query("SELECT CAST(param_id AS INT) AS iter, CAST(param_id % 7 AS INT) AS member, unnest(['a', 'b']) AS variable, round(unnest([b1, b2]), 6) AS value FROM candidates")
def population_long(v):
    p = v.candidates.select(F.col("param_id").alias("iter"), (F.col("param_id") % 7).alias("member"), F.array("b1", "b2").alias("par"))
    return T.population_long(p, "par", ["a", "b"]).withColumn("value", r6("value"))


@query("SELECT c.pixelID, c.lcc, f.fireYear FROM cell c LEFT JOIN fire_raster f ON f.pixelID = c.pixelID")
def lookup_keep_right(v):
    return T.lookup_keep_right(v.fire_raster, v.cell.select("pixelID", "lcc"), ["pixelID"])


@query("SELECT pixelID FROM cell WHERE pixelID NOT IN (SELECT pixelID FROM fire_raster)")
def anti_join(v):
    return T.anti_join(v.cell.select("pixelID"), v.fire_raster, ["pixelID"])


@query("SELECT pixelID, lcc FROM cell WHERE pixelID IN (SELECT pixelID FROM fire_raster)")
def semi_join(v):
    return T.semi_join(v.cell.select("pixelID", "lcc"), v.fire_raster, "pixelID")


@query("SELECT c.pixelID, f.fireYear FROM cell c LEFT JOIN fire_raster f ON f.pixelID = c.pixelID")
def update_from(v):
    return T.update_from(v.cell.select("pixelID", F.lit(0).alias("fireYear")), v.fire_raster, "pixelID", "fireYear")


@query("SELECT c.pixelID, c.lcc, f.fireYear FROM cell c JOIN fire_raster f ON f.pixelID = c.pixelID")
def inner_join(v):
    return T.inner_join(v.cell.select("pixelID", "lcc"), v.fire_raster, ["pixelID"])


@query("SELECT p.pixelID, p.pixelGroup, c.speciesCode, c.age, c.B FROM cell p JOIN cohort c ON c.pixelGroup = p.pixelGroup")
def expand_cohorts_to_pixels(v):
    return T.expand_cohorts_to_pixels(v.cohort, v.cell.select("pixelID", "pixelGroup"))


@query("SELECT a.pixelID, a.year, a.MDC, b.ids, b.buffer FROM climate a JOIN fire_buffered b ON a.pixelID = b.pixelID AND a.year = b.year")
def merge_on(v):
    return T.merge_on(v.climate.select("pixelID", "year", "MDC"), v.fire_buffered, ["pixelID", "year"])


@query("SELECT pixelID, year, CASE WHEN year >= 1998 THEN 1998 WHEN year >= 1995 THEN 1995 ELSE 1990 END AS start FROM climate")
def asof_period(v):
    periods = v.climate.select(F.when(F.col("year") >= 1998, 1998).when(F.col("year") >= 1995, 1995).otherwise(1990).alias("start"))
    return T.asof_period(v.climate.select("pixelID", "year"), periods).select("pixelID", "year", "start")


@query("SELECT pixelID, year, MDC FROM climate WHERE year BETWEEN 1995 AND 1997")
def years_between(v):
    return T.years_between(v.climate.select("pixelID", "year", "MDC"), 1995, 1997)


@query("SELECT pixelID, age, flammable FROM cell WHERE age IS NOT NULL AND flammable IS NOT NULL")
def drop_incomplete(v):
    return T.drop_incomplete(v.cell.select("pixelID", "age", "flammable"))


@query("SELECT *, max(age) OVER (PARTITION BY pixelGroup) AS maxAge FROM cohort")
def group_max_age(v):
    return T.group_max_age(v.cohort)


@query("SELECT pixelGroup, speciesCode, count(*) OVER (PARTITION BY speciesCode) AS N FROM cohort")
def group_size(v):
    return T.group_size(v.cohort.select("pixelGroup", "speciesCode"), "speciesCode")


@query("SELECT pixelID, min(year) AS year FROM fire_buffered GROUP BY pixelID")
def first_per_key(v):
    return C.first_per_key(v.fire_buffered.select("pixelID", "year"), ["pixelID"], [F.col("year")])


@query("SELECT year, pixelID, buffer, ids FROM (SELECT *, row_number() OVER (PARTITION BY year, pixelID ORDER BY buffer DESC, ids) n FROM fire_buffered) WHERE n = 1")
def burned_wins(v):
    return T.burned_wins(v.fire_buffered)


@query("SELECT cells, year, ids, size FROM (SELECT *, row_number() OVER (PARTITION BY cells % 50 ORDER BY size DESC, ids) n FROM historical) WHERE n = 1")
def dedupe_start_pixels(v):
    return T.dedupe_start_pixels(v.historical.withColumn("k", F.col("cells") % 50), "k").drop("k")


@query("SELECT year, total, CASE WHEN row_number() OVER (ORDER BY total DESC, year) <= 2 THEN 1 ELSE 0 END AS largest FROM (SELECT year, sum(size) AS total FROM historical GROUP BY year)")
def largest_years(v):
    return T.largest_years(v.historical)


@query("SELECT cells, year, ids, size FROM historical ORDER BY size DESC, ids LIMIT 4")
def largest_fires(v):
    return T.largest_fires(v.historical)


@query("SELECT cells, year FROM historical ORDER BY year, cells")
def order_by(v):
    return T.order_by(v.historical.select("cells", "year"), ["year", "cells"])


@query("SELECT pixelID, lcc, NULL AS age FROM cell UNION ALL SELECT pixelID, NULL, age FROM cell")
def union_by_name(v):
    return T.union_by_name([v.cell.select("pixelID", "lcc"), v.cell.select("pixelID", "age")], fill=True)


@query("SELECT DISTINCT speciesCode, age FROM cohort")
def distinct_rows(v):
    return T.distinct_rows(v.cohort.select("speciesCode", "age"))


@query("SELECT pixelID FROM cell EXCEPT SELECT pixelID FROM fire_raster")
def set_difference(v):
    return T.set_difference(v.cell.select("pixelID"), v.fire_raster.select("pixelID"))


@query("SELECT pixelID FROM cell INTERSECT SELECT pixelID FROM fire_raster")
def set_intersection(v):
    return T.set_intersection(v.cell.select("pixelID"), v.fire_raster.select("pixelID"))


# space

PLACED = f"SELECT FIRE_ID AS point_id, YEAR AS year, FIRE_ID % 100 AS ids, x, y, CASE WHEN floor(-y / 250) < {NROW} THEN CAST(floor(-y / 250) * 100 + floor(x / 250) + 1 AS BIGINT) END AS pixelID FROM fire_points"
BLOCK = "CAST(floor(r / 5.0) * 20 + floor(c / 5.0) + 1 AS BIGINT)"


@query(f"WITH p AS ({PLACED}) SELECT p.point_id, p.pixelID, c.lcc FROM p LEFT JOIN cell c ON c.pixelID = p.pixelID")
def cells_of_points(v):
    return D.cells_of_points(v.points, grid_of(v), v.cell.select("pixelID", "lcc")).select("point_id", "pixelID", "lcc")


@query(f"""WITH p AS (SELECT DISTINCT year, pixelID, CAST(floor((pixelID - 1) / 100) AS BIGINT) r, (pixelID - 1) % 100 c FROM ({PLACED}) WHERE pixelID IS NOT NULL),
 q AS (SELECT p.year, n.pixelID, CASE WHEN n.pixelID = p.pixelID THEN 1 ELSE 0 END i FROM p, (SELECT unnest(range(-2, 3)) dr) a, (SELECT unnest(range(-2, 3)) dc) b, LATERAL (SELECT (p.r + dr) * 100 + p.c + dc + 1 AS pixelID) n
 WHERE dr * dr + dc * dc <= 4 AND p.r + dr BETWEEN 0 AND {NROW} - 1 AND p.c + dc BETWEEN 0 AND 99) SELECT year, CAST(pixelID AS BIGINT) AS pixelID, max(i) AS ignited FROM q GROUP BY year, pixelID""")
def buffer_ignition_points(v):
    return N.buffer_ignition_points(v.points, 500.0, grid_of(v))


@query("""WITH b AS (SELECT f.year, f.ids, f.pixelID, (c.c + 0.5) * 250.0 AS px, -(c.r + 0.5) * 250.0 AS py FROM fire_buffered f JOIN cell c USING (pixelID) WHERE buffer = 1),
 d AS (SELECT p.point_id, p.year, p.ids, b.pixelID, round(sqrt((px - x) * (px - x) + (py - y) * (py - y)), 6) AS dist FROM points p JOIN b USING (year, ids))
 SELECT point_id, year, ids, pixelID, dist FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, pixelID) n FROM d) WHERE n = 1""")
def nearest_cell_same_fire(v):
    return D.nearest_cell_same_fire(v.points, v.fire_buffered.where("buffer = 1"), grid_of(v))


@query("""WITH b AS (SELECT f.year, f.ids, f.pixelID, (c.c + 0.5) * 250.0 AS x, -(c.r + 0.5) * 250.0 AS y FROM fire_buffered f JOIN cell c USING (pixelID) WHERE buffer = 1),
 m AS (SELECT year, ids, avg(x) mx, avg(y) my, count(*) n FROM b GROUP BY year, ids), d AS (SELECT b.*, m.n AS k, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 6) dist FROM b JOIN m USING (year, ids))
 SELECT year, ids AS FIRE_ID, pixelID, k AS size, CAST(k * 6.25 AS DOUBLE) AS POLY_HA FROM (SELECT *, row_number() OVER (PARTITION BY year, ids ORDER BY dist, pixelID) o FROM d) WHERE o = 1""")
def raster_fire_spread_points(v):
    return N.raster_fire_spread_points(v.fire_buffered, grid_of(v))


@query(f"""WITH vs AS ({VERTICES}), e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) nx, coalesce(lead(y) OVER w, first_value(y) OVER w) ny FROM vs WINDOW w AS (PARTITION BY poly_id ORDER BY seq)),
 c2 AS (SELECT pixelID, (c + 0.5) * 250.0 AS cx, -(r + 0.5) * 250.0 AS cy FROM cell), i AS (SELECT poly_id, "YEAR" AS yr, pixelID, count(*) AS k FROM c2 JOIN e ON least(y, ny) <= cy AND cy < greatest(y, ny) AND x + (cy - y) * (nx - x) / (ny - y) > cx GROUP BY poly_id, "YEAR", pixelID)
 SELECT pixelID, min(yr) AS "YEAR" FROM i WHERE k % 2 = 1 GROUP BY pixelID""")
def rasterize(v):
    return D.rasterize(vertices(v), grid_of(v), "YEAR", "min")


@query(f"""WITH vs AS ({VERTICES}), e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) nx, coalesce(lead(y) OVER w, first_value(y) OVER w) ny FROM vs WINDOW w AS (PARTITION BY poly_id ORDER BY seq)),
 c2 AS (SELECT pixelID, (c + 0.5) * 250.0 AS cx, -(r + 0.5) * 250.0 AS cy FROM cell), i AS (SELECT poly_id, "YEAR" AS yr, pixelID, count(*) AS k FROM c2 JOIN e ON least(y, ny) <= cy AND cy < greatest(y, ny) AND x + (cy - y) * (nx - x) / (ny - y) > cx GROUP BY poly_id, "YEAR", pixelID),
 d AS (SELECT "YEAR" AS yr, CASE WHEN y >= ny THEN x ELSE nx END / 250.0 AS u1, -greatest(y, ny) / 250.0 AS v1, CASE WHEN y >= ny THEN nx ELSE x END / 250.0 AS u2, -least(y, ny) / 250.0 AS v2 FROM e),
 o AS (SELECT *, unnest(range(CAST(greatest(floor(v1), 0) AS BIGINT), CAST(least(floor(v2), {NROW} - 1) AS BIGINT) + 1)) AS r FROM d),
 s AS (SELECT yr, r, CASE WHEN v1 >= r THEN u1 ELSE u1 + (r - v1) * (u2 - u1) / (v2 - v1) END AS a, CASE WHEN v2 <= r + 1 THEN u2 ELSE u1 + (r + 1 - v1) * (u2 - u1) / (v2 - v1) END AS b FROM o),
 t AS (SELECT yr, r, unnest(range(CAST(greatest(floor(least(a, b)), 0) AS BIGINT), CAST(least(floor(greatest(a, b)), 99) AS BIGINT) + 1)) AS c FROM s)
 SELECT pixelID, min(yr) AS "YEAR" FROM (SELECT pixelID, yr FROM i WHERE k % 2 = 1 UNION ALL SELECT r * 100 + c + 1, yr FROM t) GROUP BY pixelID""")
def rasterize_touched(v):
    return D.rasterize(vertices(v), grid_of(v), "YEAR", "min", touches=True)


@query("SELECT DISTINCT zone FROM zone WHERE v > 0 AND pixelID IN (SELECT pixelID FROM fire_raster)")
def zones_touching(v):
    return D.zones_touching(v.zone.where("v > 0"), v.fire_raster)


@query(f"SELECT {BLOCK} AS block, CASE WHEN count(age) = 25 THEN round(avg(age), 6) END AS age FROM cell GROUP BY 1")
def block_mean(v):
    return D.block_mean(v.cell, grid_of(v), 5, "age").withColumn("age", r6("age"))


@query(f"WITH n AS (SELECT {BLOCK} AS block, lcc, count(*) k FROM cell GROUP BY 1, 2) SELECT block, lcc FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY k DESC, lcc) o FROM n) WHERE o = 1")
def block_modal(v):
    return D.block_modal(v.cell, grid_of(v), 5, "lcc")


@query("""SELECT a.pixelID, round(coalesce(any_value(a.age), avg(b.age)), 6) AS age FROM cell a LEFT JOIN cell b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.pixelID""")
def focal_mean_fill(v):
    return D.focal_mean_fill(v.cell.select("pixelID", F.col("age").cast("double")), grid_of(v), "age").withColumn("age", r6("age"))


@query("""SELECT a.pixelID, coalesce(sum(b.flammable), 0) - 1 AS n FROM cell a LEFT JOIN cell b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.pixelID""")
def neighbour_count(v):
    return D.neighbour_count(v.cell, v.cell, grid_of(v), "flammable")


@query("""WITH RECURSIVE s AS (SELECT pixelID, c FROM cell WHERE lcc < 4), ed AS (SELECT a.pixelID AS f, b.pixelID AS t FROM s a JOIN s b ON b.pixelID = a.pixelID + 1 WHERE a.c < 99 UNION ALL SELECT a.pixelID, b.pixelID FROM s a JOIN s b ON b.pixelID = a.pixelID + 100),
 e2 AS (SELECT f, t FROM ed UNION ALL SELECT t, f FROM ed), w(a, b) AS (SELECT pixelID, pixelID FROM s UNION SELECT w.a, e2.t FROM w JOIN e2 ON e2.f = w.b) SELECT a AS pixelID, min(b) AS patch FROM w GROUP BY a""")
def patches(v):
    return D.patches(v.cell.where("lcc < 4"), grid_of(v), 4)


@query("SELECT year, pixelID, ids, buffer FROM fire_buffered WHERE pixelID IN (SELECT pixelID FROM cell WHERE flammable IS NOT NULL)")
def remove_outside(v):
    return N.remove_outside(v.fire_buffered, v.cell)


@query("""SELECT year, ids, count(*) AS actualSize, CAST(floor(greatest(500.0, greatest(1000.0, round_even(greatest(5.0, 14.0 - ln(count(*))) * count(*), 0))) + 0.5) AS INT) AS goalSize FROM fire_buffered WHERE buffer = 1 GROUP BY year, ids""")
def fire_goal_size(v):
    return N.fire_goal_size(v.fire_buffered.where("buffer = 1"))


@query("""WITH a AS (SELECT year, count(DISTINCT ids) AS b FROM fire_buffered GROUP BY year), z AS (SELECT year, count(DISTINCT ids) AS n FROM fire_buffered WHERE buffer = 1 GROUP BY year)
 SELECT a.year, a.b AS before, coalesce(z.n, 0) AS after, a.b - coalesce(z.n, 0) AS lost FROM a LEFT JOIN z USING (year)""")
def count_fires(v):
    return N.count_fires(v.fire_buffered, v.fire_buffered.where("buffer = 1"))


def compact_fires(v: Views, g: GridSpec) -> DataFrame:
    """Cells within a cell of the start of every fire; the lowest id wins a shared cell."""
    near = D.cells_within(fire_starts(v, g), 250.0, g).select("year", F.col("to").alias("pixelID"), "ids", F.floor(F.col("to") / 4096).alias("run"))
    # dealt by runs of cells, which keeps most cells of a fire together
    return near.repartition("run").groupBy("run", "year", "pixelID").agg(F.min("ids").alias("ids")).drop("run")


def fire_grid(v: Views) -> GridSpec:
    """1,000 columns and 40 cells a fire: fires of a year rarely touch, at any size of the tables."""
    return GridSpec(0.0, 0.0, 250.0, 250.0, 1000, -(-40 * v.events.count() // 1000))


FIRE_CELLS = "(SELECT CAST(ceil(40 * count(*) / 1000.0) AS BIGINT) * 1000 FROM events)"


def fire_starts(v: Views, g: GridSpec) -> DataFrame:
    return v.fire_points.select(F.col("YEAR").alias("year"), F.col("FIRE_ID").alias("ids"), (1 + F.col("FIRE_ID") * 7919 % g.ncell).alias("pixelID"))


FIRES = f"""st AS (SELECT YEAR AS year, FIRE_ID AS ids, FIRE_ID * 7919 % {FIRE_CELLS} AS p FROM fire_points), sp AS (SELECT year, ids, CAST(floor(p / 1000) AS BIGINT) AS r, p % 1000 AS c FROM st),
 fc AS (SELECT year, (r + dr) * 1000 + c + dc + 1 AS pixelID, min(ids) AS ids FROM sp, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) q(dr, dc) WHERE c + dc BETWEEN 0 AND 999 AND r + dr >= 0 AND r + dr < {FIRE_CELLS} / 1000 GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {FIRES}, gr AS (SELECT DISTINCT year, pixelID + dr * 1000 + dc AS pixelID FROM fc, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) q(dr, dc)
  WHERE (pixelID - 1) % 1000 + dc BETWEEN 0 AND 999 AND pixelID + dr * 1000 BETWEEN 1 AND {FIRE_CELLS}),
 ed AS (SELECT a.year, a.pixelID AS f, b.pixelID AS t FROM gr a JOIN gr b ON b.year = a.year AND b.pixelID = a.pixelID + 1 AND a.pixelID % 1000 <> 0 UNION ALL SELECT a.year, a.pixelID, b.pixelID FROM gr a JOIN gr b ON b.year = a.year AND b.pixelID = a.pixelID + 1000),
 e2 AS (SELECT year, f, t FROM ed UNION ALL SELECT year, t, f FROM ed), w(year, a, b) AS (SELECT year, pixelID, pixelID FROM gr UNION SELECT w.year, w.a, e2.t FROM w JOIN e2 ON e2.year = w.year AND e2.f = w.b)
 SELECT fc.year, fc.pixelID, min(w.b) AS ids FROM fc JOIN w ON w.year = fc.year AND w.a = fc.pixelID GROUP BY fc.year, fc.pixelID""")
def make_fire_ids(v):
    g = fire_grid(v)
    return N.make_fire_ids(compact_fires(v, g), g, 250.0)


@query()
def buffer_to_area(v):
    g = fire_grid(v)
    return N.buffer_to_area(compact_fires(v, g), g, area=lambda n: n * 3, min_size=40)


@query()
def raster_fire_buffers(v):
    g = fire_grid(v)
    n = v.orders.count()
    copies = F.explode(F.sequence(F.lit(0), F.lit(g.ncell // n))).alias("i")
    mask = v.cell.where("flammable = 1").select("pixelID", copies).select((F.col("pixelID") + F.col("i") * n).alias("pixelID")).where(F.col("pixelID") <= g.ncell)
    return N.raster_fire_buffers(compact_fires(v, g), g, 250.0, mask, 60, lambda k: k * 2)


AT = f"pa AS (SELECT FIRE_ID AS point_id, YEAR AS year, FIRE_ID % 100 AS ids, x, y, CASE WHEN floor(-y / 250) < {NROW} THEN CAST(floor(-y / 250) * 100 + floor(x / 250) + 1 AS BIGINT) END AS pixelID FROM fire_points)"


@query(f"""WITH {AT}, bu AS (SELECT year, ids, pixelID FROM fire_buffered WHERE buffer = 1), kept AS (SELECT * FROM pa WHERE (year, ids) IN (SELECT (year, ids) FROM bu)),
 onb AS (SELECT * FROM kept WHERE (year, pixelID) IN (SELECT (year, pixelID) FROM bu)), ofb AS (SELECT point_id, year, ids, x, y FROM kept WHERE point_id NOT IN (SELECT point_id FROM onb)),
 bc AS (SELECT DISTINCT b.pixelID, c.r, c.c FROM bu b JOIN cell c USING (pixelID)), nb AS (SELECT bc.pixelID, any_value(bc.r) AS r, any_value(bc.c) AS c, coalesce(sum(m.flammable), 0) - 1 AS n FROM bc LEFT JOIN (SELECT r, c, flammable FROM cell WHERE flammable IS NOT NULL) m
  ON m.r BETWEEN bc.r - 1 AND bc.r + 1 AND m.c BETWEEN bc.c - 1 AND bc.c + 1 GROUP BY bc.pixelID),
 d AS (SELECT o.point_id, o.year, o.ids, b.pixelID, nb.n, round(sqrt(((nb.c + 0.5) * 250.0 - o.x) * ((nb.c + 0.5) * 250.0 - o.x) + (-(nb.r + 0.5) * 250.0 - o.y) * (-(nb.r + 0.5) * 250.0 - o.y)), 6) AS dist FROM ofb o JOIN bu b USING (year, ids) JOIN nb ON nb.pixelID = b.pixelID),
 k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY CASE WHEN n > 6 THEN 0 ELSE 1 END, CASE WHEN n > 6 THEN dist ELSE -n END, dist, pixelID) AS o FROM d)
 SELECT point_id, year, ids, pixelID, 0 AS moved FROM onb UNION ALL SELECT point_id, year, ids, pixelID, 1 FROM k WHERE o = 1""")
def harmonize_buffer_and_points(v):
    return N.harmonize_buffer_and_points(v.points, v.fire_buffered, v.cell.where("flammable IS NOT NULL"), grid_of(v))


@query(f"""WITH {AT}, good AS (SELECT pixelID, r, c FROM cell WHERE flammable > 0), bu AS (SELECT f.year, f.ids, f.pixelID, g.r, g.c FROM fire_buffered f JOIN good g USING (pixelID) WHERE f.buffer = 1),
 bad AS (SELECT * FROM pa WHERE pixelID IS NULL OR pixelID NOT IN (SELECT pixelID FROM good)), d AS (SELECT p.point_id, p.year, p.ids, b.pixelID, row_number() OVER (PARTITION BY p.point_id ORDER BY round(sqrt(((b.c + 0.5) * 250.0 - p.x) * ((b.c + 0.5) * 250.0 - p.x) + (-(b.r + 0.5) * 250.0 - p.y) * (-(b.r + 0.5) * 250.0 - p.y)), 6), b.pixelID) AS o FROM bad p JOIN bu b USING (year, ids)),
 moved AS (SELECT point_id, year, ids, pixelID FROM d WHERE o = 1), gone AS (SELECT DISTINCT year, ids FROM bad WHERE point_id NOT IN (SELECT point_id FROM moved))
 SELECT * FROM (SELECT point_id, year, ids, pixelID FROM pa WHERE pixelID IN (SELECT pixelID FROM good) UNION ALL SELECT * FROM moved) WHERE (year, ids) NOT IN (SELECT (year, ids) FROM gone)""")
def clean_up_spread_points(v):
    return N.clean_up_spread_points(v.points, v.fire_buffered, v.cell, grid_of(v))[0]


@query(f"WITH p AS ({PLACED}) SELECT round_even(f.SIZE_HA / 6.25, 0) AS size, concat('year', p.year) AS date, p.ids, p.pixelID AS cells FROM p JOIN fire_points f ON f.FIRE_ID = p.point_id")
def make_loci(v):
    return N.make_loci(v.points, grid_of(v))


# covariates

SUMS = ", ".join(f"coalesce(sum(CASE WHEN speciesCode = '{s}' THEN B END), 0) AS {s}" for s in SPECIES)


@query(f"""WITH w AS (SELECT pixelGroup, max(age) AS standAge, {SUMS} FROM cohort GROUP BY pixelGroup)
 SELECT l.pixelID, l.nf_low, CASE WHEN w.pixelGroup IS NULL AND c.pixelGroup IS NULL AND l.nf_low + l.nf_high = 0 THEN 1 ELSE l.nf_high END AS nf_high,
 {", ".join(f"w.{s}" for s in SPECIES)}, CASE WHEN coalesce(w.standAge, c.age) <= 15 THEN 1 WHEN coalesce(w.standAge, c.age) > 15 THEN 0 END AS youngAge, 2001 AS year
 FROM landcover l JOIN cell c ON c.pixelID = l.pixelID LEFT JOIN w ON w.pixelGroup = c.pixelGroup""")
def cast_cohort_data(v):
    return H.cast_cohort_data(v.cohort, v.cell, v.landcover, SPECIES, "nf_high", v.cell, 2001)


@query(f"""SELECT block, CASE WHEN p < 0.3 THEN 0 ELSE lcc END AS lcc, CASE WHEN p < 0.3 OR lcc IS NOT NULL THEN round(p, 6) END AS flammableProp FROM
 (SELECT block, avg(CASE WHEN lcc NOT IN (0, 7, 8) THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT {BLOCK} AS block, lcc FROM cell) GROUP BY block) JOIN
 (SELECT block, lcc FROM (SELECT block, lcc, row_number() OVER (PARTITION BY block ORDER BY k DESC, lcc) o FROM (SELECT {BLOCK} AS block, lcc, count(*) k FROM cell WHERE lcc NOT IN (0, 7, 8) GROUP BY 1, 2)) WHERE o = 1) USING (block)""")
def make_lcc(v):
    return H.make_lcc(v.cell, grid_of(v), 5, (0, 7, 8), 0.3).withColumn("flammableProp", r6("flammableProp"))


@query("SELECT pixelID, nf_low, nf_high FROM landcover")
def make_landcover(v):
    return H.make_landcover(v.cell, {"nf_low": [1, 2], "nf_high": [3, 4]})


@query("SELECT e.FuelClass, c.pixelGroup, CAST(floor(sum(c.B) + 0.5) AS INT) AS B FROM cohort c JOIN spp_equiv e USING (speciesCode) GROUP BY ALL")
def biomass_by_class(v):
    return H.biomass_by_class(v.cohort.join(v.spp_equiv, "speciesCode"))


FUEL = ", ".join(f"CASE WHEN l.nf_low + l.nf_high > 0 THEN 0 ELSE coalesce(max(CASE WHEN b.FuelClass = '{k}' THEN b.B END), CASE WHEN c.flammable IS NOT NULL THEN 0 END) END AS {k}" for k in (*CLASSES, "youngAge"))
FUEL_BODY = f"""m AS (SELECT pixelGroup, max(age) AS maxAge FROM cohort GROUP BY pixelGroup), k AS (SELECT CASE WHEN m.maxAge <= 15 THEN 'youngAge' ELSE e.FuelClass END AS FuelClass, pixelGroup, h.B FROM cohort h JOIN m USING (pixelGroup) JOIN spp_equiv e USING (speciesCode)),
 b AS (SELECT FuelClass, pixelGroup, CASE WHEN FuelClass = 'youngAge' THEN 1 ELSE CAST(floor(sum(B) + 0.5) AS INT) END AS B FROM k GROUP BY FuelClass, pixelGroup),
 fuel AS (SELECT c.pixelID, {FUEL} FROM cell c LEFT JOIN b ON b.pixelGroup = c.pixelGroup LEFT JOIN landcover l ON l.pixelID = c.pixelID GROUP BY c.pixelID, c.flammable, l.nf_low, l.nf_high)"""


def fuel_layers(v: Views) -> DataFrame:
    return H.cohorts_to_fuel_classes(v.cohort, v.cell, v.cell, v.landcover, v.spp_equiv, CLASSES)


@query(f"WITH {FUEL_BODY} SELECT * FROM fuel")
def cohorts_to_fuel_classes(v):
    return fuel_layers(v)


@query("""WITH f AS (SELECT pixelID, min(burnYear) AS burnYear FROM burn_year WHERE burnYear BETWEEN 1995 AND 1997 GROUP BY pixelID)
 SELECT p.pixelID, p.pixelGroup, c.speciesCode, c.age, c.B, f.burnYear FROM cell p JOIN cohort c ON c.pixelGroup = p.pixelGroup LEFT JOIN f ON f.pixelID = p.pixelID""")
def cohort_burn_history(v):
    return H.cohort_burn_history(v.cohort, v.cell, v.burn_year, 1995, 1997)


@query("""WITH f AS (SELECT DISTINCT pixelID FROM burn_year WHERE burnYear BETWEEN 1995 AND 1997) SELECT c.pixelID, c.lcc, CASE WHEN c.lcc IN (1, 2) THEN NULL ELSE h.speciesCode END AS speciesCode, h.B,
 CASE WHEN f.pixelID IS NULL THEN 0 ELSE 1 END AS burned, 1995 AS year FROM cell c LEFT JOIN cohort h ON h.pixelGroup = c.pixelGroup LEFT JOIN f ON f.pixelID = c.pixelID WHERE c.lcc NOT IN (0, 8)""")
def fuel_class_prep(v):
    return H.fuel_class_prep(v.cohort, v.cell, v.burn_year, (0, 8), (1, 2), 1995, 1997)


@query("""WITH t AS (SELECT c.pixelID, c.age, c.flammable, CASE WHEN f.fireYear > 1997 THEN 16 ELSE 1997 - f.fireYear END AS tsd, c.lcc < 5 AS u FROM cell c LEFT JOIN fire_raster f ON f.pixelID = c.pixelID)
 SELECT pixelID, CASE WHEN flammable = 1 THEN CASE WHEN u AND tsd <= 15 THEN tsd WHEN u AND (age IS NULL OR age <= 15) THEN 16 ELSE age END END AS tsd FROM t""")
def make_tsd(v):
    return H.make_tsd(v.cell.join(v.fire_raster, "pixelID", "left").withColumn("update", F.col("lcc") < 5), 1997)


@query(f"""WITH vs AS ({VERTICES}), e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) nx, coalesce(lead(y) OVER w, first_value(y) OVER w) ny FROM vs WHERE "YEAR" BETWEEN 1981 AND 1997 WINDOW w AS (PARTITION BY poly_id ORDER BY seq)),
 i AS (SELECT poly_id, "YEAR" AS yr, pixelID FROM cell JOIN e ON least(y, ny) <= -(r + 0.5) * 250.0 AND -(r + 0.5) * 250.0 < greatest(y, ny) AND x + (-(r + 0.5) * 250.0 - y) * (nx - x) / (ny - y) > (c + 0.5) * 250.0 GROUP BY poly_id, "YEAR", pixelID HAVING count(*) % 2 = 1),
 b AS (SELECT pixelID, max(yr) AS yr FROM i GROUP BY pixelID), t AS (SELECT c.pixelID, c.age, 1998 - CASE WHEN c.age IS NOT NULL THEN coalesce(b.yr, 1982) END AS tsd, l.pixelID IS NOT NULL AS f, coalesce(l.nf_low + l.nf_high, 0) > 0 AS u FROM cell c LEFT JOIN b USING (pixelID) LEFT JOIN landcover l USING (pixelID))
 SELECT pixelID, CAST(CASE WHEN f THEN CASE WHEN u AND tsd <= 15 THEN tsd WHEN u AND (age IS NULL OR age <= 15) THEN 16 ELSE age END END AS INTEGER) AS tsd FROM t""")
def make_tsd_polygons(v):
    return H.make_tsd(v.cell.select("pixelID", "age"), 1998, polygons=vertices(v), grid=grid_of(v), lcc=v.landcover)


@query("""WITH y AS (SELECT * FROM (VALUES (1995, 0), (1996, 1), (1997, 2), (1998, 3)) q(year, k)), g AS (SELECT c.pixelID, c.age, y.year, y.k, max(CASE WHEN b.burnYear IS NOT NULL THEN z.k END) AS j FROM cell c CROSS JOIN y
 LEFT JOIN y z ON z.k < y.k LEFT JOIN (SELECT DISTINCT pixelID, burnYear FROM burn_year) b ON b.pixelID = c.pixelID AND b.burnYear = z.year GROUP BY ALL) SELECT pixelID, year, CASE WHEN coalesce(coalesce(k - j, age + k) <= 15, TRUE) THEN 1 ELSE 0 END AS youngAge FROM g""")
def calc_young_age(v):
    return H.calc_young_age(YEARS, v.cell.select("pixelID", "age"), v.burn_year.select("pixelID", F.col("burnYear").alias("year")))


@query(f"""WITH {FUEL_BODY} SELECT f.pixelID, {", ".join(f"CASE WHEN coalesce(l.nf_low + l.nf_high > 0 AND c.age < 15, FALSE) THEN 0 ELSE f.{k} END AS {k}" for k in CLASSES)},
 CASE WHEN coalesce(l.nf_low + l.nf_high > 0 AND c.age < 15, FALSE) THEN 1 WHEN f.BlkSprc IS NOT NULL THEN 0 END AS youngAge FROM fuel f JOIN cell c ON c.pixelID = f.pixelID LEFT JOIN landcover l ON l.pixelID = f.pixelID""")
def calc_nonforest_young_age(v):
    return H.calc_nonforest_young_age(v.landcover, v.cell.select("pixelID", F.col("age").alias("tsd")), fuel_layers(v))


@query("""WITH n AS (SELECT year, pixelID, count(*) k FROM (SELECT year, pixelID FROM fire_buffered WHERE buffer = 1) GROUP BY ALL) SELECT c.pixelID, c.year, c.MDC, l.nf_low, l.nf_high, coalesce(n.k, 0) AS ignitions
 FROM climate c JOIN landcover l ON l.pixelID = c.pixelID LEFT JOIN n ON n.pixelID = c.pixelID AND n.year = c.year WHERE c.year IN (1995, 1996, 1997, 1998)""")
def stack_and_extract(v):
    return H.stack_and_extract(v.climate.select("pixelID", "year", "MDC"), v.landcover, v.fire_buffered.where("buffer = 1").select("pixelID", "year"), YEARS)


MERGED = """WITH n AS (SELECT year, pixelID, count(*) k FROM (SELECT year, pixelID FROM fire_buffered WHERE buffer = 1) GROUP BY ALL) SELECT c.pixelID, c.year, coalesce(n.k, 0) AS ignitions, c.MDC, CASE WHEN e.age <= 15 THEN 1 ELSE 0 END AS youngAge, l.nf_low, l.nf_high, e.lcc AS lightning
 FROM climate c JOIN landcover l ON l.pixelID = c.pixelID JOIN cell e ON e.pixelID = c.pixelID LEFT JOIN n ON n.pixelID = c.pixelID AND n.year = c.year WHERE c.year IN (1995, 1996, 1997, 1998) AND e.age IS NOT NULL AND l.nf_low + l.nf_high > 0"""


def merge_parts(v):
    static = v.landcover.join(v.cell.select("pixelID", (F.col("age") <= 15).cast("int").alias("youngAge")), "pixelID")
    points = v.fire_buffered.where("buffer = 1").select("pixelID", "year")
    one = lambda years: H.stack_and_extract(v.climate.select("pixelID", "year", "MDC"), static, points, years)
    return one(YEARS[:2]), one(YEARS[2:]), v.cell.select("pixelID", F.col("lcc").alias("lightning"))


@query(MERGED)
def merge_prepared_covs(v):
    *parts, lightning = merge_parts(v)
    return H.merge_prepared_covs(parts, ["nf_low", "nf_high"], ["MDC"], lightning)


@query(MERGED)
def merge_bucketed_covs(v):
    """The parts and the layer written in buckets of pixels first: they meet without a shuffle."""
    buckets = max(8, v.spark.sparkContext.defaultParallelism)
    dealt = [A.write_bucketed(t, f"pixels_{uuid.uuid4().hex}", buckets, path=scratch(v.spark, "pixels")) for t in merge_parts(v)]
    return H.merge_prepared_covs(dealt[:2], ["nf_low", "nf_high"], ["MDC"], dealt[2])


@query(f"SELECT k.year, {BLOCK} AS block, round(avg(MDC), 6) AS MDC, round(avg(CMDsm), 6) AS CMDsm FROM climate k JOIN cell USING (pixelID) GROUP BY ALL")
def coarse_climate(v):
    return H.coarse(v.climate, grid_of(v), 5, ["MDC", "CMDsm"], ["year"], na_rm=True).withColumns({"MDC": r6("MDC"), "CMDsm": r6("CMDsm")})


@query(f"SELECT {BLOCK} AS block, CASE WHEN count(*) = 25 THEN round(avg(nf_low), 6) END AS nf_low, CASE WHEN count(*) = 25 THEN round(avg(nf_high), 6) END AS nf_high FROM landcover JOIN cell USING (pixelID) GROUP BY 1")
def coarse_fuel(v):
    return H.coarse(v.landcover, grid_of(v), 5, ["nf_low", "nf_high"]).withColumns({"nf_low": r6("nf_low"), "nf_high": r6("nf_high")})


@query("SELECT pixelID, round((MDC - (SELECT avg(MDC) FROM climate)) / (SELECT stddev_samp(MDC) FROM climate), 6) AS MDC FROM climate")
def rescale_covariates(v):
    return H.rescale_covariates(v.climate.select("pixelID", "MDC"), "xgb", keep=("pixelID",))[0].withColumn("MDC", r6("MDC"))


@query("""SELECT c.pixelID, c.year, round(0.1 + 0.4 / pow(1 + pow(exp((c.MDC / 400.0) * 2.0 + CASE WHEN c.MDC <> 0 THEN 0 ELSE l.nf_low END), -1.0), 0.5), 6) AS spreadProb FROM climate c JOIN landcover l ON l.pixelID = c.pixelID""")
def spread_probability(v):
    annual = v.climate.select("pixelID", "year", C.as_integer(F.col("MDC") * 1000).alias("MDC"))
    periods = v.landcover.select("pixelID", "nf_low", F.lit(1990).alias("start"))
    covs = H.spread_covariates(annual, periods, {"MDC": (0.0, 400.0)}, {"MDC": ["^nf_low$"]})
    return H.spread_probability(covs, ["MDC", "nf_low"], [0.5, 1.0], [2.0, 1.0]).select("pixelID", "year", r6("spreadProb").alias("spreadProb"))


# summaries and scores


@query("WITH b AS (SELECT DISTINCT pixelID FROM burn_year) SELECT lcc, count(*) AS available, count(b.pixelID) AS nburned, round_even(count(b.pixelID) / count(*) * 100, 3) AS percentBurned FROM cell LEFT JOIN b USING (pixelID) GROUP BY lcc")
def percent_burned_by_class(v):
    b = v.burn_year.select("pixelID").distinct().withColumn("burned", F.lit(1))
    return E.percent_burned_by_class(v.cell.join(b, "pixelID", "left").na.fill(0, ["burned"]))


@query("""SELECT CAST(year - 1994 + 2000 AS INT) AS year, 'historical' AS stat, median(MDC) AS MDC FROM climate WHERE pixelID IN (SELECT pixelID FROM cell WHERE flammable > 0) GROUP BY 1
 UNION ALL SELECT CAST(year - 1994 + 2010 AS INT), 'projected', median(MDC + 1) FROM climate WHERE pixelID IN (SELECT pixelID FROM cell WHERE flammable > 0) GROUP BY 1""")
def compare_climate(v):
    c = v.climate.select("pixelID", (F.col("year") - 1994).alias("layer"), "MDC")
    return E.compare_climate(c, c.withColumn("MDC", F.col("MDC") + 1), v.cell, "MDC")


@query("SELECT YEAR AS year, round(sum(SIZE_HA), 4) AS area, count(*) AS n FROM fire_points WHERE SIZE_HA > 6.25 GROUP BY YEAR")
def observed_burns(v):
    return E.observed_burns(v.fire_points.select(F.col("YEAR").alias("year"), "SIZE_HA", F.col("SIZE_HA").alias("POLY_HA")), 6.25).withColumn("area", F.round("area", 4))


@query("SELECT year, round(sum(areaBurnedHa), 4) AS area, count(*) FILTER (WHERE areaBurnedHa > 6.25) AS n FROM burn_summary GROUP BY year HAVING n > 0")
def projected_burns(v):
    return E.projected_burns(v.burn_summary, 6.25).withColumn("area", F.round("area", 4))


@query("SELECT YEAR AS year, 'observed' AS stat, count(*) AS n FROM fire_points GROUP BY YEAR UNION ALL SELECT year, 'projected', count(*) FROM burn_summary GROUP BY year")
def ignition_counts(v):
    return E.ignition_counts(v.points, v.burn_summary)


LONG = """SELECT year, rep, unnest(['areaBurned', 'nFires', 'meanSize']) AS var, unnest([sum(areaBurnedHa), CAST(count(*) AS DOUBLE), avg(CASE WHEN areaBurnedHa > 6.25 THEN areaBurnedHa END)]) AS val FROM burn_summary GROUP BY year, rep"""


@query(f"SELECT year, rep, var, round(val, 4) AS val FROM ({LONG}) WHERE val IS NOT NULL")
def burn_summary_long(v):
    return E.burn_summary_long(v.burn_summary, 6.25).withColumn("val", F.round("val", 4))


@query(f"""SELECT var, round(slope, 4) AS slope, round(intercept, 2) AS intercept, n, CASE WHEN sqrt(r2 * (n - 2) / (1 - r2)) > {t_quantile(2.5758293035489004, "(n - 2)")} THEN 1 ELSE 0 END AS significant
 FROM (SELECT var, regr_slope(val, year) AS slope, regr_intercept(val, year) AS intercept, regr_r2(val, year) AS r2, count(val) AS n FROM ({LONG}) WHERE val IS NOT NULL GROUP BY var)""")
def burn_trends(v):
    t = E.burn_trends(E.burn_summary_long(v.burn_summary, 6.25))
    return t.select("var", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n", "significant")


@query("SELECT pixelID, count(*) / 5.0 AS burned FROM burn_year WHERE pixelID IN (SELECT pixelID FROM landcover) GROUP BY pixelID")
def cumulative_burn(v):
    return E.cumulative_burn(v.burn_year.withColumn("burned", F.lit(1)), 5, v.landcover)


@query("""SELECT iter, variable, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, round(var_samp(value), 2) AS variance,
 round(quantile_cont(value, 0.975) - quantile_cont(value, 0.025), 6) AS width FROM population GROUP BY iter, variable""")
def population_summary(v):
    return E.population_summary(v.population).withColumns({c: r6(c) for c in ("mean", "lo", "hi", "width")} | {"variance": F.round("variance", 2)})


@query(f"""WITH b AS (SELECT iter, min(value) AS value FROM population GROUP BY iter), s AS (SELECT CAST(k AS BIGINT) AS segment, b.* FROM b JOIN range(0, 100000) t(k) ON b.iter BETWEEN k * 25 AND k * 25 + 174)
 SELECT segment, round(slope, 6) AS slope, CASE WHEN sqrt(r2 * 173 / (1 - r2)) < {t_quantile(1.6448536269514722, "173.0")} THEN 1 ELSE 0 END AS flat FROM (SELECT segment, regr_slope(value, iter) AS slope, regr_r2(value, iter) AS r2 FROM s GROUP BY segment HAVING count(*) = 175)""")
def plateau(v):
    return E.plateau(v.population.groupBy("iter").agg(F.min("value").alias("value"))).select("segment", r6("slope").alias("slope"), "flat")


@query("""SELECT variable, CAST(least(floor(value / (50.0 / 15)) + 1, 15) AS INT) AS bin, count(*) AS n FROM population WHERE value BETWEEN 0 AND 50 GROUP BY ALL""")
def parameter_histograms(v):
    bounds = v.population.select("variable").distinct().select("variable", F.lit(0.0).alias("lower"), F.lit(50.0).alias("upper"))
    return E.parameter_histograms(v.population, bounds)


@query("""WITH l AS (SELECT p.pixelID, c.speciesCode, e.FuelClass, c.B FROM cell p JOIN cohort c ON c.pixelGroup = p.pixelGroup JOIN spp_equiv e USING (speciesCode)), t AS (SELECT pixelID, sum(B) tb FROM l GROUP BY pixelID)
 SELECT speciesCode, FuelClass, round(sum(CASE WHEN B / tb > 0.1 THEN 1 ELSE 0 END) / (SELECT count(*) FROM t), 6) AS relAbundance FROM l JOIN t USING (pixelID) GROUP BY ALL""")
def relative_abundance(v):
    land = T.expand_cohorts_to_pixels(v.cohort, v.cell.select("pixelID", "pixelGroup")).join(v.spp_equiv, "speciesCode").withColumn("year", F.lit(2001))
    return E.relative_abundance(land).withColumn("relAbundance", r6("relAbundance"))


@query("""WITH b AS (SELECT DISTINCT pixelID FROM burn_year) SELECT CASE WHEN lcc IN (1, 2, 3) THEN CAST(lcc AS VARCHAR) ELSE 'missingForest' END AS lcc, round(avg(CASE WHEN b.pixelID IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coef FROM cell LEFT JOIN b USING (pixelID) GROUP BY 1""")
def nonforest_burn_rate(v):
    b = v.burn_year.select("pixelID").distinct().withColumn("burned", F.lit(1))
    return E.nonforest_burn_rate(v.cell.join(b, "pixelID", "left").na.fill(0, ["burned"]), [1, 2, 3]).withColumn("coef", r6("coef"))


@query("SELECT zone, count(*) AS n FROM zone WHERE v > 0 GROUP BY zone HAVING count(*) > 100")
def large_zones(v):
    return E.large_zones(v.zone.where("v > 0"))


@query("SELECT initialLocus, round_even(sum(N) / 10.0, 0) AS simSize, count(*) AS fires FROM sim_sizes GROUP BY initialLocus")
def simulated_sizes(v):
    return E.simulated_sizes(v.sim_sizes, 10)


@query("""WITH p AS (SELECT f.year, f.pixelID, f.ids, f.buffer, least(coalesce(s.N, 0) / 10.0 + 0.001, 0.99) AS p FROM fire_buffered f LEFT JOIN (SELECT initialLocus AS pixelID, sum(N) AS N FROM sim_sizes GROUP BY 1) s USING (pixelID))
 SELECT year, pixelID, ids, round(p, 6) AS p, round(CASE WHEN buffer = 1 THEN ln(p) ELSE ln(1 - p) END, 6) AS logLik, buffer AS class FROM p""")
def burn_probability(v):
    sim = v.sim_sizes.groupBy(F.col("initialLocus").alias("pixelID")).agg(F.sum("N").alias("N"))
    out = E.burn_probability(sim, v.fire_buffered.withColumn("ignited", F.lit(0)), 10)
    return out.select("year", "pixelID", "ids", r6("p").alias("p"), r6("logLik").alias("logLik"), "class")


@query("SELECT cells, year, ids, size FROM (SELECT cells % 50 AS cells, year, ids, size, row_number() OVER (PARTITION BY cells % 50 ORDER BY size DESC, ids) AS n FROM historical WHERE size >= 2) WHERE n = 1")
def historical_fires(v):
    return E.historical_fires(v.historical.withColumn("cells", F.col("cells") % 50))


@query("""WITH s AS (SELECT initialLocus, round_even(sum(N) / 10.0, 0) AS simSize FROM sim_sizes GROUP BY 1) SELECT round(avg(abs(size - simSize)), 6) AS mad, count(*) AS n FROM historical JOIN s ON initialLocus = cells""")
def score_mad(v):
    return E.score_mad(v.historical.withColumn("batch", F.col("year") % 2), E.simulated_sizes(v.sim_sizes, 10)).withColumn("mad", r6("mad"))


@query("""WITH p AS (SELECT CAST(size AS DOUBLE) AS value, 1 AS f FROM historical UNION ALL SELECT CAST(N AS DOUBLE), 0 FROM sim_sizes), g AS (SELECT value, count(*) AS l, sum(f) AS f FROM p GROUP BY value),
 t AS (SELECT CAST(count(*) AS DOUBLE) AS t, CAST(sum(f) AS DOUBLE) AS n FROM p), k AS (SELECT l, sum(l) OVER (ORDER BY value) AS h, sum(f) OVER (ORDER BY value) AS a FROM g)
 SELECT round(sum(l / t * pow(t * a - n * h, 2.0) / (h * (t - h))) * max(1 / n + 1 / (t - n)) * 50, 6) AS ad FROM k, t WHERE h < t""")
def score_ad(v):
    a = v.historical.select(F.col("size").cast("double").alias("value"), F.lit(0).alias("sample"))
    return E.score_ad(a.union(v.sim_sizes.select(F.col("N").cast("double"), F.lit(1)))).withColumn("ad", r6("ad"))


@query("""WITH o AS (SELECT * FROM historical WHERE size > 1), s AS (SELECT initialLocus AS cells, sqrt(CAST(N AS DOUBLE)) AS v FROM sim_sizes WHERE N > 1),
 k AS (SELECT cells, count(*) AS k, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS a FROM s GROUP BY cells HAVING count(*) > 1),
 h AS (SELECT cells, 0.9 * (CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34) WHEN sd > 0 THEN sd WHEN a > 0 THEN a ELSE 1.0 END) * pow(k, -0.2) AS h FROM k),
 d AS (SELECT o.cells, avg(exp(-pow((o.size - s.v) / h.h, 2) / 2) / (h.h * 2.5066282746310002)) AS d FROM o JOIN s USING (cells) JOIN h USING (cells) GROUP BY o.cells)
 SELECT round(sum(-ln(greatest(coalesce(d.d, 0.0) * ln(o.size), 1e-29))), 4) AS snll_fs, count(*) AS n FROM o LEFT JOIN d USING (cells)""")
def score_snll_fs(v):
    return E.score_snll_fs(v.historical.where("size > 1"), v.sim_sizes).withColumn("snll_fs", F.round("snll_fs", 4))


@query("""WITH o AS (SELECT *, CASE WHEN size > 8 THEN 1 ELSE 2 END AS batch FROM historical WHERE size > 1), s AS (SELECT initialLocus AS cells, sqrt(CAST(N AS DOUBLE)) AS v FROM sim_sizes WHERE N > 1),
 k AS (SELECT cells, count(*) AS k, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS a FROM s GROUP BY cells HAVING count(*) > 1),
 h AS (SELECT cells, 0.9 * (CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34) WHEN sd > 0 THEN sd WHEN a > 0 THEN a ELSE 1.0 END) * pow(k, -0.2) AS h FROM k),
 d AS (SELECT o.cells, avg(exp(-pow((o.size - s.v) / h.h, 2) / 2) / (h.h * 2.5066282746310002)) AS d FROM o JOIN s USING (cells) JOIN h USING (cells) GROUP BY o.cells),
 y AS (SELECT batch, year, sum(-ln(greatest(coalesce(d.d, 0.0) * ln(o.size), 1e-29))) AS s FROM o LEFT JOIN d USING (cells) GROUP BY batch, year),
 b AS (SELECT batch, count(*) AS years, round_even(sum(s), 0) AS t FROM y GROUP BY batch)
 SELECT batch, years, CASE WHEN batch = 1 AND t > 550 * years THEN 1e6 ELSE t END AS snll_fs, CASE WHEN batch = 1 AND t > 550 * years THEN 1 ELSE 0 END AS bail FROM b""")
def batch_scores(v):
    observed = v.historical.where("size > 1").withColumn("batch", F.when(F.col("size") > 8, 1).otherwise(2))
    return E.batch_scores(E.score_snll_fs(observed, v.sim_sizes, by=["batch", "year"]), 550)


@query("SELECT cells, year, ids, size, greatest(1000.0, round_even(greatest(5.0, 14.0 - ln(size)) * size, 0)) AS maxSize FROM historical WHERE size > 0")
def max_sizes(v):
    return E.max_sizes(v.historical.where("size > 0"))


@query("SELECT quantile_cont(n, 0.3) AS q30, CASE WHEN quantile_cont(n, 0.3) < 2000 THEN 1 ELSE 0 END AS small FROM (SELECT count(*) AS n FROM fire_buffered GROUP BY year, ids)")
def buffer_size_check(v):
    return E.buffer_size_check(v.fire_buffered)


@query("""SELECT param_id, CASE WHEN bool_or(b1 + b2 * nf_low <= 0) THEN 1e20 ELSE round(sum(b1 + b2 * nf_low - nf_high * ln(greatest(b1 + b2 * nf_low, 1e-300))), 3) END AS nll FROM landcover CROSS JOIN candidates GROUP BY param_id""")
def ignition_nll(v):
    out = E.ignition_nll(v.landcover.withColumn("one", F.lit(1)), v.candidates, "nf_high", ["one", "nf_low"], ["b1", "b2"])
    return out.withColumn("nll", F.round("nll", 3))


@query("""WITH s AS (SELECT c.age AS s, CASE WHEN c.pixelID IN (SELECT pixelID FROM burn_year) THEN 1 ELSE 0 END AS y FROM cell c WHERE c.age IS NOT NULL), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s)
 SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM k""")
def auc(v):
    b = v.burn_year.select("pixelID").distinct().withColumn("y", F.lit(1))
    return E.auc(v.cell.where("age IS NOT NULL").join(b, "pixelID", "left").na.fill(0, ["y"]), "age", "y").withColumn("auc", r6("auc"))


# zones and spread scores


@query("""SELECT pixelID, CAST(coalesce(max(CASE WHEN v = 2 THEN zone + 1 END), max(CASE WHEN v = 1 THEN zone + 1 END), 0) AS INT) AS code
 FROM zone WHERE pixelID IN (SELECT pixelID FROM cell WHERE flammable = 1) GROUP BY pixelID""")
def zones_in_study_area(v):
    return Z.zones_in_study_area(v.zone, v.cell.where("flammable = 1"), F.col("zone") + 1)


@query('SELECT zone AS "ID", pixelID, CASE WHEN v = 1 THEN 1 ELSE 0 END AS buffer FROM zone WHERE v > 0')
def zone_polygons(v):
    return Z.zone_polygons(v.zone)


def zone_ids(v: Views) -> DataFrame:
    return v.zone.select(F.concat(F.col("zone").cast("string"), F.lit("."), (F.col("pixelID") % 3).cast("string")).alias("ID"))


def zone_fits(v: Views) -> DataFrame:
    return v.nation.select(F.concat((F.col("n_nationkey") % 4).cast("string"), F.lit("."), (F.col("n_regionkey") % 2).cast("string")).alias("ID"))


ZONE_IDS = """i AS (SELECT DISTINCT concat(CAST(zone AS VARCHAR), '.', CAST(pixelID % 3 AS VARCHAR)) AS "ID" FROM zone),
 f AS (SELECT DISTINCT concat(CAST(n_nationkey % 4 AS VARCHAR), '.', CAST(n_regionkey % 2 AS VARCHAR)) AS "ID" FROM nation)"""


@query(f"""WITH {ZONE_IDS} SELECT "ID", CASE WHEN "ID" IN (SELECT "ID" FROM f) THEN 2 ELSE 1 END AS status FROM i""")
def zone_status(v):
    return Z.zone_status(zone_ids(v), zone_fits(v))


@query(f"""WITH {ZONE_IDS} SELECT "ID" FROM i WHERE "ID" IN (SELECT "ID" FROM f) AND "ID" NOT LIKE '1.%' AND "ID" NOT LIKE '2.%'""")
def fitted_names(v):
    return Z.fitted_names(zone_ids(v), zone_fits(v))


@query("""WITH p AS (SELECT CASE WHEN buffer = 1 THEN ln(0.25 + (pixelID % 10) / 20.0) ELSE ln(0.75 - (pixelID % 10) / 20.0) END AS l FROM fire_buffered)
 SELECT round(-sum(l) / 6e4, 6) AS snll FROM p""")
def score_snll(v):
    step = (F.col("pixelID") % 10) / 20.0
    p = v.fire_buffered.select(F.when(F.col("buffer") == 1, F.log(0.25 + step)).otherwise(F.log(0.75 - step)).alias("logLik"))
    return E.score_snll(p).withColumn("snll", r6("snll"))


@query("""WITH g AS (SELECT CAST(user_id % 7 AS INT) AS param_id, CAST(1995 + event_id % 5 AS INT) AS year, median(p) AS med, median(o) AS m,
  quantile_cont(o, 0.1) AS q10, quantile_cont(o, 0.9) AS q90, quantile_cont(o, 0.25) AS q25 FROM
  (SELECT *, CASE WHEN p > 0.205 OR p > 0.297 THEN p END AS o FROM (SELECT user_id, event_id, CAST(0.2 AS DOUBLE) + (event_id % 97) * (user_id % 7) / CAST(1000 AS DOUBLE) AS p FROM events)) GROUP BY 1, 2),
 k AS (SELECT *, coalesce((q90 - q10) / m, 0.0) AS spread FROM g), r AS (SELECT *, coalesce(med BETWEEN 0.2 AND 0.5 AND spread > 0.025 AND q25 < 0.265, false) AS ok FROM k)
 SELECT param_id, year, round(med, 6) AS med, round(spread, 6) AS spread, CASE WHEN ok THEN 1 ELSE 0 END AS pass, CASE WHEN NOT ok THEN CAST(200.324903 AS DOUBLE) END AS score FROM r""")
def landscape_gate(v):
    prob = F.lit(0.2) + (F.col("event_id") % 97) * (F.col("user_id") % 7) / F.lit(1000.0)
    p = v.events.select((F.col("user_id") % 7).cast("int").alias("param_id"), (1995 + F.col("event_id") % 5).cast("int").alias("year"), prob.alias("spreadProb"), F.lit(3).alias("n_fires"))
    out = E.landscape_gate(p, 0.2, 0.5, 0.3)
    return out.withColumns({c: r6(c) for c in ("med", "spread", "score")})


# fits


@query("""WITH m AS (SELECT zone AS f, pixelID, v FROM zone WHERE v > 0 AND zone = 5), z AS (SELECT * FROM zone WHERE v > 0 AND zone <> 5),
 o AS (SELECT m.f, z.zone, count(*) AS n FROM m JOIN z ON z.pixelID = m.pixelID GROUP BY m.f, z.zone HAVING max(m.v) = 2),
 t AS (SELECT f, zone FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, zone) AS k FROM o) WHERE k = 1),
 b AS (SELECT zone, pixelID, v, CAST(NULL AS INT) AS f FROM z UNION ALL SELECT t.zone, m.pixelID, m.v, m.f FROM m JOIN t ON t.f = m.f)
 SELECT zone, pixelID, max(v) AS v, max(f) AS lost_by FROM b GROUP BY zone, pixelID""")
def slivers_reassigned(v):
    cells = v.zone.where("v > 0")
    return M.slivers_reassigned(cells.where("zone <> 5"), cells.where("zone = 5"))


@query()
def fit_fuel_glm(v):
    return M.fit_fuel_glm(H.fuel_class_prep(v.cohort, v.cell, v.burn_year, (0, 8), (1, 2), 1995, 1997), SPECIES)
