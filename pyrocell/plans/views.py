"""Derived views over the given tables: one SQL text each, run unchanged by Spark and by an ANSI-SQL engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "cell": """SELECT CAST(o_orderkey + 1 AS BIGINT) AS pixelID, CAST(floor(o_orderkey / 100.0) AS BIGINT) AS r,
        CAST(o_orderkey % 100 AS BIGINT) AS c, CAST(o_custkey % 9 AS INT) AS lcc,
        CASE WHEN o_custkey % 37 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN 0 ELSE 1 END AS flammable,
        CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(floor(o_orderkey / 2.0) AS BIGINT) END AS pixelGroup,
        CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 4000.0) AS INT) END AS age FROM orders""",
    "cohort": """SELECT CAST(floor(l_orderkey / 2.0) AS BIGINT) AS pixelGroup,
        CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Pice_mar' WHEN 'AO' THEN 'Pinu_con' WHEN 'NF' THEN 'Popu_tre'
        WHEN 'NO' THEN 'Betu_pap' WHEN 'RF' THEN 'Pice_gla' ELSE 'Abie_las' END AS speciesCode,
        CAST(l_quantity AS INT) AS age, CAST(floor(l_extendedprice) AS DOUBLE) AS B FROM lineitem""",
    "fire_buffered": """SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(l_orderkey + 1 AS BIGINT) AS pixelID,
        CAST(l_suppkey % 100 AS BIGINT) AS ids, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS buffer
        FROM lineitem GROUP BY year(l_shipdate), l_orderkey, l_suppkey % 100""",
    "fire_raster": """SELECT CAST(l_orderkey + 1 AS BIGINT) AS pixelID, CAST(max(year(l_shipdate)) AS INT) AS fireYear
        FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY l_orderkey""",
    "fire_points": """SELECT event_id AS FIRE_ID, CAST(1995 + event_id % 7 AS INT) AS YEAR, value AS SIZE_HA,
        CAST((event_id * 37) % 100 AS DOUBLE) * 250.0 + 125.0 AS x, -(CAST((event_id * 53) % 20 AS DOUBLE) * 250.0 + 125.0) AS y FROM events""",
    "climate": """SELECT CAST(l_orderkey + 1 AS BIGINT) AS pixelID, CAST(year(l_shipdate) AS INT) AS year, sum(l_quantity) AS MDC,
        max(l_quantity) AS CMDsm FROM lineitem GROUP BY l_orderkey, year(l_shipdate)""",
    "burn_summary": """SELECT CAST(user_id % 5 + 1 AS INT) AS rep, CAST(2011 + event_id % 20 AS INT) AS year, event_id AS N,
        value AS areaBurnedHa FROM events""",
    "sim_sizes": """SELECT CAST(l_linenumber AS INT) AS rep, CAST(l_orderkey % 1000 + 1 AS BIGINT) AS initialLocus, count(*) AS N
        FROM lineitem GROUP BY l_linenumber, l_orderkey % 1000""",
    "historical": """SELECT CAST(o_orderkey + 1 AS BIGINT) AS cells, CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderkey AS BIGINT) AS ids,
        CAST(floor(o_totalprice / 20000.0) AS INT) AS size FROM orders""",
    "population": """SELECT CAST(floor(event_id / 50.0) AS INT) AS iter, CAST(event_id % 50 AS INT) AS member, event_type AS variable, value
        FROM events""",
    "candidates": """SELECT CAST(s_suppkey AS INT) AS param_id, abs(s_acctbal) / CAST(20000 AS DOUBLE) AS b1,
        (s_nationkey + 1) / CAST(50 AS DOUBLE) AS b2 FROM supplier""",
    "zone": """SELECT CAST(l_suppkey % 6 AS INT) AS zone, CAST(l_orderkey + 1 AS BIGINT) AS pixelID,
        max(CASE WHEN l_linestatus = 'F' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS v FROM lineitem GROUP BY l_suppkey % 6, l_orderkey""",
    "listing": """SELECT concat('NBAC_1972to', CAST(2000 + p_partkey % 26 AS VARCHAR(10)), '_', CAST(20200101 + p_partkey AS VARCHAR(10)), '_shp.zip') AS name
        FROM part""",
    "landcover": """SELECT pixelID, CASE WHEN lcc IN (1, 2) THEN 1 ELSE 0 END AS nf_low, CASE WHEN lcc IN (3, 4) THEN 1 ELSE 0 END AS nf_high
        FROM cell WHERE lcc <> 0 AND flammable = 1""",
    "points": """SELECT FIRE_ID AS point_id, YEAR AS year, FIRE_ID % 100 AS ids, SIZE_HA AS size, x, y FROM fire_points""",
    "burn_year": """SELECT pixelID, year AS burnYear FROM fire_buffered WHERE buffer = 1""",
    "spp_equiv": """SELECT DISTINCT speciesCode, CASE speciesCode WHEN 'Pice_mar' THEN 'BlkSprc' WHEN 'Pinu_con' THEN 'LdJkPine' WHEN 'Popu_tre' THEN 'PopBrch'
        WHEN 'Betu_pap' THEN 'PopBrch' ELSE 'SprcFrLrch' END AS FuelClass FROM cohort""",
}


def needed(sql: str) -> list[str]:
    """Views a text uses, each after those it uses itself."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) and name not in out:
            out += [n for n in needed(VIEWS[name]) if n not in out]
            out.append(name)
    return out


def with_views(sql: str) -> str:
    """A self-contained query over the given tables."""
    names = needed(sql)
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    recursive = sql.startswith("WITH RECURSIVE ")
    body = sql.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
    return f"WITH {'RECURSIVE ' * recursive}{ctes}, {body}" if body != sql else f"WITH {ctes} {sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = with_views(VIEWS[name])
    for t in TABLES:
        if re.search(rf"\bFROM {t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


class Views:
    """v.cell and so on for one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.sf_dir, name)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)
