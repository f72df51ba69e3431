"""Readers and writers of pixel tables, fire archives and replicate output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyrocell.functions.columns import as_integer, token_from_year


def scan_pixels(spark: SparkSession, path: str, layers: Sequence[str], pixel: str = "pixelID") -> DataFrame:
    """The listed layers of a pixel table; others are never read."""
    return spark.read.parquet(path).select(pixel, *layers)


def read_lightning(spark: SparkSession, path: str, plots: int) -> DataFrame:
    """CSV lines of repeated (Lat, Long, LightningDensity) triples to a row per plot; rows with a null go."""
    names = [f"{c}{i}" for i in range(plots) for c in ("Lat", "Long", "LightningDensity")]
    wide = spark.read.csv(path, schema=", ".join(f"{n} double" for n in names), header=False)
    triples = F.array(*(F.struct(F.col(f"Lat{i}").alias("Lat"), F.col(f"Long{i}").alias("Long"), F.col(f"LightningDensity{i}").alias("LightningDensity")) for i in range(plots)))
    return wide.select(F.inline(triples)).dropna("any")


def read_burn_summaries(spark: SparkSession, path: str) -> DataFrame:
    """year, N, areaBurnedHa of the CSV files of repNN folders, with rep."""
    df = spark.read.csv(f"{path}/rep*", schema="year int, N bigint, areaBurnedHa double", header=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"/rep(\d+)/", 1).cast("int").alias("rep"), "year", "N", "areaBurnedHa")


def fire_points(df: DataFrame, lo: int, hi: int, res: float, size: str = "SIZE_HA") -> DataFrame:
    """Points of a closed range of years with date, size_ha and size in pixels."""
    kept = df.where(F.col("YEAR").between(lo, hi))
    return kept.select("FIRE_ID", F.col("YEAR").alias("date"), F.col(size).alias("size_ha"), as_integer(F.col(size) / F.lit(res * res) * F.lit(1e4)).alias("size"), "x", "y")


def fire_polygons(vertices: DataFrame, years: Sequence[int]) -> DataFrame:
    """poly_id, year token and POLY_HA (area of the ring, two decimals, half to even) for the listed years.

    Vertices: poly_id, YEAR (text or number), seq, x, y; the ring closes itself."""
    w = W.partitionBy("poly_id").orderBy("seq")
    ring = W.partitionBy("poly_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = vertices.withColumn("YEAR", F.col("YEAR").cast("int")).where(F.col("YEAR").isin(*years))
    v = v.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(ring)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(ring))})
    area = F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2
    return v.groupBy("poly_id", "YEAR").agg(F.bround(area / 10000, 2).alias("POLY_HA")).select("poly_id", token_from_year(F.col("YEAR")).alias("year"), "POLY_HA")


RELEASE = r"(NBAC_\d+to\d+_(\d{8})_shp\.zip)"


def latest_release(listing: DataFrame, text: str, fallback: str) -> DataFrame:
    """One row: the release name of greatest stamp found in the text, else the fallback."""
    names = listing.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(RELEASE), F.lit(1))).alias("name"))
    best = names.agg(F.max_by("name", F.struct(F.regexp_extract("name", RELEASE, 2), "name")).alias("name"))
    return best.select(F.coalesce("name", F.lit(fallback)).alias("name"))


def write_pixels(df: DataFrame, path: str, by: str | None = "year") -> None:
    """Replaces the table at path, a folder per value of ``by``."""
    (df.write.mode("overwrite").partitionBy(by) if by else df.write.mode("overwrite")).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "pixelID", path: str | None = None) -> DataFrame:
    """Replaces the catalog table with df dealt by key into so many buckets, each file in the key's order, and returns it.
    Tables of one number of buckets join on the key without a shuffle: bucket meets bucket. A bucket should be what a task can
    hold, some hundred MB. With a path the files lie there, else in the warehouse, which executors must share."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def load_checks(df: DataFrame | None, required: Sequence[str], name: str) -> DataFrame:
    """df if it is there, has rows and the required columns; a named message else."""
    if df is None:
        raise ValueError(f"{name} is missing")
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"{name} lacks {', '.join(lacking)}")
    if df.isEmpty():
        raise ValueError(f"{name} has no rows")
    return df
