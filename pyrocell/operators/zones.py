"""Zones as cell tables (zone, pixelID, v): v is 2 in a zone's core, 1 in its buffer, 0 around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zones_in_study_area(zones: DataFrame, study: DataFrame, code: Column) -> DataFrame:
    """pixelID, code of every cell of the study area that a zone covers: of the zones with their core there the one
    of the greatest code, else of those with their buffer there, else 0. One aggregate, partial before its shuffle."""
    here = zones.join(study.select("pixelID").distinct(), "pixelID", "left_semi").where("v IS NOT NULL")
    best = F.coalesce(F.max(F.when(F.col("v") == 2, code)), F.max(F.when(F.col("v") == 1, code)), F.lit(0))
    return here.groupBy("pixelID").agg(best.alias("code"))


def zone_polygons(zones: DataFrame) -> DataFrame:
    """ID, pixelID, buffer (1 in the buffer, 0 in the core) of the cells that make up each zone."""
    return zones.where("v > 0").select(F.col("zone").alias("ID"), "pixelID", (F.col("v") == 1).cast("int").alias("buffer"))


def zone_status(zones: DataFrame, fitted: DataFrame) -> DataFrame:
    """ID and status of each zone: 2 where fitted has a row of its ID, else 1."""
    known = fitted.select("ID").distinct().withColumn("__fitted", F.lit(True))
    return zones.select("ID").distinct().join(known, "ID", "left").select("ID", F.when(F.col("__fitted"), 2).otherwise(1).alias("status"))


def fitted_names(zones: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """The zone IDs (strings) outside the arctic, whose IDs start with "1." or "2."; with fitted only those it has."""
    ids = zones.select("ID").distinct().where(~F.col("ID").rlike(r"^[12]\."))
    return ids if fitted is None else ids.join(fitted, "ID", "left_semi")
