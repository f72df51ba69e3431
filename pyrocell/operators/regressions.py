"""Logistic regressions of all groups of a table at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocell.operators.ranks import joined_by
from pyrocell.storage import materialise


def two_sided(z: Column) -> Column:
    """Chance of a normal value as far from 0."""

    @F.arrow_udf("double")
    def chance(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else math.erfc(abs(v) / math.sqrt(2)) for v in values.to_pylist()], pa.float64())

    return chance(z)


def logistic_by(df: DataFrame, by: Sequence[str], x: str, label: str, rounds: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """(by, intercept, coef, p): for each group the regression of label (0 or 1) on x and the two-sided p-value of its slope.
    A group with one label or one x only has nulls; rows without x or label count for nothing; null keys are a group.

    Rows are counted by group, x and label first. A Newton step of all groups is one aggregate over those counts with
    each group's two coefficients beside it; rounds end when no group moves. A group that its x separates has no finite
    slope: it stops after so many rounds or where its second derivatives vanish."""
    by = list(by)
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.col(label).cast("double").alias("y")).dropna(subset=["x", "y"])
    counts = materialise(rows.groupBy(*by, "x", "y").agg(F.count("*").cast("double").alias("n")))
    spans = counts.groupBy(*by).agg(((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("fits"))
    state = materialise(spans.where("fits").select(*by, F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("var")))
    for _ in range(rounds):
        at = joined_by(counts, state.drop("var"), by).where("a IS NOT NULL")
        mu = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        w, rest = F.col("n") * mu * (1 - mu), F.col("n") * (F.col("y") - mu)
        total = lambda c: F.sum(c)
        sums = at.groupBy(*by, "a", "b").agg(total(w).alias("h0"), total(w * F.col("x")).alias("h1"), total(w * F.col("x") * F.col("x")).alias("h2"), total(rest).alias("g0"), total(rest * F.col("x")).alias("g1"))
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        move = lambda c: F.coalesce(F.try_divide(c, F.when(F.col("det") > 1e-12 * F.col("h0") * F.col("h2"), F.col("det"))), F.lit(0.0))
        da: Column = move(F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1"))
        db: Column = move(F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0"))
        state = sums.withColumn("det", det).select(*by, (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b"), F.try_divide("h0", "det").alias("var"), (F.abs(da) + F.abs(db)).alias("moved"))
        state = materialise(state)
        if state.where(F.col("moved") > tolerance * (1 + F.abs("a") + F.abs("b"))).isEmpty():
            break
    fitted = state.select(*by, F.col("a").alias("intercept"), F.col("b").alias("coef"), two_sided(F.try_divide(F.col("b"), F.sqrt("var"))).alias("p"))
    return joined_by(spans.select(*by), fitted, by)
