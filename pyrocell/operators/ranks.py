"""Running sums and quantiles in the order of a column, without one task or buffer that sees every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyrocell.storage import checkpointed


def running_sums(df: DataFrame, order: str, cols: Sequence[str]) -> DataFrame:
    """df with, for each of ``cols``, ``upto_`` it: the sum over all rows up to this one in ascending ``order``, which has
    no repeated value. Rows are range partitioned; a partition sums its own rows and adds the totals of the partitions
    before it, of which there are as many as partitions. Null values count as 0; a null order comes first."""
    ranged = checkpointed(df.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(*(F.sum(c).alias(f"all_{c}") for c in cols))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    totals = totals.select("part", *(F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"base_{c}") for c in cols))
    within = W.partitionBy("part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.withColumns({f"in_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in cols})
    return summed.join(F.broadcast(totals), "part").select(*df.columns, *((F.col(f"in_{c}") + F.col(f"base_{c}")).alias(f"upto_{c}") for c in cols))


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """For each group of ``by`` the exact quantiles of ``value`` named in ``at``, between two values in proportion. Null
    values count for nothing, a group of nulls alone has null quantiles; null keys are a group.

    Counts of distinct values are range partitioned by group and value, a partition ranks its own rows from the total of
    the partitions before it, and the two values about a quantile are picked by rank: no buffer holds a group."""
    per = df.groupBy(*by, F.col(value).alias("__v")).agg(F.count(value).alias("__c"))
    ranged = checkpointed(per.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__part").agg(F.sum("__c").alias("__t"))  # partitions + groups at most
    group, earlier = W.partitionBy(*by), W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__base"), F.sum("__t").over(group).alias("__n"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    within = W.partitionBy(*by, "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ranked = ranged.withColumn("__in", F.sum("__c").over(within)).join(bases, [F.col("__part") == F.col("__p"), *same])
    upto, place = F.col("__in") + F.col("__base"), {name: (F.col("__n") - 1) * F.lit(float(q)) for name, q in at.items()}
    holds = lambda rank: F.when((upto - F.col("__c") <= rank) & (rank < upto), F.col("__v"))
    picked = [x for name, p in place.items() for x in (F.max(holds(F.floor(p))).alias(f"__{name}_low"), F.max(holds(F.ceil(p))).alias(f"__{name}_high"), F.max(p).alias(f"__{name}_at"))]
    found = ranked.groupBy(*by).agg(*picked)

    def between(name: str) -> Column:
        low, high, p = (F.col(f"__{name}_{x}") for x in ("low", "high", "at"))
        return F.when(low == high, low.cast("double")).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return found.select(*by, *(between(name).alias(name) for name in at))


def joined_by(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """left with the columns of right's row of the same keys, where null equals null."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in by})
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left").drop(*(f"__{c}" for c in by))
