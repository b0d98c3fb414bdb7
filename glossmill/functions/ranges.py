"""Positions, ranks and quantiles over groups of any size.

Values are counted first, so repeats cost nothing; distinct values are then sorted into ranges, each range sums
its own, and a small table of range totals turns local sums into global ones. No task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.session import durable


def running(df: DataFrame, weight: str, order: Sequence[str], out: str) -> DataFrame:
    """Rows with the sum of `weight` over all rows before them in a total order. A written table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(weight).alias("_range_total"))
    before = totals.select("_range", F.coalesce(F.sum("_range_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_range_before"))  # a row for each range
    local = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(out, F.coalesce(F.sum(weight).over(local), F.lit(0))).join(F.broadcast(before), "_range")
    return durable(summed.withColumn(out, F.col(out) + F.col("_range_before")).drop("_range", "_range_before"))


def value_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct non-NULL values of each group: groups, value, n (rows), before (rows of the group below it), total (rows of the group).

    No column of the groups or the value may have one of the last three names.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    summed = running(counts, "n", [*groups, value], "_all")
    per = summed.groupBy(*groups).agg(F.min("_all").alias("_start"), F.sum("n").alias("total"))
    joined = summed.join(per, list(groups)) if groups else summed.crossJoin(F.broadcast(per))  # one row
    return joined.select(*groups, value, "n", (F.col("_all") - F.col("_start")).alias("before"), "total")


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Quantiles with linear interpolation of each group: groups, total, q (array in the order of `probabilities`).

    Groups without values are absent; without groups there is always one row, with NULLs for no values.
    """
    known = value_ranks(df.select(*groups, F.col(value).alias("_ranked")), "_ranked", groups)
    at = lambda p: (F.col("total") - 1) * p
    held = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    parts = [F.max("total").alias("total")]
    for i, p in enumerate(probabilities):
        low, high = F.floor(at(F.lit(float(p)))), F.ceil(at(F.lit(float(p))))
        parts += [F.max(F.when(held(low), F.col("_ranked"))).cast("double").alias(f"_l{i}"), F.max(F.when(held(high), F.col("_ranked"))).cast("double").alias(f"_h{i}")]
    found = known.groupBy(*groups).agg(*parts) if groups else known.agg(*parts)
    mix = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (at(F.lit(float(p))) - F.floor(at(F.lit(float(p))))) for i, p in enumerate(probabilities)]
    return found.select(*groups, "total", F.array(*mix).alias("q"))


def min_ranks(df: DataFrame, value: str, groups: Sequence[str], out: str) -> DataFrame:
    """Rank of each row by falling value inside its group, the best of ties (1, 2, 2, 4); NULL for NULL."""
    ranked = value_ranks(df.select(*groups, F.col(value).alias("_ranked")), "_ranked", groups).select(*groups, F.col("_ranked").alias(value), (F.col("total") - F.col("before") - F.col("n") + 1).alias(out))
    return df.join(ranked, [*groups, value], "left")
