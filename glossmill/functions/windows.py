"""Ranking, binning and scaling over groups. Ranks and quantiles go by ranges of counted values, so a group may hold
all rows; the windows left partition by small groups or hold one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.ranges import quantiles, value_ranks


def average_ranks(df: DataFrame, value: str, groups: Sequence[str], out: str, descending: bool = False) -> DataFrame:
    """Average rank of ties among non-NULL values of a group; NULL values get NULL. Groups may be of any size."""
    known = value_ranks(df.select(*groups, F.col(value).alias("_ranked")), "_ranked", groups)
    below = F.col("total") - F.col("before") - F.col("n") if descending else F.col("before")
    return df.join(known.select(*groups, F.col("_ranked").alias(value), (below + (F.col("n") + 1) / 2.0).alias(out)), [*groups, value], "left")


def percentile_ranks(df: DataFrame, value: str, groups: Sequence[str], out: str, descending: bool = False) -> DataFrame:
    """Average rank over the number of non-NULL values of the group."""
    total = df.groupBy(*groups).agg(F.count(value).alias("_t")) if groups else df.agg(F.count(value).alias("_t"))
    ranked = average_ranks(df, value, groups, "_r", descending)
    joined = ranked.join(total, list(groups)) if groups else ranked.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn(out, F.col("_r") / F.col("_t")).drop("_r", "_t")


def zscores(df: DataFrame, value: str, groups: Sequence[str], out: str) -> DataFrame:
    """(x - mean) / population deviation inside a group; 0 where the deviation is 0 or unknown, NULL for NULL."""
    s = df.groupBy(*groups).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return df.join(s, list(groups), "left").withColumn(out, F.when(F.col(value).isNull() & (F.col("_s") > 0), None).otherwise(z)).drop("_m", "_s")


def scale_by_max(df: DataFrame, value: str, groups: Sequence[str], out: str) -> DataFrame:
    """Value over the group's largest (1 if that isn't positive)."""
    s = df.groupBy(*groups).agg(F.max(value).alias("_m"))
    return df.join(s, list(groups), "left").withColumn(out, F.col(value) / F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.lit(1.0))).drop("_m")


def quantile_edges(df: DataFrame, value: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct quantile edges (linear interpolation) of each group as an array column `edges`."""
    return quantiles(df, value, [i / bins for i in range(bins + 1)], groups).select(*groups, F.array_sort(F.array_distinct(F.array_compact("q"))).alias("edges"))


def right_closed_bin(value: Column, edges: Column) -> Column:
    """0-based bin of (lo, hi] with the lowest edge included; NULL outside."""
    last = F.size(edges) - 1
    inner = F.slice(edges, F.lit(2), F.greatest(last - 1, F.lit(0)))
    at = F.aggregate(inner, F.lit(0), lambda n, e: n + F.when(value > e, 1).otherwise(0))
    return F.when((value >= F.get(edges, F.lit(0))) & (value <= F.get(edges, last)), at)


def fixed_bins(value: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Right-closed fixed-edge bins with the lowest edge included; out of range gives NULL."""
    at = right_closed_bin(value, F.array(*[F.lit(float(e)) for e in edges]))
    return at if labels is None else F.get(F.array(*[F.lit(x) for x in labels]), at)


def benjamini_hochberg(df: DataFrame, p: str, groups: Sequence[str], out: str, ties: Sequence[str] = ()) -> DataFrame:
    """Adjusted p-values: p * n / rank, made monotone from the largest down, clipped to [0, 1]; NULL passes."""
    known = df.filter(F.col(p).isNotNull())
    w = Window.partitionBy(*groups)
    ranked = known.withColumn("_k", F.row_number().over(w.orderBy(F.col(p), *ties))).withColumn("_n", F.count("*").over(w))
    down = w.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min(F.col(p) * F.col("_n") / F.col("_k")).over(down)))
    return ranked.withColumn(out, adjusted).drop("_k", "_n").unionByName(df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, out: str = "place") -> DataFrame:
    """First k rows of each group with their place; order must be total for a fixed result."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(out) <= k)


def keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each combination of `subset` in the given order, by a partial aggregate rather than a window."""
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*subset).agg(F.min_by(F.struct(*[c for c in df.columns if c not in subset]), key).alias("_f")).select(*subset, "_f.*").select(*df.columns)
