"""Fold columns and out-of-fold bookkeeping. Assignments hash keys, so they hold under any partitioning."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions.stats import pearson
from glossmill.functions.windows import quantile_edges, right_closed_bin


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """cv_fold 1..k from a hash of the key; rows of one key share a fold (group folds: pass the group as key)."""
    return df.withColumn("cv_fold", (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)) + 1).cast("int"))


def stratified(df: DataFrame, key: str, target: str, k: int = 5, bins: int = 5, seed: int = 42) -> DataFrame:
    """Folds that deal each quantile bin of the target evenly: rows of a bin in hash order, split at the bin's quantiles of the hash."""
    edges = quantile_edges(df, target, bins)
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)).cast("double")
    binned = df.crossJoin(F.broadcast(edges)).withColumn("_bin", right_closed_bin(F.col(target), F.col("edges"))).withColumn("_u", u).drop("edges")  # one row of edges
    cuts = binned.groupBy("_bin").agg(F.percentile("_u", F.array(*[F.lit(i / k) for i in range(1, k)])).alias("_cuts"))
    fold = F.aggregate("_cuts", F.lit(1), lambda n, c: n + F.when(F.col("_u") > c, 1).otherwise(0))
    return binned.join(cuts, binned["_bin"].eqNullSafe(cuts["_bin"])).withColumn("cv_fold", fold).drop("_bin", "_u", "_cuts")


def fold_checks(df: DataFrame, key: str, k: int) -> DataFrame:
    """fold, n_rows, and n_shared: keys that stand in other folds too (0 if the folds are disjoint)."""
    per = df.groupBy(key).agg(F.countDistinct("cv_fold").alias("folds"))
    shared = df.join(per.filter("folds > 1"), key, "left_semi").groupBy("cv_fold").agg(F.countDistinct(key).alias("n_shared"))
    return df.groupBy("cv_fold").agg(F.count("*").alias("n_rows")).join(shared, "cv_fold", "left").na.fill(0, ["n_shared"])


def out_of_fold(df: DataFrame, k: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], keep: Sequence[str]) -> DataFrame:
    """Predictions of every row by the model fitted on the other folds: keep, oof_prediction, cv_fold."""
    out = None
    for fold in range(1, k + 1):
        model = fit(df.filter(F.col("cv_fold") != fold))
        part = model(df.filter(F.col("cv_fold") == fold)).select(*keep, F.col("prediction").alias("oof_prediction"), "cv_fold")
        out = part if out is None else out.unionByName(part)
    return out


def fold_summary(oof: DataFrame, gold: str = "target", pred: str = "oof_prediction") -> DataFrame:
    """Mean and sample deviation over folds of rmse, mae and pearson, with the value over all rows."""
    e = F.col(pred) - F.col(gold)
    cols = {"rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "pearson": pearson(gold, pred)}
    per = oof.groupBy("cv_fold").agg(*[c.alias(n) for n, c in cols.items()]).unpivot(["cv_fold"], list(cols), "metric", "v")
    whole = oof.agg(*[c.alias(n) for n, c in cols.items()]).unpivot([], list(cols), "metric", "overall")
    return per.groupBy("metric").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std")).join(whole, "metric")
