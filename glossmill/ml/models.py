"""Regressors and their surroundings. Linear models solve one-pass Gram matrices; trees and clusters use MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.ranges import running
from glossmill.operators.checks import ModelError

Model = Callable[[DataFrame], DataFrame]


class Preprocessor:
    """Median fill and scaling to zero mean and unit population deviation (0 deviation: scale 1), fitted in one aggregate."""

    def __init__(self, train: DataFrame, features: Sequence[str]):
        self.features = list(features)
        med = train.agg(*[F.median(f).alias(f) for f in features]).first()
        self.fill = {f: float(med[f]) if med[f] is not None else 0.0 for f in features}
        filled = [F.coalesce(F.col(f).cast("double"), F.lit(self.fill[f])) for f in features]
        row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(filled)]).first()
        self.mean = [row[f"m{i}"] or 0.0 for i in range(len(features))]
        self.scale = [row[f"s{i}"] or 1.0 for i in range(len(features))]

    def __call__(self, df: DataFrame) -> DataFrame:
        """Replace the features by their filled and scaled values."""
        return df.withColumns({f: (F.coalesce(F.col(f).cast("double"), F.lit(self.fill[f])) - m) / s for f, m, s in zip(self.features, self.mean, self.scale)})


def gram(df: DataFrame, features: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Centred X'X, X'y, n and mean y from one aggregate of p² sums; p is the number of features, never rows."""
    cols = [*features, target]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    prods = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    row = df.na.drop(subset=list(cols)).agg(F.count("*").alias("n"), *sums, *prods).first()
    if not row["n"]:
        raise ModelError("no rows to fit")
    n, s = row["n"], np.array([row[f"s{i}"] for i in range(len(cols))], dtype=float)
    m = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))], dtype=float) - np.outer(s, s) / n
    return m[:-1, :-1], m[:-1, -1], n, s[-1] / n


def linear_model(features: Sequence[str], beta: np.ndarray, intercept: float) -> Model:
    """Prediction by an expression."""
    value = F.lit(float(intercept)) + sum((float(b) * F.col(f) for f, b in zip(features, beta)), F.lit(0.0))
    return lambda df: df.withColumn("prediction", value)


def ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> tuple[Model, dict[str, float]]:
    """Closed-form ridge with free intercept; the model and its coefficients."""
    xx, xy, n, my = gram(train, features, target)
    beta = np.linalg.solve(xx + alpha * np.eye(len(features)), xy)
    means = train.na.drop(subset=[*features, target]).agg(*[F.avg(f).alias(f) for f in features]).first()
    intercept = my - sum(b * means[f] for f, b in zip(features, beta))
    return linear_model(features, beta, intercept), {**dict(zip(features, map(float, beta))), "intercept": float(intercept)}


def ridge_cv(train: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float] = (1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0), k: int = 5) -> tuple[Model, float]:
    """Ridge whose alpha has the least squared error over folds (column cv_fold 1..k).

    One scan gives every fold's raw moments; those of the other folds fit a model, and a fold's own moments give its
    error, so all alphas and folds are solved on the driver from k small matrices.
    """
    cols = [*features, target]
    names = ["1", *cols]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    prods = [F.sum(value(a) * value(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    size = len(names)
    moments = {r["cv_fold"]: np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], dtype=float) for r in train.na.drop(subset=cols).groupBy("cv_fold").agg(*prods).collect()}  # a row per fold
    if not moments:
        raise ModelError("no rows to fit")

    def solve(m: np.ndarray, alpha: float) -> np.ndarray:
        """Intercept and coefficients from raw moments."""
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        centred = m[1:, 1:] - n * np.outer(mean, mean)
        beta = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(len(features)), centred[:-1, -1])
        return np.concatenate([[mean[-1] - beta @ mean[:-1]], beta])

    whole = sum(moments.values())
    best = (np.inf, alphas[0])
    for alpha in alphas:
        err = 0.0
        for fold in moments.values():
            w = solve(whole - fold, alpha) if (whole - fold)[0, 0] > 0 else solve(whole, alpha)
            err += fold[-1, -1] - 2 * w @ fold[:-1, -1] + w @ fold[:-1, :-1] @ w
        best = min(best, (err, alpha))
    w = solve(whole, best[1])
    return linear_model(features, w[1:], w[0]), best[1]


def mllib(kind: str, train: DataFrame, features: Sequence[str], target: str, seed: int = 42, **params: object) -> Model:
    """elastic_net, gbr (also for xgboost), forest (also for extra trees), svr (Huber loss) from MLlib. Unknown kinds raise."""
    makers = {
        "elastic_net": lambda: LinearRegression(labelCol=target, **{"elasticNetParam": 0.5, "regParam": 0.01, **params}),
        "svr": lambda: LinearRegression(labelCol=target, loss="huber", **params),
        "gbr": lambda: GBTRegressor(labelCol=target, seed=seed, **{"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, **params}),
        "forest": lambda: RandomForestRegressor(labelCol=target, seed=seed, **{"numTrees": 20, **params}),
    }
    makers |= {"xgboost": makers["gbr"], "extra_trees": makers["forest"]}
    if kind not in makers:
        raise ModelError("unknown model", kind=kind, known=sorted(makers))
    join = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    fitted = makers[kind]().fit(join.transform(train.filter(F.col(target).isNotNull())))
    return lambda df: fitted.transform(join.transform(df)).drop("features")


def mean_ensemble(df: DataFrame, predictions: Sequence[str]) -> DataFrame:
    """Row-wise average of prediction columns."""
    return df.withColumn("prediction", sum((F.col(p) for p in predictions[1:]), F.col(predictions[0])) / len(predictions))


def weighted_ensemble(oof: DataFrame, models: str, gold: str, pred: str, key: str) -> DataFrame:
    """Predictions per key weighted by each model's inverse RMSE over its out-of-fold rows."""
    w = oof.groupBy(models).agg((1 / F.sqrt(F.avg(F.pow(F.col(pred) - F.col(gold), 2)))).alias("_w"))
    return oof.join(w, models).groupBy(key).agg((F.sum(F.col(pred) * F.col("_w")) / F.sum("_w")).alias("prediction"), F.count("*").alias("n_models"))


def importance(coefficients: dict[str, float], df: DataFrame) -> DataFrame:
    """feature_name, score, abs_score, normalized_score, rank of a linear model's coefficients."""
    rows = [(k, float(v)) for k, v in coefficients.items() if k != "intercept"]
    total = sum(abs(v) for _, v in rows)
    spark = df.sparkSession
    ordered = sorted(rows, key=lambda r: (-abs(r[1]), r[0]))
    return spark.createDataFrame([(k, v, abs(v), abs(v) / total if total else 0.0, i) for i, (k, v) in enumerate(ordered, 1)], "feature_name string, score double, abs_score double, normalized_score double, rank int")


def permutation_importance(df: DataFrame, model: Model, features: Sequence[str], target: str, key: str, repeats: int = 3, seed: int = 42) -> DataFrame:
    """Rise of RMSE when a feature's values are dealt to other rows: feature_name, repeat, drop.

    A shuffle gives every row the value of the row that has its position in another hash order; positions go by
    ranges, so no task holds more than a range, and an equi-join deals the values.
    """
    rmse = lambda d: d.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(target), 2)))).first()[0]
    base, out = rmse(model(df)), []
    placed = lambda d, s: running(d.withColumns({"_one": F.lit(1), "_hash": F.xxhash64(F.col(key), F.lit(s))}), "_one", ["_hash", key], "_i").drop("_one", "_hash")
    for r in range(repeats):
        takes, gives = placed(df, seed + 1000 + r), placed(df.select(key, *[F.col(f).alias(f"_{f}") for f in features]), seed + r + 1).drop(key)
        dealt = takes.join(gives, "_i")
        for f in features:
            out.append((f, r + 1, float(rmse(model(dealt.withColumn(f, F.col(f"_{f}")))) - base)))
    return df.sparkSession.createDataFrame(sorted(out), "feature_name string, repeat int, drop double")


def pca(df: DataFrame, array: str, k: int, out: str = "pca") -> tuple[DataFrame, list[float]]:
    """Principal components of an array column, centred first; the explained variance ratios."""
    size = F.size(array)
    n = df.select(F.max(size)).first()[0] or 0
    means = df.agg(*[F.avg(F.get(F.col(array), F.lit(i))).alias(f"m{i}") for i in range(n)]).first()
    mean = F.array(*[F.lit(float(means[f"m{i}"])) for i in range(n)])
    centred = df.withColumn("_v", array_to_vector(F.zip_with(F.col(array).cast("array<double>"), mean, lambda a, b: a - b)))
    fitted = PCA(k=k, inputCol="_v", outputCol="_p").fit(centred)
    return fitted.transform(centred).withColumn(out, vector_to_array("_p")).drop("_v", "_p"), [float(x) for x in fitted.explainedVariance]


def clusters(df: DataFrame, features: Sequence[str], k: int = 3, seeds: int = 3) -> DataFrame:
    """KMeans on scaled features, the cheapest of several seeds: cluster and distance columns."""
    scaled = Preprocessor(df, features)(df)
    data = VectorAssembler(inputCols=list(features), outputCol="_v").transform(scaled)
    best = min((KMeans(k=k, seed=s, featuresCol="_v", predictionCol="cluster").fit(data) for s in range(1, seeds + 1)), key=lambda m: m.summary.trainingCost)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in best.clusterCenters()])
    out = best.transform(data).withColumn("_a", vector_to_array("_v"))
    gap = F.aggregate(F.zip_with("_a", F.get(centers, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("distance", F.sqrt(gap)).drop("_v", "_a")


def normalized(array: str) -> Column:
    """L2-normalized array; zero vectors stay."""
    norm = F.sqrt(F.aggregate(F.col(array), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(F.col(array), lambda x: x / norm)).otherwise(F.col(array).cast("array<double>"))
