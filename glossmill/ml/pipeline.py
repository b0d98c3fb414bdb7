"""Encoders, design matrices, stacking, cross-fold importances and saved linear models."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions.ranges import quantiles
from glossmill.ml.models import Model, linear_model, mllib, ridge
from glossmill.operators.checks import ModelError

NONE = "__NA__"


def impute(train: DataFrame, columns: Mapping[str, str], constant: object = 0) -> Callable[[DataFrame], DataFrame]:
    """Fills learned on `train`: column -> median, mode (ties: smallest) or constant. NaN counts as missing; columns without values get the constant."""
    types = dict(train.dtypes)
    value = lambda c: F.when(~F.isnan(c), F.col(c)) if types[c] in ("double", "float") else F.col(c)
    fills: dict[str, object] = {}
    for c, how in columns.items():
        if how == "constant":
            fills[c] = constant
        elif how == "median":
            fills[c] = quantiles(train.select(value(c).alias("v")), "v", [0.5]).first().q[0]
        elif how == "mode":
            top = train.select(value(c).alias("v")).filter("v IS NOT NULL").groupBy("v").count().orderBy(F.desc("count"), "v").first()
            fills[c] = top.v if top else None
        else:
            raise ModelError("unknown imputer", column=c, how=how)
    return lambda df: df.withColumns({c: F.coalesce(value(c), F.lit(constant if fills[c] is None else fills[c])) for c in columns})


def levels(train: DataFrame, column: str, most: int = 1_000) -> list[str]:
    """Distinct values of a categorical column, missing ones as one of their own, sorted; raises beyond `most`, where an index would serve better."""
    found = [r.v for r in train.select(F.coalesce(F.col(column).cast("string"), F.lit(NONE)).alias("v")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ModelError("too many levels", column=column, most=most)
    return sorted(found)


def dummies(column: str, known: Sequence[str]) -> dict[str, Column]:
    """0/1 columns `<column>_<level>`; values that training lacked are 0 in all."""
    v = F.coalesce(F.col(column).cast("string"), F.lit(NONE))
    return {f"{column}_{x}": (v == x).cast("double") for x in known}


def one_hot(train: DataFrame, columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Encoder that appends the columns' dummies, levels learned on `train`."""
    cols = {n: c for col in columns for n, c in dummies(col, levels(train, col)).items()}
    return lambda df: df.withColumns(cols)


def design_matrix(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], interactions: Sequence[tuple[str, Sequence[str]]] = ()) -> tuple[DataFrame, list[str]]:
    """Rows with a regression's columns, and their names.

    Numeric ones are filled with the median and standardized (0 where constant), categorical ones become dummies with
    missing values as a level, interactions (moderator, features) multiply features by the moderator or each of its
    dummies. Columns of one value are left out. Other columns of df stay.
    """
    numeric, categorical = [c for c in numeric if c in df.columns], [c for c in categorical if c in df.columns]
    number = {c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")) for c in numeric}
    fill = {c: quantiles(df.select(e.alias("v")), "v", [0.5]).first().q[0] or 0.0 for c, e in number.items()}
    filled = {c: F.coalesce(number[c], F.lit(float(fill[c]))) for c in numeric}
    row = df.agg(F.lit(1).alias("_"), *[F.avg(e).alias(f"m_{c}") for c, e in filled.items()], *[F.stddev_pop(e).alias(f"s_{c}") for c, e in filled.items()]).first()
    z = {c: (e - float(row[f"m_{c}"] or 0.0)) / float(row[f"s_{c}"]) if row[f"s_{c}"] else e * 0.0 for c, e in filled.items()}
    known = {c: dummies(c, levels(df, c)) for c in categorical}
    out = dict(z) | {n: e for own in known.values() for n, e in own.items()}
    for moderator, features in interactions:
        sides = known.get(moderator) or ({moderator: z[moderator]} if moderator in z else {})
        out |= {f"{f}__x__{n}": z[f] * e for f in features if f in z for n, e in sides.items()}
    wide = df.select(*[c for c in df.columns if c not in out], *[e.alias(n) for n, e in out.items()])
    spread = wide.agg(F.lit(1).alias("_"), *[F.struct(F.min(F.col(f"`{n}`")).alias("a"), F.max(F.col(f"`{n}`")).alias("b")).alias(f"r{i}") for i, n in enumerate(out)]).first()
    kept = [n for i, n in enumerate(out) if spread[f"r{i}"].a != spread[f"r{i}"].b]
    return wide.drop(*[n for n in out if n not in kept]), kept


def error_regression(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], key: str, interactions: Sequence[tuple[str, Sequence[str]]] = (), least: int = 50, k: int = 5, alphas: Sequence[float] = (0.001, 0.01, 0.1, 1.0), ratios: Sequence[float] = (0.1, 0.5, 0.9), scope: str = "overall") -> tuple[DataFrame, DataFrame]:
    """Elastic-net regression of an error: a summary row (scope, status, n_rows, n_features, alpha, l1_ratio, fit_ and oof_ rmse, mae, r2) and its coefficients.

    status is insufficient_rows or empty_design_matrix where nothing is fitted. The pair of least squared error over
    `k` hash folds is chosen. Coefficients (feature_name, coefficient, abs_coefficient) come in falling size.
    """
    spark, schema = df.sparkSession, "scope string, status string, n_rows bigint, n_features int, alpha double, l1_ratio double, fit_rmse double, fit_mae double, fit_r2 double, oof_rmse double, oof_mae double, oof_r2 double"
    empty = spark.createDataFrame([], "feature_name string, coefficient double, abs_coefficient double")
    own = df.filter(F.col(target).try_cast("double").isNotNull() & ~F.isnan(F.col(target).try_cast("double")))
    n = own.count()
    if n < least:
        return spark.createDataFrame([(scope, "insufficient_rows", n, 0, *[None] * 8)], schema), empty
    matrix, names = design_matrix(own, numeric, categorical, interactions)
    if not names:
        return spark.createDataFrame([(scope, "empty_design_matrix", n, 0, *[None] * 8)], schema), empty
    flat = [f"x{i}" for i in range(len(names))]
    data = matrix.select(F.col(f"`{target}`").cast("double").alias("_y"), (F.pmod(F.xxhash64(F.col(key), F.lit(42)), F.lit(k)) + 1).alias("cv_fold"), *[F.col(f"`{c}`").alias(x) for c, x in zip(names, flat)]).cache()
    error = F.col("prediction") - F.col("_y")
    total = data.agg(F.var_pop("_y").alias("v")).first().v

    def measured(frame: DataFrame) -> tuple[float, float, float]:
        r = frame.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse")).first()
        return r.rmse, r.mae, 1 - r.mse / total if total else 0.0

    best = None
    for alpha in alphas:
        for ratio in ratios:
            parts = [mllib("elastic_net", data.filter(F.col("cv_fold") != f), flat, "_y", regParam=alpha, elasticNetParam=ratio)(data.filter(F.col("cv_fold") == f)).select("_y", "prediction") for f in range(1, k + 1)]
            oof = parts[0]
            for part in parts[1:]:
                oof = oof.unionByName(part)
            found = measured(oof)
            if best is None or found[0] < best[0][0]:
                best = (found, alpha, ratio)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    join = VectorAssembler(inputCols=flat, outputCol="features")
    fitted = LinearRegression(labelCol="_y", regParam=best[1], elasticNetParam=best[2]).fit(join.transform(data))
    fit = measured(fitted.transform(join.transform(data)))
    data.unpersist()
    rows = [(c, float(b), abs(float(b))) for c, b in zip(names, fitted.coefficients)]
    return spark.createDataFrame([(scope, "ok", n, len(names), best[1], best[2], *fit, *best[0])], schema), spark.createDataFrame(rows, empty.schema).orderBy(F.desc("abs_coefficient"), "feature_name")


def fold_importance(frames: DataFrame, model: str, kind: str) -> DataFrame:
    """Importances over folds: feature_name, mean_ and std_ of score, abs_score and normalized_score, n_folds, rank, model_name, score_kind.

    frames: feature_name, score, abs_score, normalized_score, fold. Deviations are those of a sample, 0 for one fold. The window holds one row per feature.
    """
    cols = [c for s in ("score", "abs_score", "normalized_score") for c in (F.avg(s).alias(f"mean_{s}"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias(f"std_{s}"))]
    out = frames.groupBy("feature_name").agg(*cols, F.countDistinct("fold").alias("n_folds"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_score"), "feature_name"))).withColumns({"model_name": F.lit(model), "score_kind": F.lit(kind)})


def fold_models(train: DataFrame, k: int, fit: Callable[[DataFrame], Model]) -> list[Model]:
    """A model for each fold, fitted on the others (column cv_fold)."""
    return [fit(train.filter(F.col("cv_fold") != f)) for f in range(1, k + 1)]


def mean_prediction(df: DataFrame, models: Sequence[Model], out: str = "prediction") -> DataFrame:
    """Mean of several models' predictions of the same rows, as one projection chain; nothing is joined."""
    base = df.columns
    for i, model in enumerate(models):
        df = model(df).withColumnRenamed("prediction", f"_p{i}")
    return df.select(*base, (sum((F.col(f"_p{i}") for i in range(1, len(models))), F.col("_p0")) / len(models)).alias(out))


def refit_prediction(train: DataFrame, dev: DataFrame, fit: Callable[[DataFrame], Model]) -> DataFrame:
    """Predictions of dev rows by a model fitted on all training rows."""
    return fit(train)(dev)


def stack(oof: DataFrame, predictions: Sequence[str], target: str, alpha: float = 0.0, k: int | None = None) -> tuple[Model, DataFrame]:
    """Stacked model on out-of-fold predictions (ordinary least squares, or ridge with `alpha`), and oof with its own prediction.

    k: cross-fitted, each row's stacked prediction by the rows of other folds (column cv_fold); in-sample if None.
    Rows with a missing prediction or target don't fit the model.
    """
    model = ridge(oof, predictions, target, alpha)[0]
    if k is None:
        return model, model(oof)
    out = None
    for f in range(1, k + 1):
        part = ridge(oof.filter(F.col("cv_fold") != f), predictions, target, alpha)[0](oof.filter(F.col("cv_fold") == f))
        out = part if out is None else out.unionByName(part)
    return model, out


def linear_shap(df: DataFrame, coefficients: Mapping[str, float], out: str = "shap_") -> DataFrame:
    """Exact contributions of a linear model: coefficient * (value - mean), a column each; the means are those of df, one aggregate."""
    names = [f for f in coefficients if f != "intercept"]
    means = df.agg(*[F.avg(f).alias(f) for f in names]).first()
    return df.withColumns({f"{out}{f}": float(coefficients[f]) * (F.col(f) - float(means[f] or 0.0)) for f in names})


def interaction_vector(a: str, b: str) -> Column:
    """[a, b, |a - b|, a * b] of two arrays of equal length."""
    x, y = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    return F.concat(x, y, F.zip_with(x, y, lambda i, j: F.abs(i - j)), F.zip_with(x, y, lambda i, j: i * j))


def save_linear(path: str, spark: SparkSession, coefficients: Mapping[str, float], about: Mapping[str, object] | None = None) -> None:
    """A linear model with its coefficients as one JSON row."""
    spark.createDataFrame([(json.dumps({"coefficients": dict(coefficients), "about": dict(about or {})}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_linear(path: str, spark: SparkSession) -> tuple[Model, dict]:
    """A saved linear model and what was stored about it; it predicts rows without a target. Missing features raise."""
    body = json.loads(spark.read.text(path).first().value)
    names = [f for f in body["coefficients"] if f != "intercept"]
    plain = linear_model(names, np.array([body["coefficients"][f] for f in names]), body["coefficients"].get("intercept", 0.0))

    def predict(df: DataFrame) -> DataFrame:
        missing = [f for f in names if f not in df.columns]
        if missing:
            raise ModelError("features are missing", missing=missing)
        return plain(df)

    return predict, body["about"]


def late_fusion(tabular: DataFrame, texts: DataFrame, key: str, prefix: str = "text_") -> tuple[DataFrame, list[str]]:
    """Tabular rows with their text vectors as columns, joined by key: the input of a regression on both; the new columns."""
    size = texts.agg(F.max(F.size("embedding")).alias("n")).first().n or 0
    names = [f"{prefix}{i}" for i in range(size)]
    return tabular.join(texts.select(key, *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), key, "left"), names


def check_matrix(df: DataFrame, array: str, size: int | None = None) -> None:
    """Raise if vectors differ in length (or from `size`) or hold NULL, NaN or infinity; one aggregate."""
    bad = F.exists(array, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    r = df.agg(F.min(F.size(array)).alias("a"), F.max(F.size(array)).alias("b"), F.count_if(F.coalesce(bad, F.lit(True))).alias("n")).first()
    if r.n or r.a != r.b or (size is not None and r.b not in (None, size)):
        raise ModelError("bad vectors", shortest=r.a, longest=r.b, expected=size, not_finite=r.n)


