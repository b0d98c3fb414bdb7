"""Data checks as one aggregate pass per table: violations come out as rows, raising is the caller's choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PipelineError(Exception):
    """Base of the engine's errors, with a context for the message."""

    def __init__(self, message: str, **context: object):
        super().__init__(message + (f" {context}" if context else ""))
        self.context = context


class ConfigError(PipelineError):
    """A configuration that can't be used."""


class DataError(PipelineError):
    """Input rows that break a declared check."""


class FeatureError(PipelineError):
    """A feature group whose output breaks its contract."""


class ModelError(PipelineError):
    """A model that can't be built or fitted."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise if a column is missing; looks at the schema only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataError("missing columns", missing=missing)


def new_columns(before: DataFrame, after: DataFrame, protected: Sequence[str] = ()) -> list[str]:
    """Columns a step added; raises if it lost a protected one."""
    require_columns(after, protected)
    return [c for c in after.columns if c not in before.columns]


def rules(columns: dict[str, Column]) -> list[Column]:
    """Aggregates that count the rows where each named condition holds."""
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in columns.items()]


def violations(df: DataFrame, conditions: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """check_name and n_bad (per group) of row-local conditions, from one pass."""
    wide = df.groupBy(*groups).agg(*rules(conditions)) if groups else df.agg(*rules(conditions))
    return wide.unpivot(list(groups), list(conditions), "check_name", "n_bad")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def item_conditions(allowed_l1: Sequence[str], text: Sequence[str], target: str, test_split: str = "test") -> dict[str, Column]:
    """Row-local checks of an item table: L1 allowed, no blank text, target present outside the test split, target finite."""
    out = {"l1_not_allowed": F.col("L1").isNull() | ~F.col("L1").isin(*allowed_l1)}
    out |= {f"blank_{c}": F.col(c).isNull() | (F.trim(c) == "") for c in text}
    return out | {"target_missing": (F.col("split") != test_split) & F.col(target).isNull(), "target_not_finite": F.isnan(target)}


def feature_conditions(features: Sequence[str]) -> dict[str, Column]:
    """Row-local checks of feature columns: NULL, NaN, negative."""
    out: dict[str, Column] = {}
    for f in features:
        out |= {f"null_{f}": F.col(f).isNull(), f"negative_{f}": F.col(f) < 0}
    return out


def all_zero(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features that are zero in every row; one aggregate."""
    row = df.agg(*[F.max(F.abs(F.col(f))).alias(f) for f in features]).first()
    return [f for f in features if row is not None and row[f] in (0, 0.0, None)]


def require(found: DataFrame) -> None:
    """Raise with the first failed checks; reads at most twenty rows."""
    bad = found.filter("n_bad > 0").limit(20).collect()
    if bad:
        raise DataError("checks failed", checks={r.check_name: r.n_bad for r in bad})
