"""Column-level steps of ingest and feature tables: casts, filters, selections, gates and small projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators.checks import DataError

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
# Columns that are never features.
NON_FEATURES = ("GLMM_score", "label", "split", "fold", "id", "item_id", "ID")


def is_numeric(kind: str) -> bool:
    """Whether a column type counts as a number."""
    return kind.startswith(NUMERIC)


def cast_columns(df: DataFrame, types: Mapping[str, str], nullable: Sequence[str] = ()) -> DataFrame:
    """Cast columns that exist; values that don't fit become NULL.

    An integer column outside `nullable` must not hold NULLs afterwards: one aggregate checks all of them and raises.
    """
    out = df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})
    strict = [c for c, t in types.items() if c in df.columns and c not in nullable and t in ("int", "bigint", "smallint", "tinyint")]
    if strict:
        row = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in strict]).first()
        bad = {c: row[c] for c in strict if row[c]}
        if bad:
            raise DataError("values don't fit their type", columns=bad)
    return out


def keep_only(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one value; raises if there are none."""
    out = df.filter(F.col(column) == value)
    if out.isEmpty():
        raise DataError("no rows are left", column=column, value=value)
    return out


def fill_or_create(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Missing columns become constants, NULLs of others too."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in constants.items()})


def feature_columns(train: DataFrame, dev: DataFrame | None = None, target: str = "GLMM_score", key: str = "item_id", include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns shared by both tables that may be features, sorted: not key or target, with an included prefix if any is given, without an excluded one."""
    types = dict(train.dtypes)
    shared = [c for c in train.columns if dev is None or c in dev.columns]
    kept = [c for c in shared if c not in (*NON_FEATURES, target, key) and is_numeric(types[c])]
    return sorted(c for c in kept if (not include or c.startswith(tuple(include))) and not (exclude and c.startswith(tuple(exclude))))


def should_compute(df: DataFrame, outputs: Sequence[str], mode: str = "always_compute") -> bool:
    """Whether a feature group must run: always_compute; compute_if_missing (an output is absent or all NULL); use_existing_only (raises if one is absent)."""
    absent = [c for c in outputs if c not in df.columns]
    if mode == "always_compute":
        return True
    if mode == "use_existing_only":
        if absent:
            raise DataError("outputs are missing", missing=absent)
        return False
    if mode != "compute_if_missing":
        raise DataError("unknown compute mode", mode=mode)
    if absent:
        return True
    row = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in outputs]).first()
    return not all(row[c] for c in outputs)


def replace_if_all_zero(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Take a column's values from another where the column is all zero or NULL and the other isn't; one aggregate for all pairs."""
    known = {d: s for d, s in pairs.items() if d in df.columns and s in df.columns}
    if not known:
        return df
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    row = df.agg(*[F.coalesce(F.sum(F.abs(number(c))), F.lit(0.0)).alias(c) for c in {*known, *known.values()}]).first()
    return df.withColumns({d: number(s) for d, s in known.items() if row[d] == 0 and row[s] > 0})


def slug(c: Column) -> Column:
    """Lower-case text with runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")


def first_variant(c: Column) -> Column:
    """First variant of an entry without parentheses; '' if none is left."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "[(（][^)）]*[)）]", " ")
    parts = F.filter(F.transform(F.split(bare, "[,;|/，；、]"), lambda p: F.trim(F.regexp_replace(p, "\\s+", " "))), lambda p: p != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(""))


def join_text(columns: Sequence[str], mode: str = "sep", separator: str = " [SEP] ") -> Column:
    """Text columns joined by a separator, line breaks or blanks (sep, newline, space); missing text is ''."""
    between = {"sep": separator, "newline": "\n", "space": " "}
    if mode not in between:
        raise DataError("unknown join mode", mode=mode)
    return F.concat_ws(between[mode], *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def non_empty_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name and the share of rows with text in it, from one aggregate."""
    wide = df.agg(*[F.avg(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1.0).otherwise(0.0)).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column_name", "rate")


def first_seen(df: DataFrame, category: str, order: str, out: str = "place") -> DataFrame:
    """Categories with their place, from 1, by where they first occur; the window holds one row per category."""
    from pyspark.sql import Window

    first = df.groupBy(category).agg(F.min(order).alias("_first"))
    return first.select(category, F.row_number().over(Window.orderBy("_first", category)).alias(out))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by a hash of their key: the same under any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def order_by_size(df: DataFrame, keys: Sequence[str], by_size: str) -> DataFrame:
    """Rows by keys, then by falling absolute value, NULLs last."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys], F.abs(by_size).desc_nulls_last())
