"""Reading split tables: which splits must be there, the cleaning steps in order, and their diagnostics and sidecars."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import consistent, strip
from glossmill.functions.windows import keep_first
from glossmill.operators.checks import ConfigError, DataError, require_columns
from glossmill.operators.columns import cast_columns, keep_only
from glossmill.operators.concepts import lookup_key
from glossmill.sources.files import EDGE_COLUMNS, read_table

SPLITS = ("train", "dev", "test")


def splits_to_load(paths: Mapping[str, str], required: Sequence[str] = ("train", "dev"), wanted: Sequence[str] | None = None) -> list[str]:
    """Splits with a path, in order; a required one without a path raises, an optional one is skipped."""
    unknown = [s for s in (*paths, *(wanted or ())) if s not in SPLITS]
    if unknown:
        raise ConfigError("unknown splits", splits=unknown)
    missing = [s for s in required if not paths.get(s) and (wanted is None or s in wanted)]
    if missing:
        raise ConfigError("required splits have no path", splits=missing)
    return [s for s in SPLITS if paths.get(s) and (wanted is None or s in wanted)]


def clean_split(df: DataFrame, text: Sequence[str], types: Mapping[str, str] | None = None, nullable: Sequence[str] = (), only: tuple[str, str] | None = None, unique: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Consistent trimmed text, casts, one value of a column kept, first row of each key: the filter comes first, so that text work meets only rows that stay."""
    require_columns(df, text)
    out = keep_only(df, *only) if only else df
    out = out.withColumns({c: strip(consistent(F.col(c))) for c in text})
    out = cast_columns(out, types or {}, nullable)
    if unique:
        out = keep_first(out, [c for c in unique if c in out.columns], [F.col(order) if order else F.struct(*[F.col(c).cast("string") for c in out.columns])])
    return out


def load_splits(spark: SparkSession, paths: Mapping[str, str], text: Sequence[str], required: Sequence[str] = ("train", "dev"), **steps: object) -> dict[str, DataFrame]:
    """Every split that is there, read by suffix and cleaned."""
    return {s: clean_split(read_table(spark, paths[s]), text, **steps) for s in splits_to_load(paths, required)}


def split_diagnostics(df: DataFrame, key: str, l1: str, target: str) -> DataFrame:
    """One row about a split: n_rows, n_columns, n_ids, languages (sorted), n_target_null, missing (a rate per column); one aggregate."""
    rates = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.avg(F.col(c).isNull().cast("double")))])
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.countDistinct(key).alias("n_ids"), F.array_sort(F.collect_set(l1)).alias("languages"), F.count_if(F.col(target).isNull()).alias("n_target_null"), rates.alias("missing"))


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge subset from CSV or Parquet: required columns checked, languages lower-case, *_norm columns derived where they are absent."""
    df = read_table(spark, path)
    require_columns(df, EDGE_COLUMNS)
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in EDGE_COLUMNS}).withColumns({c: F.lower(F.trim(c)) for c in ("lang_1", "lang_2")})
    return out.withColumns({f"{c}_norm": lookup_key(F.col(c)) for c in EDGE_COLUMNS if c.startswith(("word", "translit")) and f"{c}_norm" not in df.columns})


def write_sidecars(spark: SparkSession, folder: str, diagnostics: Mapping[str, Mapping], manifest: Mapping) -> None:
    """Diagnostics of each split and the build's manifest as JSON text beside the tables."""
    for name, body in {**{f"{s}_diagnostics": d for s, d in diagnostics.items()}, "manifest": manifest}.items():
        spark.createDataFrame([(json.dumps(body, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def processed_splits(spark: SparkSession, folder: str, names: Sequence[str] = ("train", "dev")) -> tuple[dict[str, DataFrame], list[str]]:
    """Feature tables with the catalog of each: every catalogued column must exist, and training's must be in the others. Returns the tables and training's columns."""
    tables, columns = {}, {}
    for s in names:
        tables[s] = spark.read.parquet(f"{folder}/{s}")
        columns[s] = json.loads(spark.read.text(f"{folder}/{s}_diagnostics").first().value)["feature_columns"]
        require_columns(tables[s], columns[s])
    for s in names[1:]:
        lacking = [c for c in columns[names[0]] if c not in columns[s]]
        if lacking:
            raise DataError("training features are missing", split=s, missing=lacking)
    return tables, columns[names[0]]


def extend_catalog(columns: Sequence[str], new: Sequence[str]) -> list[str]:
    """Catalog with new columns behind it, once each; numbered ones in the order of their numbers."""
    number = lambda c: (c.rstrip("0123456789"), int(c[len(c.rstrip("0123456789")) :] or -1))
    return list(dict.fromkeys([*columns, *sorted(new, key=number)]))
