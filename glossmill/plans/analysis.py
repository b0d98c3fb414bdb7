"""Statistical error analysis: one labelled frame and the plans that branch off it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.ranges import quantiles, value_ranks
from glossmill.functions.stats import bootstrap_difference, error_metrics, kendall, mann_whitney, wilcoxon
from glossmill.functions.windows import benjamini_hochberg, keep_first, quantile_edges, right_closed_bin, top_k
from glossmill.operators.checks import DataError
from glossmill.operators.columns import is_numeric


def merge_predictions(features: DataFrame, predictions: DataFrame, key: str, how: str = "inner", validate: str | None = None) -> DataFrame:
    """Features with predictions by key. validate: '1:1', 'm:1', '1:m' checks uniqueness by aggregates; raises if it fails."""
    for side, df, unique in (("features", features, validate in ("1:1", "1:m")), ("predictions", predictions, validate in ("1:1", "m:1"))):
        if unique and not df.groupBy(key).count().filter("count > 1").isEmpty():
            raise DataError("keys repeat", side=side, key=key)
    return features.join(predictions.drop(*[c for c in predictions.columns if c in features.columns and c != key]), key, how)


def labelled(oof: DataFrame, items: DataFrame, bins: int = 5) -> DataFrame:
    """Error frame: deduplicated finite predictions with their record, signed, absolute and squared error, flags and difficulty bin."""
    once = keep_first(oof, ["row_id", "model_name"], [F.col("scored_at"), F.col("oof_prediction")])
    finite = once.filter("target IS NOT NULL AND oof_prediction IS NOT NULL AND NOT isnan(target) AND NOT isnan(oof_prediction)").select("row_id", "model_name", "cv_fold", F.col("target").alias("gold"), F.col("oof_prediction").alias("pred"))
    own = items.select("row_id", "item_id", F.coalesce("L1", F.lit("?")).alias("lang"), "split", "source", "L1_source_word", "en_target_word", "en_target_clue")
    e = F.col("pred") - F.col("gold")
    df = merge_predictions(finite, own, "row_id").withColumns({"signed_error": e, "abs_error": F.abs(e), "sq_error": e * e, "over": (e > 0).cast("int"), "under": (e < 0).cast("int")})
    edges = quantile_edges(df, "gold", bins)
    return df.crossJoin(F.broadcast(edges)).withColumn("bin_idx", right_closed_bin(F.col("gold"), F.col("edges"))).drop("edges")  # one row of edges


def metrics_by(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Error metrics per group, or over all rows, in one aggregate."""
    cols = error_metrics("gold", "pred")
    return df.groupBy(*groups).agg(*cols) if groups else df.agg(*cols)


def error_groups(df: DataFrame, strata: Sequence[str], low: float = 0.25, high: float = 0.75, least: int = 10) -> DataFrame:
    """Label low_error, middle and high_error by quantiles of the absolute error inside each stratum.

    Bounds are inclusive, the high label wins ties, strata under max(4, least) rows stay middle.
    """
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    q = quantiles(df, "abs_error", [low, high], strata).select(*strata, F.get("q", F.lit(0)).alias("_lo"), F.get("q", F.lit(1)).alias("_hi")).join(sizes, list(strata))
    label = F.when(F.col("_n") < max(4, least), "middle").when(F.col("abs_error") >= F.col("_hi"), "high_error").when(F.col("abs_error") <= F.col("_lo"), "low_error").otherwise("middle")
    return df.join(q, list(strata)).withColumn("error_group", label).drop("_lo", "_hi", "_n")


def long_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per record and feature: keep, feature, value."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select(*keep, "x.feature", "x.value")


def feature_diagnostics(df: DataFrame, features: Sequence[str], most_missing: float = 0.3) -> DataFrame:
    """feature, missing_rate, n_distinct, status (kept, missing, constant) from one aggregate."""
    wide = df.agg(*[F.struct(F.avg(F.col(f).isNull().cast("double")).alias("m"), F.countDistinct(f).alias("d")).alias(f) for f in features])
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f)["m"].alias("missing_rate"), F.col(f)["d"].alias("n_distinct")) for f in features])).alias("x")).select("x.*")
    return rows.withColumn("status", F.when(F.col("missing_rate") > most_missing, "missing").when(F.col("n_distinct") <= 1, "constant").otherwise("kept"))


def contrasts(df: DataFrame, features: Sequence[str], strata: Sequence[str], side: str, first: str, second: str) -> DataFrame:
    """Per stratum and feature: sizes, means, medians, U, p and Cliff's delta of two sides."""
    long = long_features(df.filter(F.col(side).isin(first, second)), features, [*strata, side])
    return mann_whitney(long, "value", side, [*strata, "feature"], first, second)


def associations(df: DataFrame, features: Sequence[str], strata: Sequence[str], against: Sequence[str] = ("abs_error", "signed_error", "gold"), least: int = 3) -> DataFrame:
    """Kendall's tau of every feature with each error column per stratum, missing rates, p-values adjusted inside the stratum.

    One row per stratum and feature: n, missing_rate, tau_<column>, p_<column>, and p_adjusted of the first column.
    Strata with fewer than `least` known values are left out; the missing rate is that of the whole stratum.
    """
    long = long_features(df, features, [*strata, *against])
    rates = long.groupBy(*strata, "feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))
    out = None
    for a in against:
        found = kendall(long, "value", a, [*strata, "feature"]).filter(F.col("n") >= least).withColumnsRenamed({"tau": f"tau_{a}", "p": f"p_{a}"})
        out = found if out is None else out.join(found.drop("n"), [*strata, "feature"], "left")
    out = out.join(rates, [*strata, "feature"])
    return benjamini_hochberg(out, f"p_{against[0]}", strata, "p_adjusted", ["feature"])


def matched_pair_details(pairs: DataFrame, df: DataFrame, features: Sequence[str], key: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
    """Matched pairs with each feature's values and difference, long: pair columns, feature, low_value, high_value, diff (low - high)."""
    side = lambda name: df.select(F.col(key).alias(f"{name}_key"), *keep, F.array(*[F.col(f).cast("double") for f in features]).alias(f"_{name}"))
    on = lambda name: [f"{name}_key", *keep]
    both = pairs.join(side("high"), on("high")).join(side("low"), on("low"))
    each = [F.struct(F.lit(f).alias("feature"), F.get("_low", F.lit(i)).alias("low_value"), F.get("_high", F.lit(i)).alias("high_value")) for i, f in enumerate(features)]
    return both.select(*pairs.columns, F.explode(F.array(*each)).alias("_x")).select(*pairs.columns, "_x.*").withColumn("diff", F.col("low_value") - F.col("high_value"))


def matched_pair_summary(details: DataFrame, groups: Sequence[str], least: int = 3, resamples: int = 200) -> DataFrame:
    """Per group and feature: n_pairs, mean and median difference with an interval of the mean, signed-rank sums, p, adjusted p; groups of fewer than `least` pairs are left out."""
    by = [*groups, "feature"]
    known = details.filter("diff IS NOT NULL")
    middle = quantiles(known, "diff", [0.5], by).select(*by, F.get("q", F.lit(0)).alias("median_diff"))
    base = known.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("diff").alias("mean_diff")).filter(F.col("n_pairs") >= least).join(middle, by)
    keyed = known.withColumn("_k", F.concat_ws("|", "high_key", "low_key"))
    out = base.join(bootstrap_difference(keyed, "_k", "diff", by, resamples=resamples), by, "left").join(wilcoxon(known, "diff", by).drop("n"), by, "left")
    return benjamini_hochberg(out, "p", groups, "p_adjusted", ["feature"])


def nearest_representatives(clustered: DataFrame, k: int = 3, key: str = "row_id") -> DataFrame:
    """The k rows of each cluster nearest to its centre."""
    return top_k(clustered, ["cluster"], [F.col("distance"), F.col(key)], k)


def run_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """name and rows of every result, one small aggregate each."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def interaction_ranges(tau: DataFrame, moderator: str, feature: str = "feature", least: int = 15, column: str = "tau") -> DataFrame:
    """Range of tau over a moderator's levels with `least` rows or more; needs two levels."""
    return tau.filter(F.col("n") >= least).groupBy(feature).agg(F.countDistinct(moderator).alias("levels"), (F.max(column) - F.min(column)).alias("tau_range")).filter("levels >= 2")


def extremes(df: DataFrame, strata: Sequence[str], k: int, key: str = "row_id") -> DataFrame:
    """Best and worst k records per stratum by absolute error, ties by key."""
    best = top_k(df, strata, [F.col("abs_error"), F.col(key), F.col("model_name")], k).withColumn("kind", F.lit("best"))
    return best.unionByName(top_k(df, strata, [F.col("abs_error").desc(), F.col(key), F.col("model_name")], k).withColumn("kind", F.lit("worst")))


def greedy_matches(df: DataFrame, exact: Sequence[str], numeric: Sequence[str], key: str = "row_id", farthest: float | None = None, least: int = 5) -> DataFrame:
    """Greedy one-to-one matching of high to low error records inside strata of equal `exact` values.

    Distance is the sum of differences over the stratum's deviations; highs go in key order, ties to the smaller
    key. The greedy order makes a stratum one sequential task; strata should be as fine as the exact columns allow.
    Returns exact, high_key, low_key, distance.
    """

    def one(key_values: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pdf.dropna(subset=list(numeric))
        hi, lo = kept[kept.error_group == "high_error"].sort_values(key), kept[kept.error_group == "low_error"].sort_values(key)
        out = []
        if len(hi) >= least and len(lo) >= least:
            sd = kept[list(numeric)].std(ddof=0).replace(0, 1).to_numpy()
            low, free, keys = lo[list(numeric)].to_numpy() / sd, np.ones(len(lo), bool), lo[key].to_numpy()
            for k, x in zip(hi[key], hi[list(numeric)].to_numpy() / sd):
                if not free.any():
                    break
                d = np.where(free, np.abs(low - x).sum(axis=1), np.inf)
                at = int(d.argmin())
                if farthest is None or d[at] <= farthest:
                    free[at] = False
                    out.append((*key_values, int(k), int(keys[at]), float(d[at])))
        return pd.DataFrame(out, columns=[*exact, "high_key", "low_key", "distance"])

    need = df.filter("error_group IN ('high_error', 'low_error')").select(*exact, key, "error_group", *[F.col(n).cast("double").alias(n) for n in numeric])
    types = ", ".join(f"{c} {t}" for c, t in need.dtypes if c in exact)
    return need.groupBy(*exact).applyInPandas(one, f"{types}, high_key bigint, low_key bigint, distance double")


def ecdf(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Cumulative share of rows up to each distinct value of a group: groups, value, n, cdf."""
    return value_ranks(df, value, groups).select(*groups, value, "n", ((F.col("before") + F.col("n")) / F.col("total")).alias("cdf"))


def heatmap(df: DataFrame, rows: str, column: str, values: Sequence, cell: Column) -> DataFrame:
    """Pivot with the given column values; empty cells are 0."""
    return df.groupBy(rows).pivot(column, list(values)).agg(cell).na.fill(0)


def prompt(text: Sequence[str], numbers: Sequence[str], separator: str = " [SEP] ", kinds: Mapping[str, str] | None = None, digits: int = 4) -> Column:
    """TEXT: a [SEP] b [SEP] FEATURES: x=0.1234 | y=3 | z=true: record to prompt.

    kinds: per feature float (default), int (half-even), bool (strings count too) or str; missing values are NA.
    """
    def shown(c: str) -> Column:
        kind = (kinds or {}).get(c, "float")
        if kind == "float":
            return F.format_string(f"%.{digits}f", F.col(c).try_cast("double"))
        if kind == "int":
            return F.bround(F.col(c).try_cast("double"), 0).cast("bigint").cast("string")
        if kind == "bool":
            v = F.lower(F.trim(F.col(c).cast("string")))
            return F.when(v.isin("true", "1", "1.0", "yes"), "true").when(v.isin("false", "0", "0.0", "no"), "false")
        return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))

    body = F.concat_ws(separator, *[F.coalesce(F.col(c), F.lit("")) for c in text])
    pairs = F.concat_ws(" | ", *[F.concat(F.lit(f"{n}="), F.coalesce(shown(n), F.lit("NA"))) for n in numbers])
    return F.concat(F.lit("TEXT: "), body, F.lit(f"{separator}FEATURES: "), pairs)


def prompt_kinds(df: DataFrame, features: Sequence[str]) -> dict[str, str]:
    """Kind of each feature for prompts: bool where all values are 0 or 1, int, float or str by type; one aggregate."""
    types = dict(df.dtypes)
    numbers = [f for f in features if is_numeric(types[f])]
    row = df.agg(F.lit(1).alias("_"), *[F.bool_and(F.col(f).isNull() | F.col(f).isin(0, 1)).alias(f) for f in numbers]).first()
    whole = ("tinyint", "smallint", "int", "bigint")
    return {f: "bool" if types[f] == "boolean" or f in numbers and row[f] else "int" if types[f] in whole else "float" if f in numbers else "str" for f in features}
