"""Choosing and ranking features: families, groups, selection with reasons, and association with a target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.ranges import quantiles
from glossmill.functions.stats import kendall, normal_sf2, pearson
from glossmill.functions.windows import average_ranks
from glossmill.operators.checks import DataError
from glossmill.operators.columns import is_numeric
from glossmill.plans.analysis import long_features

# Prefixes and names of feature families, in order of precedence.
FAMILIES = [
    ("semantic", ("semantic_",), ()), ("retrieval", ("retrieval_",), ()), ("surprisal", ("surprisal_",), ()), ("mlm", ("mlm_",), ()),
    ("cognate", ("cognet_", "cognate_"), ("weighted_levenshtein_sim",)), ("frequency", ("kelly_", "wf_", "subtlex_", "freq_"), ()),
    ("lexical", ("target_", "source_", "clue_"), ("shared_char_ratio", "syllables", "pos_encoded")),
]
# Members of feature groups, then what a name must contain, both in order of precedence.
GROUP_MEMBERS = {
    "frequency": ("kelly_rank", "kelly_rank_percentile", "kelly_points", "kelly_cefr", "kelly_cefr_num", "subtlex_wf", "subtlex_lg10wf", "subtlex_cd", "subtlex_lg10cd", "subtlex_zipf", "wf_value", "wf_zipf", "wf_cost", "wf_percentile", "wf_found"),
    "lexical_surface": ("target_len", "source_len", "clue_len", "clue_ratio", "pos_encoded", "syllables", "target_vowel_ratio", "target_consonant_ratio", "shared_char_ratio", "baseline_clue_overlap", "clue_hidden_chars", "en_target_lemma"),
    "retrieval_baseline": ("retrieval_target_prior", "retrieval_target_in_context", "retrieval_target_in_clue", "retrieval_candidate_count", "baseline_pred_len", "baseline_pred_matches_target"),
    "mlm_surprisal": ("mlm_log_prob", "mlm_rank", "mlm_entropy", "surprisal_masked", "surprisal_pll", "surprisal_subword_mean", "surprisal_subword_sum", "target_log_prob", "is_top_1", "target_rank", "prediction_entropy"),
    "cognate": ("weighted_levenshtein_sim", "cognate_sim", "L1_source_word_has_alternative", "L1_source_word_has_excluded_word", "cognet_source_alternative_english_count"),
    "semantic": ("semantic_usas_entropy_unweighted", "semantic_usas_entropy_weighted", "semantic_usas_domain_match", "semantic_semantic_shift"),
}
GROUP_PARTS = {
    "frequency": ("kelly", "subtlex", "wf_", "zipf", "freq", "frequency"),
    "lexical_surface": ("len", "syll", "vowel", "consonant", "char", "lemma", "pos", "clue"),
    "retrieval_baseline": ("retrieval", "baseline_"),
    "mlm_surprisal": ("mlm", "surprisal", "log_prob", "entropy", "rank", "top_1"),
    "cognate": ("cognate", "levenshtein", "cognet", "alternative", "excluded_word"),
    "semantic": ("semantic", "usas", "domain_match", "shift"),
}


def family(feature: Column) -> Column:
    """Feature family of a name."""
    out = F.lit("other")
    for name, prefixes, names in reversed(FAMILIES):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith(feature, F.lit(p))
        out = F.when(hit | feature.isin(*names) if names else hit, name).otherwise(out)
    return out


def group(feature: Column) -> Column:
    """Feature group of a name: by membership, else by the first group a part of whose names it contains."""
    out = F.lit("other")
    for name, parts in reversed(GROUP_PARTS.items()):
        out = F.when(F.lower(feature).rlike("|".join(parts)), name).otherwise(out)
    for name, members in reversed(GROUP_MEMBERS.items()):
        out = F.when(feature.isin(*members), name).otherwise(out)
    return out


def select_features(df: DataFrame, mode: str = "explicit", features: Sequence[str] = (), families: Mapping[str, Sequence[str]] | None = None, exclude: Sequence[str] = (), most_missing: float = 0.3, drop_constant: bool = True) -> DataFrame:
    """Diagnostics of the analysis features: feature, is_numeric, missing_rate, n_unique, kept, drop_reason, family.

    mode: explicit (the list), families (all features of the families), infer_numeric (every numeric column). Columns
    that are absent or excluded are left out. Reasons: non_numeric, high_missingness, constant. NaN counts as missing.
    One aggregate for all columns; kept ones come first.
    """
    types = dict(df.dtypes)
    chosen = {"explicit": list(features), "families": [f for fs in (families or {}).values() for f in fs], "infer_numeric": [c for c in df.columns if is_numeric(types[c])]}
    if mode not in chosen:
        raise DataError("unknown selection mode", mode=mode)
    names = [c for c in dict.fromkeys(chosen[mode]) if c in df.columns and c not in exclude]
    value = lambda c: F.when(~F.isnan(c), F.col(c)) if types[c] in ("double", "float") else F.col(c)
    wide = df.agg(*[F.struct(F.coalesce(F.avg(value(c).isNull().cast("double")), F.lit(0.0)).alias("m"), F.countDistinct(value(c)).alias("d")).alias(f"_{i}") for i, c in enumerate(names)]) if names else df.sparkSession.range(1)
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(is_numeric(types[c])).alias("is_numeric"), F.col(f"_{i}")["m"].alias("missing_rate"), F.col(f"_{i}")["d"].alias("n_unique")) for i, c in enumerate(names)]
    empty = F.array().cast("array<struct<feature:string,is_numeric:boolean,missing_rate:double,n_unique:bigint>>")
    long = wide.select(F.explode(F.array(*rows) if rows else empty).alias("x")).select("x.*")
    reason = F.when(~F.col("is_numeric"), "non_numeric").when(F.col("missing_rate") > most_missing, "high_missingness").when(F.lit(drop_constant) & (F.col("n_unique") <= 1), "constant")
    named = F.create_map(*[F.lit(x) for fam, fs in families.items() for f in fs for x in (f, fam)]) if families else None
    kin = family(F.col("feature")) if named is None else F.coalesce(F.try_element_at(named, F.col("feature")), family(F.col("feature")))
    return long.withColumn("drop_reason", reason).withColumn("kept", F.col("drop_reason").isNull()).withColumn("family", kin).orderBy(F.desc("kept"), "family", "feature")


def t_sf2(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by the normal limit of its t value (Fisher's z for the small numbers t would need tables for)."""
    return F.when((n > 3) & (F.abs(r) < 1), normal_sf2(F.atanh(r) * F.sqrt(n - 3))).when(F.abs(r) >= 1, 0.0)


def target_ranking(df: DataFrame, features: Sequence[str], target: str, dataset: str = "train") -> DataFrame:
    """Features by their association with a target: three coefficients with p, their absolute values, ranks and the feature group.

    Pairs with a missing side don't count; features with fewer than two values, or of which every coefficient is
    unknown, are left out. Ranks go by falling absolute value, the best of ties; the last window holds one row per feature.
    """
    known = [f for f in features if f in df.columns and f != target]
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    base = df.select(*[number(f).alias(f) for f in known], number(target).alias("_y"))
    long = long_features(base, known, ["_y"]).filter("value IS NOT NULL AND _y IS NOT NULL")
    ranked = average_ranks(average_ranks(long, "value", ["feature"], "_a"), "_y", ["feature"], "_b")
    linear = ranked.groupBy("feature").agg(F.count("*").alias("n_valid"), pearson("value", "_y").alias("pearson_r"), pearson("_a", "_b").alias("spearman_rho"))
    tau = kendall(long, "value", "_y", ["feature"]).select("feature", F.col("tau").alias("kendall_tau"), F.col("p").alias("kendall_p"))
    out = linear.join(tau, "feature", "left").filter("n_valid >= 2 AND coalesce(pearson_r, spearman_rho, kendall_tau) IS NOT NULL")
    out = out.withColumns({"pearson_p": t_sf2(F.col("pearson_r"), F.col("n_valid")), "spearman_p": t_sf2(F.col("spearman_rho"), F.col("n_valid"))})
    out = out.withColumns({"abs_pearson_r": F.abs("pearson_r"), "abs_spearman_rho": F.abs("spearman_rho"), "abs_kendall_tau": F.abs("kendall_tau")})
    place = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(Window.orderBy(F.col(c).desc_nulls_last())))
    out = out.withColumns({"rank_by_abs_pearson": place("abs_pearson_r"), "rank_by_abs_spearman": place("abs_spearman_rho"), "rank_by_abs_kendall": place("abs_kendall_tau")})
    return out.select(F.col("feature").alias("feature_name"), group(F.col("feature")).alias("feature_group"), F.lit(dataset).alias("dataset_name"), F.lit(target).alias("target_column"), *[c for c in out.columns if c != "feature"])


def family_summary(associations: DataFrame, groups: Sequence[str] = (), tau: str = "tau") -> DataFrame:
    """Number, mean and median absolute tau of each family (and group)."""
    own = associations.withColumn("family", family(F.col("feature"))).withColumn("_t", F.abs(tau))
    middle = quantiles(own, "_t", [0.5], [*groups, "family"]).select(*groups, "family", F.get("q", F.lit(0)).alias("median_abs_tau"))
    return own.groupBy(*groups, "family").agg(F.count("*").alias("n_features"), F.avg("_t").alias("mean_abs_tau")).join(middle, [*groups, "family"], "left")
