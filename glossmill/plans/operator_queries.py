"""Queries of ingest, selection, tagging, encoding and stacking operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.features.frequency import TAGS, TAG_CODES, tag_columns
from glossmill.features.lexical import lexical_columns
from glossmill.features.retrieval import semantic_columns
from glossmill.features.tags import coarse_domain, template_text
from glossmill.functions.stats import pearson, with_tau
from glossmill.functions.windows import keep_first
from glossmill.ml import models, pipeline
from glossmill.operators import columns
from glossmill.plans import analysis, selection
from glossmill.plans.core_queries import rounded
from glossmill.plans.reference_queries import _KEY, _LONG, EP, FEATURES, ep
from glossmill.sources.ingest import split_diagnostics
from glossmill.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _case(values: dict, key: str) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in values.items())


# --- ingest ------------------------------------------------------------------------------------------------------
@query("SELECT row_id, TRY_CAST(en_target_clue AS DOUBLE) AS en_target_clue, TRY_CAST(GLMM_score AS VARCHAR) IS NOT NULL AS has_score, TRY_CAST(L1 AS INTEGER) AS L1 FROM items")
def cast_map(spark: SparkSession, folder: str) -> DataFrame:
    """Casts of a column map; what doesn't fit is NULL."""
    df = columns.cast_columns(table(spark, folder, "items"), {"en_target_clue": "double", "L1": "int", "row_id": "bigint"}, ["L1"])
    return df.select("row_id", "en_target_clue", F.col("GLMM_score").isNotNull().alias("has_score"), "L1")


@query("SELECT split, count(*) AS n, count(DISTINCT en_target_word) AS n_words FROM items WHERE L1 = 'es' GROUP BY split")
def keep_one_l1(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one L1 per split."""
    return columns.keep_only(table(spark, folder, "items"), "L1", "es").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("en_target_word").alias("n_words"))


@query("SELECT row_id, coalesce(source, 'nobody') AS source, coalesce(en_target_pos, 'X') AS en_target_pos, 0 AS n_tags FROM items")
def filled_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Missing values and missing columns as constants."""
    return columns.fill_or_create(table(spark, folder, "items"), {"source": "nobody", "en_target_pos": "X", "n_tags": 0}).select("row_id", "source", "en_target_pos", "n_tags")


@query("SELECT column_name, round(avg(CASE WHEN trim(coalesce(v, ''), ' ') <> '' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT unnest(['L1','en_target_pos','en_target_clue','L1_source_word']) AS column_name, unnest([L1, en_target_pos, en_target_clue, L1_source_word]) AS v FROM items) GROUP BY column_name")
def non_empty(spark: SparkSession, folder: str) -> DataFrame:
    """Share of rows with text per column."""
    return rounded(columns.non_empty_rates(table(spark, folder, "items"), ["L1", "en_target_pos", "en_target_clue", "L1_source_word"]))


@query("SELECT source, row_number() OVER (ORDER BY f, source)::INT AS place FROM (SELECT source, min(row_id) AS f FROM items GROUP BY source)")
def source_order(spark: SparkSession, folder: str) -> DataFrame:
    """Contributors by their first record."""
    return columns.first_seen(table(spark, folder, "items"), "source", "row_id")


@query("SELECT count(*) AS n_rows, 12 AS n_columns, count(DISTINCT item_id) AS n_ids, array_to_string(list_sort(list(DISTINCT L1) FILTER (L1 IS NOT NULL)), ',') AS languages, count(*) FILTER (GLMM_score IS NULL) AS n_target_null, round(avg(CAST(item_id IS NULL AS DOUBLE)), 6) AS item_missing FROM items WHERE split = 'train'")
def train_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Diagnostics of the training split from one aggregate."""
    d = split_diagnostics(table(spark, folder, "items").filter("split = 'train'").drop("authored_at", "loaded_at"), "item_id", "L1", "GLMM_score")
    return d.select("n_rows", "n_columns", "n_ids", F.array_join("languages", ",").alias("languages"), "n_target_null", F.round(F.col("missing")["item_id"], 6).alias("item_missing"))


@query("SELECT row_id, trim(lower(coalesce(L1_context, '')), ' ') || chr(10) || trim(coalesce(en_target_word, ''), ' ') AS text FROM (SELECT row_id, lower(L1_context) AS L1_context, en_target_word FROM items)")
def joined_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text columns joined by line breaks."""
    df = table(spark, folder, "items").withColumn("L1_context", F.lower("L1_context"))
    return df.select("row_id", columns.join_text(["L1_context", "en_target_word"], "newline").alias("text"))


# --- features ----------------------------------------------------------------------------------------------------
@query(f"""
WITH k AS (SELECT row_id, {_KEY.format(c='en_target_pos')} AS t FROM items), n AS (SELECT row_id, CASE WHEN {_case(TAGS, 't')} END IS NOT NULL THEN {_case(TAGS, 't')} END ELSE upper(t) END AS target_pos_norm FROM k)
SELECT row_id, target_pos_norm, coalesce({_case(TAG_CODES, 'target_pos_norm')} END, 0) AS target_pos_code, CAST(target_pos_norm <> '' AS INT) AS target_pos_known, '' AS source_pos_norm, 0 AS source_pos_code, 0 AS source_pos_known, 0 AS source_target_pos_match FROM n
""")
def pos_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Tags and codes of every record; without a tagger the source side is unknown."""
    return tag_columns(table(spark, folder, "items")).select("row_id", *[f"{s}_pos_{k}" for s in ("target", "source") for k in ("norm", "code", "known")], "source_target_pos_match")


@query(f"""
WITH k AS (SELECT row_id, {_KEY.format(c='en_target_word')} AS t, {_KEY.format(c='L1_source_word')} AS s, coalesce(en_target_clue, '') AS c FROM items), n AS (SELECT *, len(regexp_extract_all(t, '[a-z]')) AS letters FROM k)
SELECT row_id, CAST(length(t) >= 3 AND contains(s, substr(t, 1, 3)) AS INT) AS target_prefix_in_source, CAST(length(t) >= 3 AND contains(s, right(t, 3)) AS INT) AS target_suffix_in_source, CAST(regexp_matches(c, '^[\\p{{L}}\\p{{N}}]') AS INT) AS clue_reveals_first_char,
 round(CASE WHEN letters = 0 THEN 0 ELSE len(regexp_extract_all(t, '[b-df-hj-np-tv-z]')) / letters END, 6) AS target_consonant_ratio FROM n
""")
def lex_affixes(spark: SparkSession, folder: str) -> DataFrame:
    """Shared beginnings and endings, and consonants."""
    cols = lexical_columns(F.col("en_target_word"), F.col("L1_source_word"), F.col("en_target_clue"))
    return rounded(table(spark, folder, "items").select("row_id", *[cols[n].alias(n) for n in ("target_prefix_in_source", "target_suffix_in_source", "clue_reveals_first_char", "target_consonant_ratio")]))


@query("""
WITH d AS (SELECT row_id, list_filter([lower(coalesce(L1, '')), lower(split)], lambda x: trim(x, ' ') <> '') AS s, list_filter([lower(split), lower(coalesce(en_target_pos, ''))], lambda x: trim(x, ' ') <> '') AS t, (row_id % 5)::DOUBLE AS w FROM items),
e AS (SELECT *, CASE WHEN len(s) > 1 THEN [w, 1.0] WHEN len(s) = 1 THEN [w] ELSE [] END || CASE WHEN len(t) > 1 THEN [2.0, 1.0] WHEN len(t) = 1 THEN [2.0] ELSE [] END AS ws FROM d),
f AS (SELECT *, list_sum(ws) AS m, list_transform(s, lambda x: trim(x, ' ')) AS ts, list_transform(t, lambda x: trim(x, ' ')) AS tt FROM e)
SELECT row_id, round(len(list_intersect(list_distinct(ts), list_distinct(tt))) / len(list_distinct(ts || tt)), 6) AS semantic_usas_domain_match, round(ln(len(s) + len(t)), 6) AS semantic_usas_entropy_unweighted, round(-list_sum(list_transform(ws, lambda x: CASE WHEN x > 0 THEN x / m * ln(x / m) ELSE 0 END)), 6) AS semantic_usas_entropy_weighted FROM f
""")
def semantic_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domain match and entropies of domain lists with scores, on lists made of a record's L1, split and tag."""
    df = table(spark, folder, "items").select("row_id", F.concat_ws(";", F.coalesce("L1", F.lit("")), "split").alias("s"), F.concat_ws("|", "split", F.coalesce("en_target_pos", F.lit(""))).alias("t"), F.concat((F.col("row_id") % 5).cast("string"), F.lit("; none")).alias("ss"), F.lit("2").alias("ts"))
    cols = semantic_columns(F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.col("s"), F.col("t"), F.col("ss"), F.col("ts"))
    return rounded(df.select("row_id", *[cols[n].alias(n) for n in ("semantic_usas_domain_match", "semantic_usas_entropy_unweighted", "semantic_usas_entropy_weighted")]))


@query("SELECT word, cefr, CASE WHEN regexp_extract(lower(trim(coalesce(cefr,''),' ')), '^([a-z]+)', 1) <> '' THEN regexp_extract(lower(trim(coalesce(cefr,''),' ')), '^([a-z]+)', 1) ELSE substr(lower(trim(coalesce(cefr,''),' ')), 1, 1) END AS domain FROM lexicon")
def coarse_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Leading letters of tags."""
    return table(spark, folder, "lexicon").select("word", "cefr", coarse_domain(F.col("cefr")).alias("domain"))


@query("""
SELECT row_id, CASE WHEN trim(coalesce(en_target_clue,''),' ') <> '' THEN trim(coalesce(en_target_clue,''),' ') || ' ' || w WHEN L1 = 'es' THEN 'Esto es ' || w || '.' WHEN L1 = 'de' THEN 'Das ist ' || w || '.' ELSE w END AS text
FROM (SELECT *, trim(coalesce(en_target_word,''),' ') AS w FROM items)
""")
def template_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Words in a small context for tagging."""
    return table(spark, folder, "items").select("row_id", template_text(F.col("en_target_word"), F.col("en_target_clue"), F.col("L1")).alias("text"))


# --- selection and association -----------------------------------------------------------------------------------
def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return ep(spark, folder).withColumns({"flat": F.lit(1), "target_rare": F.when(F.col("gold") > 1, F.col("gold"))})


_CHOSEN = ["target_len", "clue_len", "item_id", "flat", "target_rare", "en_target_word", "absent"]


@query(EP + """, c AS (SELECT unnest(['target_len','clue_len','item_id','flat','target_rare','en_target_word']) AS feature, unnest([true,true,true,true,true,false]) AS is_numeric,
 unnest([target_len::VARCHAR, clue_len::VARCHAR, item_id::VARCHAR, '1', CASE WHEN gold > 1 THEN gold::VARCHAR END, en_target_word]) AS v FROM ep),
s AS (SELECT feature, is_numeric, avg(CAST(v IS NULL AS DOUBLE)) AS m, count(DISTINCT v) AS d FROM c GROUP BY ALL)
SELECT feature, is_numeric, round(m, 6) AS missing_rate, d AS n_unique, CASE WHEN NOT is_numeric THEN 'non_numeric' WHEN m > 0.3 THEN 'high_missingness' WHEN d <= 1 THEN 'constant' END AS drop_reason, is_numeric AND m <= 0.3 AND d > 1 AS kept,
 CASE WHEN feature LIKE 'target%' OR feature LIKE 'clue%' THEN 'lexical' ELSE 'other' END AS family FROM s
""")
def feature_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Analysis features from a list, with why others are dropped."""
    return rounded(selection.select_features(_candidates(spark, folder), "explicit", _CHOSEN))


@query(EP + "SELECT count(*) FILTER (kept) AS n_kept, count(*) AS n_all FROM (SELECT unnest([count(DISTINCT cv_fold) > 1, count(DISTINCT gold) > 1, count(DISTINCT pred) > 1, avg(CAST(item_id IS NULL AS DOUBLE)) <= 0.3, count(DISTINCT bin_idx) > 1, count(DISTINCT target_len) > 1, count(DISTINCT source_len) > 1, count(DISTINCT clue_len) > 1, avg(CAST(gold > 1 AS DOUBLE)) >= 0.7, false]) AS kept FROM ep)")
def inferred_features(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the numeric columns may serve."""
    found = selection.select_features(_candidates(spark, folder), "infer_numeric", exclude=["row_id", "signed_error", "abs_error", "sq_error", "over", "under"])
    return found.agg(F.count_if("kept").alias("n_kept"), F.count("*").alias("n_all"))


@query(EP + """, l AS (SELECT row_number() OVER () AS k, gold AS y, unnest(['target_len','source_len','clue_len']) AS feature, unnest([target_len, source_len, clue_len]) AS x FROM ep),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS b FROM l),
c AS (SELECT feature, count(*) AS n, corr(x, y) AS p, corr(a, b) AS s FROM r GROUP BY feature),
t AS (SELECT i.feature, sum(sign(i.x - j.x) * sign(i.y - j.y)) / sqrt(count(*) FILTER (i.x <> j.x) * 1.0 * count(*) FILTER (i.y <> j.y)) AS t FROM l i JOIN l j ON i.feature = j.feature AND i.k < j.k GROUP BY i.feature)
SELECT feature AS feature_name, 'lexical_surface' AS feature_group, 'train' AS dataset_name, 'gold' AS target_column, n AS n_valid, round(p, 6) AS pearson_r, round(s, 6) AS spearman_rho, round(t, 6) AS kendall_tau, round(abs(p), 6) AS abs_pearson_r, round(abs(s), 6) AS abs_spearman_rho, round(abs(t), 6) AS abs_kendall_tau,
 rank() OVER (ORDER BY abs(p) DESC)::INT AS rank_by_abs_pearson, rank() OVER (ORDER BY abs(s) DESC)::INT AS rank_by_abs_spearman, rank() OVER (ORDER BY abs(t) DESC)::INT AS rank_by_abs_kendall FROM c JOIN t USING (feature)
""")
def feature_target_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Features by their association with the gold score."""
    return rounded(selection.target_ranking(ep(spark, folder), FEATURES, "gold").drop("pearson_p", "spearman_p", "kendall_p"))


_TAU = "round(sum(sign(i.{x} - j.{x}) * sign(i.{y} - j.{y})) / nullif(sqrt(count(*) FILTER (i.{x} <> j.{x}) * 1.0 * count(*) FILTER (i.{y} <> j.{y})), 0), 6)"


@query(EP + f", k AS (SELECT row_number() OVER () AS k, lang, gold, pred, abs_error FROM ep), t AS (SELECT i.lang, {_TAU.format(x='gold', y='pred')} AS tau FROM k i JOIN k j ON i.lang = j.lang AND i.k < j.k GROUP BY i.lang), n AS (SELECT lang, count(*) AS n, round(avg(abs_error), 6) AS mae FROM k GROUP BY lang) SELECT n.lang, n, mae, CASE WHEN n >= 3 THEN tau END AS tau FROM n LEFT JOIN t USING (lang)")
def metrics_with_tau(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics per language with Kendall's tau of gold and prediction."""
    df = ep(spark, folder)
    return rounded(with_tau(analysis.metrics_by(df, ["lang"]), df, "gold", "pred", ["lang"]).select("lang", "n", "mae", "tau"))


@query(EP + _LONG + f""", k AS (SELECT *, row_number() OVER () AS k FROM l),
t AS (SELECT i.model_name, i.feature, {_TAU.format(x='value', y='abs_error')} AS tau_abs_error, {_TAU.format(x='value', y='signed_error')} AS tau_signed_error, {_TAU.format(x='value', y='gold')} AS tau_gold FROM k i JOIN k j ON i.model_name = j.model_name AND i.feature = j.feature AND i.k < j.k GROUP BY ALL)
SELECT t.*, n, 0.0::DOUBLE AS missing_rate FROM t JOIN (SELECT model_name, feature, count(*) AS n FROM k GROUP BY ALL) USING (model_name, feature)
""")
def association_taus(spark: SparkSession, folder: str) -> DataFrame:
    """Kendall's tau of features with absolute error, signed error and gold per model."""
    found = analysis.associations(ep(spark, folder), FEATURES, ["model_name"])
    return rounded(found.select("model_name", "feature", "tau_abs_error", "tau_signed_error", "tau_gold", "n", "missing_rate"))


@query()
def family_associations(spark: SparkSession, folder: str) -> DataFrame:
    """Association strength per feature family and model."""
    return rounded(selection.family_summary(analysis.associations(ep(spark, folder), FEATURES, ["model_name"]), ["model_name"], "tau_abs_error"))


@query()
def interaction_probe(spark: SparkSession, folder: str) -> DataFrame:
    """How much features' association with the error differs between languages."""
    return rounded(analysis.interaction_ranges(analysis.associations(ep(spark, folder), FEATURES, ["lang"]), "lang", column="tau_abs_error"))


@query()
def matched_pair_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Feature differences of matched low- and high-error records per model."""
    df = analysis.error_groups(ep(spark, folder), ["model_name"])
    pairs = analysis.greedy_matches(df, ["lang", "model_name", "bin_idx"], FEATURES)
    details = analysis.matched_pair_details(pairs, df, ["gold", "pred", *FEATURES], keep=["model_name"])
    return rounded(analysis.matched_pair_summary(details, ["model_name"]))


# --- encoding, folds, stacking -----------------------------------------------------------------------------------
@query("""
WITH t AS (SELECT * FROM items WHERE split = 'train'), m AS (SELECT quantile_cont(CASE WHEN isnan(GLMM_score) THEN NULL ELSE GLMM_score END, 0.5) AS q FROM t), p AS (SELECT en_target_pos AS v FROM t WHERE en_target_pos IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
SELECT row_id, round(coalesce(CASE WHEN isnan(GLMM_score) THEN NULL ELSE GLMM_score END, q), 6) AS GLMM_score, coalesce(en_target_pos, v) AS en_target_pos, coalesce(item_id, 0) AS item_id FROM items, m, p
""")
def imputed(spark: SparkSession, folder: str) -> DataFrame:
    """Median, mode and constant fills learned on the training split."""
    items = table(spark, folder, "items")
    fill = pipeline.impute(items.filter("split = 'train'"), {"GLMM_score": "median", "en_target_pos": "mode", "item_id": "constant"})
    return rounded(fill(items).select("row_id", "GLMM_score", "en_target_pos", "item_id"))


@query("SELECT row_id, CAST(split = 'dev' AS DOUBLE) AS split_dev, CAST(split = 'test' AS DOUBLE) AS split_test, CAST(split = 'train' AS DOUBLE) AS split_train, CAST(NOT EXISTS (SELECT 1 FROM items t WHERE t.split = 'train' AND t.source = items.source) AS INT) AS unknown_source FROM items WHERE split IN ('train','dev','test')")
def onehot(spark: SparkSession, folder: str) -> DataFrame:
    """Dummies of the split, and whether all dummies of the contributor, learned on training rows, are 0."""
    items = table(spark, folder, "items").filter("split IN ('train','dev','test')").select("row_id", "split", "source")
    wide = pipeline.one_hot(items, ["split"])(items)
    known = pipeline.one_hot(items.filter("split = 'train'"), ["source"])(wide)
    names = [c for c in known.columns if c.startswith("source_")]
    return known.select("row_id", "split_dev", "split_test", "split_train", (sum((F.col(f"`{c}`") for c in names), F.lit(0.0)) == 0).cast("int").alias("unknown_source"))


@query(EP + """, d AS (SELECT row_id, model_name, (target_len - avg(target_len) OVER ()) / stddev_pop(target_len) OVER () AS a, (clue_len - avg(clue_len) OVER ()) / stddev_pop(clue_len) OVER () AS b, split FROM ep)
SELECT row_id, model_name, round(a, 6) AS target_len, round(b, 6) AS clue_len, CAST(split = 'dev' AS DOUBLE) AS split_dev, CAST(split = 'train' AS DOUBLE) AS split_train, round(a * (split = 'dev')::INT, 6) + 0.0 AS target_len__x__split_dev, round(a * (split = 'train')::INT, 6) + 0.0 AS target_len__x__split_train, round(a * b, 6) + 0.0 AS target_len__x__clue_len FROM d
""")
def design_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Regression columns with dummies and interactions; constant ones are gone."""
    df = ep(spark, folder).select("row_id", "model_name", "target_len", "clue_len", "split").withColumn("flat", F.lit(3))
    wide, names = pipeline.design_matrix(df, ["target_len", "clue_len", "flat"], ["split"], [("split", ["target_len"]), ("clue_len", ["target_len"])])
    return rounded(wide.select("row_id", "model_name", *names))


@query()
def error_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Elastic-net regression of the absolute error: coefficients of the chosen model."""
    return pipeline.error_regression(ep(spark, folder), "abs_error", FEATURES, ["split"], "row_id", [("split", ["target_len"])], alphas=(0.01, 0.1), ratios=(0.5,))[1]


@query(EP + """, s AS (SELECT cv_fold, feature, corr(x, gold) AS r FROM (SELECT cv_fold, gold, unnest(['target_len','source_len','clue_len']) AS feature, unnest([target_len, source_len, clue_len]) AS x FROM ep) GROUP BY ALL), n AS (SELECT *, abs(r) AS a, abs(r) / sum(abs(r)) OVER (PARTITION BY cv_fold) AS z FROM s)
SELECT feature AS feature_name, round(avg(r), 6) AS mean_score, round(stddev_samp(r), 6) AS std_score, round(avg(a), 6) AS mean_abs_score, round(stddev_samp(a), 6) AS std_abs_score, round(avg(z), 6) AS mean_normalized_score, round(stddev_samp(z), 6) AS std_normalized_score, count(DISTINCT cv_fold) AS n_folds, row_number() OVER (ORDER BY avg(a) DESC, feature)::INT AS rank, 'pearson' AS model_name, 'correlation' AS score_kind FROM n GROUP BY feature
""")
def importance_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Importances over folds, here correlations with the gold score."""
    long = analysis.long_features(ep(spark, folder), FEATURES, ["cv_fold", "gold"])
    per = long.groupBy("cv_fold", F.col("feature").alias("feature_name")).agg(pearson("value", "gold").alias("score")).withColumn("abs_score", F.abs("score"))
    total = per.groupBy("cv_fold").agg(F.sum("abs_score").alias("t"))
    frames = per.join(total, "cv_fold").select("feature_name", "score", "abs_score", (F.col("abs_score") / F.col("t")).alias("normalized_score"), F.col("cv_fold").alias("fold"))
    return rounded(pipeline.fold_importance(frames, "pearson", "correlation"))


def _paired(spark: SparkSession, folder: str) -> DataFrame:
    """Items with the mean predictions of two models: item_id, gold, cv_fold (the least), a (ridge), b (gbr)."""
    df = ep(spark, folder).filter("item_id IS NOT NULL").groupBy("item_id", "model_name").agg(F.avg("gold").alias("gold"), F.avg("pred").alias("pred"), F.min("cv_fold").alias("cv_fold"))
    one = df.filter("model_name = 'ridge'").select("item_id", "gold", "cv_fold", F.col("pred").alias("a"))
    return one.join(df.filter("model_name = 'gbr'").select("item_id", F.col("pred").alias("b")), "item_id")


_PAIRED = ", im AS (SELECT item_id, model_name, avg(gold) AS gold, avg(pred) AS pred, min(cv_fold) AS cv_fold FROM ep WHERE item_id IS NOT NULL GROUP BY ALL), p AS (SELECT r.item_id, r.gold AS y, r.cv_fold, r.pred AS a, g.pred AS b FROM im r JOIN im g ON g.item_id = r.item_id AND g.model_name = 'gbr' WHERE r.model_name = 'ridge')"


@query(EP + _PAIRED + """, s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM p), w AS (SELECT *, (ay*bb - ab*by_)/(aa*bb - ab*ab) AS wa, (aa*by_ - ab*ay)/(aa*bb - ab*ab) AS wb FROM s)
SELECT item_id, round(my + wa * (a - ma) + wb * (b - mb), 5) AS prediction FROM p, w
""")
def stacking(spark: SparkSession, folder: str) -> DataFrame:
    """Least-squares stack of two models' out-of-fold predictions."""
    return rounded(pipeline.stack(_paired(spark, folder), ["a", "b"], "gold")[1].select("item_id", "prediction"), 5)


@query(EP + _PAIRED + """, s AS (SELECT h.k, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM p JOIN (SELECT unnest([1,2,3,4,5]) AS k) h ON h.k <> p.cv_fold GROUP BY h.k), w AS (SELECT *, (ay*bb - ab*by_)/(aa*bb - ab*ab) AS wa, (aa*by_ - ab*ay)/(aa*bb - ab*ab) AS wb FROM s)
SELECT item_id, round(my + wa * (a - ma) + wb * (b - mb), 5) AS prediction FROM p JOIN w ON w.k = p.cv_fold
""")
def stacking_cross_fitted(spark: SparkSession, folder: str) -> DataFrame:
    """The stack of each fold fitted on the others."""
    return rounded(pipeline.stack(_paired(spark, folder), ["a", "b"], "gold", k=5)[1].select("item_id", "prediction"), 5)


@query(EP + _PAIRED + """, s AS (SELECT h.k, avg(a) AS ma, avg(y) AS my, covar_pop(a, y) / covar_pop(a, a) AS w FROM p JOIN (SELECT unnest([1,2,3]) AS k) h ON h.k <> p.cv_fold GROUP BY h.k)
SELECT item_id, round(avg(my + w * (a - ma)), 5) AS prediction FROM p, s GROUP BY item_id
""")
def oof_mean_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the fold models' predictions of every row."""
    df = _paired(spark, folder)
    found = pipeline.fold_models(df, 3, lambda train: models.ridge(train, ["a"], "gold", 0.0)[0])
    return rounded(pipeline.mean_prediction(df, found).select("item_id", "prediction"), 5)


@query(EP + _PAIRED + """, s AS (SELECT avg(a) AS ma, avg(y) AS my, covar_pop(a, y) / covar_pop(a, a) AS w FROM p) SELECT item_id, round(w * (a - ma), 5) AS shap_a FROM p, s""")
def shap_linear(spark: SparkSession, folder: str) -> DataFrame:
    """Exact contributions of a linear model."""
    df = _paired(spark, folder)
    return rounded(pipeline.linear_shap(df, models.ridge(df, ["a"], "gold", 0.0)[1]).select("item_id", "shap_a"), 5)


@query("SELECT row_id, round(any_value(target) FILTER (target IS NOT NULL), 6) AS gold FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY model_name, scored_at, oof_prediction NULLS FIRST) AS k FROM oof_predictions) WHERE k = 1 GROUP BY row_id")
def first_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """First prediction row of each record in a total order."""
    return rounded(keep_first(table(spark, folder, "oof_predictions"), ["row_id"], [F.col("model_name"), F.col("scored_at"), F.col("oof_prediction")]).select("row_id", F.col("target").alias("gold")))
