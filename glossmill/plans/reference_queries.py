"""Queries of the feature, enrichment, statistics and modelling operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.features.frequency import TAGS, cefr_code, lookup_with_fallback, token_frequencies, universal_tag, word_cost
from glossmill.features.language import predicted_words
from glossmill.features.lexical import clean_key, lexical_columns
from glossmill.features.retrieval import baseline_columns, clue_matches, retrieval_columns, semantic_columns
from glossmill.functions.similarity import bigram_set, cognate_columns, prefix_suffix_ratio, set_jaccard, shared_char_ratio
from glossmill.functions.stats import bootstrap, kendall, pearson, wilcoxon
from glossmill.functions.windows import average_ranks, benjamini_hochberg, fixed_bins, keep_first, percentile_ranks, top_k, zscores
from glossmill.ml import folds, models
from glossmill.functions.text import is_missing, strip
from glossmill.operators import checks, concepts
from glossmill.operators.fill import load_languages
from glossmill.operators.source_words import entry_struct
from glossmill.plans import analysis
from glossmill.plans.core_queries import rounded
from glossmill.session import durable
from glossmill.sources.files import union_common
from glossmill.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FEATURES = ["target_len", "source_len", "clue_len"]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


EP = """
WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, model_name ORDER BY scored_at NULLS FIRST, oof_prediction NULLS FIRST) AS rn FROM oof_predictions) WHERE rn = 1),
e0 AS (SELECT o.row_id, model_name, cv_fold, target AS gold, oof_prediction AS pred, i.item_id, coalesce(i.L1, '?') AS lang, i.split, i.source, i.L1_source_word, i.en_target_word, i.en_target_clue
       FROM o JOIN items i ON i.row_id = o.row_id WHERE target IS NOT NULL AND oof_prediction IS NOT NULL AND NOT isnan(target) AND NOT isnan(oof_prediction)),
e1 AS (SELECT *, pred - gold AS signed_error, abs(pred - gold) AS abs_error, CASE WHEN pred > gold THEN 1 ELSE 0 END AS over_, length(coalesce(en_target_word, '')) AS target_len, length(coalesce(L1_source_word, '')) AS source_len, length(coalesce(en_target_clue, '')) AS clue_len FROM e0),
q AS (SELECT quantile_cont(gold, 0.2) AS a, quantile_cont(gold, 0.4) AS b, quantile_cont(gold, 0.6) AS c, quantile_cont(gold, 0.8) AS d FROM e1),
ep AS (SELECT e1.*, CASE WHEN gold > d THEN 4 WHEN gold > c THEN 3 WHEN gold > b THEN 2 WHEN gold > a THEN 1 ELSE 0 END AS bin_idx FROM e1, q)
"""


def ep(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled error frame with length features."""
    df = analysis.labelled(table(spark, folder, "oof_predictions"), table(spark, folder, "items"))
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return df.withColumns({"target_len": n("en_target_word"), "source_len": n("L1_source_word"), "clue_len": n("en_target_clue")})


# --- text features ------------------------------------------------------------------------------------------------
_KEY = "CASE WHEN lower(trim(coalesce({c}, ''), ' ')) IN ('nan','none','<na>','null') THEN '' ELSE lower(trim(coalesce({c}, ''), ' ')) END"


@query(f"""
WITH k AS (SELECT row_id, coalesce(en_target_word,'') AS t, coalesce(L1_source_word,'') AS s, coalesce(en_target_clue,'') AS c, {_KEY.format(c='en_target_word')} AS tk, {_KEY.format(c='L1_source_word')} AS sk FROM items),
w AS (SELECT *, regexp_replace(lower(t), '[^a-z]', '', 'g') AS tw, length(replace(c,'_','')) AS vis, lower(regexp_extract(c,'([A-Za-z])',1)) AS f1 FROM k)
SELECT row_id, length(t) AS target_len, length(s) AS source_len, length(c) AS clue_len, vis AS clue_visible_chars, length(c) - vis AS clue_hidden_chars,
 CASE WHEN tw = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(tw,'[aeiouy]+')) - CASE WHEN tw LIKE '%e' AND NOT (tw LIKE '%le' OR tw LIKE '%ye') AND len(regexp_extract_all(tw,'[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END AS target_syllables,
 round(CASE WHEN length(t)=0 THEN 0 ELSE vis / length(t) END, 6) AS clue_ratio, greatest(0, length(t) - vis) AS clue_hidden_target_len, CAST(length(c)=length(t) AS INT) AS clue_matches_target_len,
 CAST(tk <> '' AND contains(sk, tk) AS INT) AS target_in_source, CAST(sk <> '' AND contains(tk, sk) AS INT) AS source_in_target, CAST(f1 <> '' AND f1 = substr(tk,1,1) AS INT) AS clue_initial_match,
 round(CASE WHEN len(regexp_extract_all(tk,'[a-z]')) = 0 THEN 0 ELSE len(regexp_extract_all(tk,'[aeiou]')) / len(regexp_extract_all(tk,'[a-z]')) END, 6) AS target_vowel_ratio FROM w
""")
def lex_surface(spark: SparkSession, folder: str) -> DataFrame:
    """Surface and clue features of every record."""
    cols = lexical_columns(F.col("en_target_word"), F.col("L1_source_word"), F.col("en_target_clue"))
    names = ["target_len", "source_len", "clue_len", "clue_visible_chars", "clue_hidden_chars", "target_syllables", "clue_ratio", "clue_hidden_target_len", "clue_matches_target_len", "target_in_source", "source_in_target", "clue_initial_match", "target_vowel_ratio"]
    return rounded(table(spark, folder, "items").select("row_id", *[cols[n].alias(n) for n in names]))


_PAIRS = "SELECT DISTINCT word_1_norm AS a, word_2_norm AS b FROM cognet_edges WHERE word_1_norm <> '' AND word_2_norm <> ''"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cognet_edges").select(F.col("word_1_norm").alias("a"), F.col("word_2_norm").alias("b")).filter("a <> '' AND b <> ''").distinct()


@query(f"""
WITH p AS ({_PAIRS}), g AS (SELECT a, b, CASE WHEN length(a)=1 THEN [a] ELSE list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) END AS ga, CASE WHEN length(b)=1 THEN [b] ELSE list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) END AS gb, list_distinct(string_split(a, '')) AS ca FROM p)
SELECT a, b, round(len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))), 6) AS bigram_jaccard,
 round(list_sum(list_transform(ca, lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))) / greatest(length(a), length(b)), 6) AS shared_char_ratio,
 round((len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) + len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: right(a, i) = right(b, i)))) / (2.0 * greatest(length(a), length(b))), 6) AS prefix_suffix FROM g
""")
def lex_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Native overlap measures of the edge list's word pairs."""
    a, b = F.col("a"), F.col("b")
    return rounded(_pairs(spark, folder).select("a", "b", set_jaccard(bigram_set(a), bigram_set(b)).alias("bigram_jaccard"), shared_char_ratio(a, b).alias("shared_char_ratio"), prefix_suffix_ratio(a, b).alias("prefix_suffix")))


@query()
def edit_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Unit-cost edit distance of all word pairs, in characters (the SQL's engine counts bytes)."""
    return _pairs(spark, folder).select("a", "b", F.levenshtein("a", "b").alias("edits"))


@query()
def cognate_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment and cognate scores of the word pairs (weighted edits have no SQL form)."""
    return cognate_columns(_pairs(spark, folder), "a", "b")


@query(f"""
WITH k AS (SELECT row_id, {_KEY.format(c='en_target_word')} AS t, {_KEY.format(c='en_target_clue')} AS c, {_KEY.format(c='L1_context')} AS x FROM items),
f AS (SELECT row_id, t, CAST(t <> '' AND contains(c, t) AS INT) AS ic, CAST(t <> '' AND contains(x, t) AS INT) AS ix FROM k)
SELECT row_id, ic AS retrieval_target_in_clue, ix AS retrieval_target_in_context, greatest(1, ic + ix) AS retrieval_candidate_count,
 round(greatest(0, least(1, 0.05 + 0.25*ic + 0.20*ix + least(0.35, 1.0/greatest(1, ic+ix)) + 0.05/(1 + greatest(0, length(t) - 5)))), 6) AS retrieval_target_prior FROM f
""")
def retrieval_features(spark: SparkSession, folder: str) -> DataFrame:
    """Target in clue and context with the pseudo prior."""
    cols = retrieval_columns(F.col("en_target_word"), F.col("en_target_clue"), F.col("L1_context"))
    return rounded(table(spark, folder, "items").select("row_id", *[c.alias(n) for n, c in cols.items()]))


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]+'))"
_CHARS = "list_distinct(string_split({k}, ''))"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


@query(f"""
WITH k AS (SELECT row_id, {_WORDS.format(c='L1_source_word')} AS sw, {_WORDS.format(c='en_target_word')} AS tw, {_WORDS.format(c='en_target_clue')} AS cw, {_WORDS.format(c='L1_context')} AS xw, {_KEY.format(c='L1_source_word')} AS sk, {_KEY.format(c='en_target_word')} AS tk, {_KEY.format(c='en_target_clue')} AS ck FROM items),
c AS (SELECT *, CASE WHEN sk = '' THEN [] ELSE {_CHARS.format(k='sk')} END AS sc, CASE WHEN tk = '' THEN [] ELSE {_CHARS.format(k='tk')} END AS tc, CASE WHEN ck = '' THEN [] ELSE {_CHARS.format(k='ck')} END AS cc FROM k),
j AS (SELECT row_id, {_jaccard('sw', 'tw')} AS st, {_jaccard('sc', 'tc')} AS ct, {_jaccard('sw', 'cw')} AS sc_, {_jaccard('tc', 'cc')} AS tc_, {_jaccard('tw', 'xw')} AS tx FROM c)
SELECT row_id, round(0.5 * sc_, 6) AS semantic_usas_domain_match, round(1 - st, 6) AS semantic_usas_entropy_unweighted, round(1 - ct, 6) AS semantic_usas_entropy_weighted, round(greatest(0, least(1, 1 - (0.45 * (0.5 * ct + 0.5 * st) + 0.25 * 0.5 * sc_ + 0.30 * (0.5 * tc_ + 0.5 * tx)))), 6) AS semantic_semantic_shift FROM j
""")
def semantic_features(spark: SparkSession, folder: str) -> DataFrame:
    """Domain match, entropies and semantic shift by token and character overlap."""
    cols = semantic_columns(F.col("L1_source_word"), F.col("en_target_word"), F.col("en_target_clue"), F.col("L1_context"))
    return rounded(table(spark, folder, "items").select("row_id", *[c.alias(n) for n, c in cols.items()]))


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents WHERE text <> ''), c AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, round(-sum(n / s * ln(n / s)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS s FROM c) GROUP BY doc_id
""")
def token_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy of every document's words, by two aggregates."""
    words = table(spark, folder, "documents").filter("text <> ''").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))).alias("w"))
    n = words.groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    # -sum(n/s ln(n/s)) = ln s - sum(n ln n) / s: one more aggregate, no window over a document
    return rounded(n.groupBy("doc_id").agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy")))


@query(f"""
WITH k AS (SELECT row_id, {_KEY.format(c='L1_source_word')} AS p, {_KEY.format(c='en_target_word')} AS t, {_KEY.format(c='en_target_clue')} AS c FROM items),
l AS (SELECT *, CASE WHEN p = '' THEN [] ELSE list_distinct(string_split(p, '')) END AS ps, CASE WHEN c = '' THEN [] ELSE list_filter(list_distinct(string_split(c, '')), lambda x: x <> '_') END AS cs FROM k)
SELECT row_id, length(p) AS baseline_pred_len, CAST(p <> '' AND p = t AS INT) AS baseline_pred_matches_target, round({_jaccard('ps', 'cs')}, 6) AS baseline_clue_overlap FROM l
""")
def baseline_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction features of a predictor that repeats the source word."""
    cols = baseline_columns(F.col("L1_source_word"), F.col("en_target_word"), F.col("en_target_clue"))
    return rounded(table(spark, folder, "items").select("row_id", *[c.alias(n) for n, c in cols.items()]))


@query()
def baseline_predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction features of every record with the built-in predictor's word; records without one have length 0."""
    items = table(spark, folder, "items").select("row_id", "en_target_word", "en_target_clue")
    guessed = items.join(predicted_words(items, token_frequencies(table(spark, folder, "documents")), "row_id", "en_target_clue").select("row_id", "mlm_pred_word"), "row_id", "left")
    cols = baseline_columns(F.col("mlm_pred_word"), F.col("en_target_word"), F.col("en_target_clue"))
    return rounded(guessed.select("row_id", "mlm_pred_word", *[c.alias(n) for n, c in cols.items()]))


@query("""
WITH c AS (SELECT DISTINCT en_target_clue AS clue, lower(trim(en_target_clue, ' ')) AS p FROM items WHERE en_target_clue IS NOT NULL), v AS (SELECT DISTINCT word, lower(word) AS w FROM lexicon WHERE word <> '')
SELECT clue, count(*) AS n_words, min(word) AS first_word FROM c JOIN v ON p = '' OR (length(w) = length(p) AND len(list_filter(range(1, length(p) + 1), lambda i: substr(p, i, 1) <> '_' AND substr(p, i, 1) <> substr(w, i, 1))) = 0) GROUP BY clue
""")
def clue_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Lexicon words that fit each clue, whatever it shows: the length joins, and the first letter where it is shown; a blank clue fits all."""
    c = table(spark, folder, "items").filter("en_target_clue IS NOT NULL").select(F.col("en_target_clue").alias("clue")).distinct().withColumn("t", F.lower(F.trim("clue")))
    c = c.withColumns({"f": F.substring("t", 1, 1), "n": F.length("t")})
    v = table(spark, folder, "lexicon").filter("word <> ''").select("word").distinct().withColumn("n", F.length(F.lower("word")))
    fits = clue_matches(F.col("word"), F.col("clue"))
    shown = c.filter("f NOT IN ('_', '')").join(v.withColumn("f", F.substring(F.lower("word"), 1, 1)), ["f", "n"]).filter(fits).select("clue", "word")
    hidden = c.filter("f = '_'").join(v, "n").filter(fits).select("clue", "word")
    found = shown.unionByName(hidden).groupBy("clue").agg(F.count("*").alias("n_words"), F.min("word").alias("first_word"))
    everything = F.broadcast(v.agg(F.count("*").alias("n_words"), F.min("word").alias("first_word")))  # one row
    return found.unionByName(c.filter("f = ''").crossJoin(everything).filter("n_words > 0").select("clue", "n_words", "first_word"))


@query("""
WITH c AS (SELECT lower(word) AS word, part_of_speech AS pos, count(*) AS n FROM lexicon WHERE word <> '' AND part_of_speech IS NOT NULL GROUP BY ALL)
SELECT word, sum(n)::BIGINT AS n, min(pos) FILTER (n = m) AS pos FROM (SELECT *, max(n) OVER (PARTITION BY word) AS m FROM c) GROUP BY word
""")
def vocab_mode_pos(spark: SparkSession, folder: str) -> DataFrame:
    """Words with their number and modal tag, ties to the smallest."""
    lex = table(spark, folder, "lexicon").filter("word <> '' AND part_of_speech IS NOT NULL").groupBy(F.lower("word").alias("word"), F.col("part_of_speech").alias("pos")).agg(F.count("*").alias("n"))
    return lex.groupBy("word").agg(F.sum("n").alias("n"), F.min_by("pos", F.struct((-F.col("n")).alias("m"), F.col("pos"))).alias("pos"))


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}]+')) AS word FROM documents), s AS (SELECT count(*) AS t FROM t), d AS (SELECT count(DISTINCT doc_id) AS d FROM documents)
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs, round(count(*) / any_value(t), 9) AS freq, round(log10(count(*) / any_value(t) * 1e9), 6) AS zipf, round(count(DISTINCT doc_id) / any_value(d), 6) AS cd, round(-ln(count(*) / any_value(t)), 6) AS cost FROM t, s, d GROUP BY word
""")
def token_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus lexicon of documents."""
    t = token_frequencies(table(spark, folder, "documents"))
    return t.select("word", "n", "docs", F.round("freq", 9).alias("freq"), F.round("zipf", 6).alias("zipf"), F.round("cd", 6).alias("cd"), F.round(word_cost(F.col("freq")), 6).alias("cost"))


def _tag_sql(c: str) -> str:
    """The universal tag of a column, in SQL."""
    key = _KEY.format(c=c)
    return f"coalesce(CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + f" END, upper({key}))"


@query(f"""
WITH l AS (SELECT * FROM (SELECT {_KEY.format(c='word')} AS word, {_tag_sql('part_of_speech')} AS tag, zipf, subtl_wf FROM lexicon) WHERE word <> ''),
p AS (SELECT word, tag, subtl_wf, zipf FROM (SELECT *, row_number() OVER (PARTITION BY word, tag ORDER BY coalesce(subtl_wf,-1) DESC, coalesce(zipf,-1) DESC) AS rn FROM l) WHERE rn = 1),
w AS (SELECT word, subtl_wf, zipf FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY coalesce(subtl_wf,-1) DESC, coalesce(zipf,-1) DESC, tag) AS rn FROM l) WHERE rn = 1),
i AS (SELECT row_id, {_KEY.format(c='en_target_word')} AS word, {_tag_sql('en_target_pos')} AS tag FROM items)
SELECT row_id, round(CASE WHEN p.word IS NOT NULL THEN p.subtl_wf ELSE w.subtl_wf END, 6) AS subtlex_wf, round(CASE WHEN p.word IS NOT NULL THEN p.zipf ELSE w.zipf END, 6) AS subtlex_zipf, CAST(w.word IS NOT NULL AS INT) AS subtlex_found, CAST(p.word IS NOT NULL AS INT) AS subtlex_pos_match
FROM i LEFT JOIN p ON p.word = i.word AND p.tag = i.tag LEFT JOIN w ON w.word = i.word
""")
def lexicon_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Lexicon values of every record by word and normalized tag, falling back to the word."""
    lex = table(spark, folder, "lexicon").select(clean_key(F.col("word")).alias("word"), universal_tag(F.col("part_of_speech")).alias("tag"), "zipf", "subtl_wf")
    items = table(spark, folder, "items").select("row_id", "en_target_word", "en_target_pos")
    out = lookup_with_fallback(items, lex, "en_target_word", "en_target_pos", ["subtl_wf", "zipf"], [-F.coalesce("subtl_wf", F.lit(-1.0)), -F.coalesce("zipf", F.lit(-1.0)), F.col("tag")], "subtlex")
    return rounded(out.select("row_id", F.col("subtlex_subtl_wf").alias("subtlex_wf"), "subtlex_zipf", "subtlex_found", "subtlex_pos_match"))


@query("""
SELECT word, part_of_speech, zipf, CASE WHEN zipf IS NULL THEN NULL ELSE round((rank() OVER (PARTITION BY part_of_speech ORDER BY zipf NULLS LAST) + (count(*) OVER (PARTITION BY part_of_speech, zipf) - 1) / 2.0) / count(zipf) OVER (PARTITION BY part_of_speech), 6) END AS zipf_percentile FROM lexicon WHERE part_of_speech IS NOT NULL
""")
def freq_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """Percentile of frequency inside each tag, average ties."""
    lex = table(spark, folder, "lexicon").filter("part_of_speech IS NOT NULL").select("word", "part_of_speech", "zipf")
    return rounded(percentile_ranks(lex, "zipf", ["part_of_speech"], "zipf_percentile").select("word", "part_of_speech", "zipf", "zipf_percentile"))


@query("SELECT cefr, CASE cefr WHEN 'A1' THEN 1 WHEN 'A2' THEN 2 WHEN 'B1' THEN 3 WHEN 'B2' THEN 4 WHEN 'C1' THEN 5 WHEN 'C2' THEN 6 WHEN 'UNK' THEN 0 END AS code, count(*) AS n FROM lexicon WHERE cefr IN ('A1','A2','B1','B2','C1','C2') GROUP BY ALL")
def cefr_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Band ordinals with their number of entries."""
    return table(spark, folder, "lexicon").filter("cefr IN ('A1','A2','B1','B2','C1','C2')").groupBy("cefr").agg(F.count("*").alias("n")).select("cefr", cefr_code(F.col("cefr")).alias("code"), "n")


# --- concept graph -----------------------------------------------------------------------------------------------
@query("SELECT lang_1, lang_2, count(*) AS n, count(DISTINCT concept_id) AS n_concepts FROM cognet_edges WHERE (lang_1 IN ('spa','deu','cmn','zho') AND lang_2 = 'eng') OR (lang_2 IN ('spa','deu','cmn','zho') AND lang_1 = 'eng') GROUP BY ALL")
def edge_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Kept edges per language pair."""
    return concepts.keep_edges(table(spark, folder, "cognet_edges")).groupBy("lang_1", "lang_2").agg(F.count("*").alias("n"), F.countDistinct("concept_id").alias("n_concepts"))


def plain_key(c: str) -> Column:
    """A word as typed in lower case with single inner blanks; NULL as ''."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " ")))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, concepts.Questions]:
    """Every item's words as typed (row_id, L1, s, t) and what they ask of the graph; the queries named _all read entries first."""
    items = table(spark, folder, "items").select("row_id", "L1", plain_key("L1_source_word").alias("s"), plain_key("en_target_word").alias("t"))
    return items, concepts.ask(items, table(spark, folder, "cognet_edges"), "row_id", "L1", F.col("s"), F.col("t"), keyed=True)


def _whole_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, concepts.Questions]:
    """Every item (row_id, l1, word, raw, target) and what it asks of the graph; a missing L1 is the load's."""
    items = table(spark, folder, "items").select("row_id", "load_id", "L1", "L1_source_word", "L1_context", "en_target_word")
    stated = F.when(is_missing(F.col("L1")), F.col("load_l1")).otherwise(F.lower(strip(F.col("L1"))))
    known = items.join(load_languages(items).withColumnRenamed("l1", "load_l1"), "load_id", "left").withColumn("language", stated).drop("L1", "load_l1")
    entries = durable(known.select("row_id", F.col("language").alias("l1"), entry_struct(F.col("L1_source_word"), F.col("L1_context"), F.col("language"))["word"].alias("word"), F.col("L1_source_word").alias("raw"), F.col("en_target_word").alias("target")))
    return entries, concepts.ask(entries, table(spark, folder, "cognet_edges"), "row_id", "l1", F.col("word"), F.col("target"), F.col("raw"))


_N = "lower(trim(regexp_replace(coalesce({c},''), '\\s+', ' ', 'g'), ' '))"
_FORMS = f"""
WITH e AS (SELECT DISTINCT concept_id, lower(trim(lang_1,' ')) AS l1, word_1, lower(trim(lang_2,' ')) AS l2, word_2, translit_1, translit_2 FROM cognet_edges),
d AS (SELECT concept_id, l1 AS lang, {_N.format(c='word_1')} AS sw, {_N.format(c='translit_1')} AS st, {_N.format(c='word_2')} AS tw, {_N.format(c='translit_2')} AS tt FROM e WHERE l1 IN ('spa','deu','cmn','zho') AND l2 = 'eng'
      UNION ALL SELECT concept_id, l2, {_N.format(c='word_2')}, {_N.format(c='translit_2')}, {_N.format(c='word_1')}, {_N.format(c='translit_1')} FROM e WHERE l2 IN ('spa','deu','cmn','zho') AND l1 = 'eng' AND NOT (l1 IN ('spa','deu','cmn','zho') AND l2 = 'eng')),
f AS (SELECT DISTINCT concept_id, lang, sf, tf FROM (SELECT concept_id, lang, unnest([sw, st]) AS sf, tw, tt FROM d) , unnest([tw, tt]) AS u(tf) WHERE sf <> '' AND tf <> ''),
i AS (SELECT row_id, L1, {_N.format(c='L1_source_word')} AS s, {_N.format(c='en_target_word')} AS t FROM items),
g AS (SELECT i.*, c.lang FROM i JOIN (SELECT unnest(['es','de','cn','cn']) AS l, unnest(['spa','deu','cmn','zho']) AS lang) c ON c.l = i.L1),
sc AS (SELECT row_id, list(DISTINCT concept_id) AS c FROM g JOIN f ON f.lang = g.lang AND f.sf = g.s GROUP BY row_id),
tc AS (SELECT row_id, list(DISTINCT concept_id) AS c FROM i JOIN f ON f.tf = i.t GROUP BY row_id),
x AS (SELECT DISTINCT row_id FROM g JOIN f ON f.lang = g.lang AND f.sf = g.s AND f.tf = g.t),
m AS (SELECT i.row_id, i.L1, x.row_id IS NOT NULL AS ex, coalesce(sc.c, []) AS s, coalesce(tc.c, []) AS t, list_intersect(coalesce(sc.c, []), coalesce(tc.c, [])) AS sh FROM i LEFT JOIN sc USING (row_id) LEFT JOIN tc USING (row_id) LEFT JOIN x USING (row_id))
"""


@query(_FORMS + "SELECT row_id, CAST(len(s) > 0 AS INT) AS source_found, CAST(len(t) > 0 AS INT) AS target_found, len(s)::INT AS n_source, len(t)::INT AS n_target, len(sh)::INT AS n_shared, list_min(sh) AS best, CASE WHEN L1 IS NULL OR L1 NOT IN ('es','de','cn') THEN 'unknown_source_language' WHEN ex THEN 'exact_pair' WHEN len(sh) > 0 THEN 'shared_concept_only' WHEN len(s) > 0 AND len(t) > 0 THEN 'both_found_no_shared_concept' WHEN len(s) > 0 THEN 'source_only_found' WHEN len(t) > 0 THEN 'target_only_found' ELSE 'no_match' END AS match_type FROM m")
def concept_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """How source and target words, as typed, meet in the concept graph."""
    return concepts.match_concepts(_graph(spark, folder)[1]).select("row_id", "source_found", "target_found", "n_source", "n_target", "n_shared", "best", "match_type")


@query(_FORMS + ", a AS (SELECT DISTINCT row_id, f.tf FROM (SELECT row_id, unnest(s) AS concept_id FROM m) u JOIN f USING (concept_id) JOIN i USING (row_id) WHERE f.tf <> i.t) SELECT row_id, count(*) AS n_words, string_agg(tf, '|' ORDER BY tf) AS text FROM a GROUP BY row_id")
def concept_alternatives(spark: SparkSession, folder: str) -> DataFrame:
    """Other target words of an item's source concepts."""
    return concepts.alternatives(_graph(spark, folder)[1]).select("row_id", F.size("words").cast("bigint").alias("n_words"), "text")


@query()
def concept_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Edges behind each match, of all items."""
    return concepts.match_details(_whole_graph(spark, folder)[1])


@query(_FORMS + "SELECT L1, count(*) AS n, round(avg(CAST(len(s) > 0 AS DOUBLE)), 6) AS source_rate, round(avg(CAST(len(t) > 0 AS DOUBLE)), 6) AS target_rate, sum(CAST(ex AS INT))::BIGINT AS n_exact, sum(CAST(len(sh) > 0 AS INT))::BIGINT AS n_shared FROM m GROUP BY L1")
def enrich_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of the graph per L1."""
    return rounded(concepts.coverage(concepts.match_concepts(_graph(spark, folder)[1]), ["L1"]))


@query(_FORMS + "SELECT i.s AS word, count(*) AS n FROM m JOIN i USING (row_id) WHERE len(m.s) = 0 GROUP BY i.s ORDER BY n DESC, word LIMIT 50")
def top_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty most frequent source words the graph lacks."""
    items, q = _graph(spark, folder)
    return concepts.match_concepts(q).filter("source_found = 0").select("row_id").join(items, "row_id").groupBy(F.col("s").alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


# The four above look words up as they are typed; these read entries first (notes, variants, look-alikes), which SQL can't express.
@query()
def concept_enrich_all(spark: SparkSession, folder: str) -> DataFrame:
    """How source and target words of all items meet in the concept graph."""
    return concepts.match_concepts(_whole_graph(spark, folder)[1]).select("row_id", "source_found", "target_found", "n_source", "n_target", "n_shared", "best", "match_type")


@query()
def concept_alternatives_all(spark: SparkSession, folder: str) -> DataFrame:
    """Other target words of the source concepts, of all items."""
    return concepts.alternatives(_whole_graph(spark, folder)[1]).select("row_id", F.size("words").cast("bigint").alias("n_words"), "text")


@query()
def enrich_coverage_all(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of the graph per L1 over all items."""
    return rounded(concepts.coverage(concepts.match_concepts(_whole_graph(spark, folder)[1]), ["l1"]))


@query()
def top_unmatched_all(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty most frequent stated source words the graph lacks, of all items."""
    items, q = _whole_graph(spark, folder)
    lacking = concepts.match_concepts(q).filter("source_found = 0").select("row_id").join(items.filter(~is_missing(F.col("raw"))), "row_id")
    return lacking.groupBy(concepts.lookup_key(F.col("word")).alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query()
def source_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Source-word entries taken apart: word, exclusions, alternatives."""
    return table(spark, folder, "items").select("row_id", entry_struct(F.col("L1_source_word"), F.col("L1_context"), F.col("L1")).alias("e")).select("row_id", "e.*")


# --- tables, checks, set operations ------------------------------------------------------------------------------
@query("SELECT row_id, model_name, round(target, 6) AS target, round(oof_prediction, 6) AS oof_prediction, cv_fold FROM (SELECT *, row_number() OVER (PARTITION BY row_id, model_name ORDER BY scored_at NULLS FIRST, oof_prediction NULLS FIRST) AS rn FROM oof_predictions) WHERE rn = 1")
def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    """First score of each record and model."""
    return rounded(keep_first(table(spark, folder, "oof_predictions"), ["row_id", "model_name"], [F.col("scored_at"), F.col("oof_prediction")]).select("row_id", "model_name", "target", "oof_prediction", "cv_fold"))


@query("SELECT split, count(*) AS n_rows, count(DISTINCT item_id) AS n_ids, count(DISTINCT L1) AS n_l1, count(*) FILTER (GLMM_score IS NULL) AS n_target_null, round(avg(CAST(en_target_pos IS NULL AS DOUBLE)), 6) AS pos_missing FROM items GROUP BY split")
def split_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes, distinct ids and missing rates per split in one aggregate."""
    return rounded(table(spark, folder, "items").groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("item_id").alias("n_ids"), F.countDistinct("L1").alias("n_l1"), F.count_if(F.col("GLMM_score").isNull()).alias("n_target_null"), F.avg(F.col("en_target_pos").isNull().cast("double")).alias("pos_missing")))


@query("""
SELECT split, 'l1_not_allowed' AS check_name, count(*) FILTER (L1 IS NULL OR L1 NOT IN ('es','de','cn')) AS n_bad FROM items GROUP BY split
UNION ALL SELECT split, 'blank_en_target_pos', count(*) FILTER (en_target_pos IS NULL OR trim(en_target_pos, ' ') = '') FROM items GROUP BY split
UNION ALL SELECT split, 'target_missing', count(*) FILTER (split <> 'test' AND GLMM_score IS NULL) FROM items GROUP BY split
UNION ALL SELECT split, 'target_not_finite', count(*) FILTER (isnan(GLMM_score)) FROM items GROUP BY split
""")
def validation_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Declared item checks per split from one pass."""
    return checks.violations(table(spark, folder, "items"), checks.item_conditions(("es", "de", "cn"), ["en_target_pos"], "GLMM_score"), ["split"])


@query("SELECT item_id, L1, count(*) AS n_rows FROM items WHERE item_id IS NOT NULL GROUP BY item_id, L1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that repeat inside an L1."""
    return checks.duplicate_keys(table(spark, folder, "items").filter("item_id IS NOT NULL"), ["item_id", "L1"])


@query("SELECT split, L1, count(*) AS n FROM items WHERE split IN ('train','dev') GROUP BY ALL")
def union_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Train and dev united on their common columns."""
    items = table(spark, folder, "items")
    return union_common(items.filter("split = 'train'"), items.filter("split = 'dev'").drop("authored_at")).groupBy("split", "L1").agg(F.count("*").alias("n"))


@query("SELECT en_target_word AS word FROM items WHERE split = 'dev' AND en_target_word IS NOT NULL EXCEPT SELECT en_target_word FROM items WHERE split = 'train'")
def set_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Dev words that train lacks."""
    items = table(spark, folder, "items").filter("en_target_word IS NOT NULL")
    return items.filter("split = 'dev'").select(F.col("en_target_word").alias("word")).subtract(items.filter("split = 'train'").select("en_target_word"))


# --- error analysis ----------------------------------------------------------------------------------------------
_METRICS = "count(*) AS n, round(avg(gold),9) AS mean_gold, round(median(gold),9) AS median_gold, round(avg(pred),9) AS mean_pred, round(median(pred),9) AS median_pred, round(sqrt(avg(signed_error*signed_error)),9) AS rmse, round(avg(abs_error),9) AS mae, round(median(abs_error),9) AS medae, round(avg(signed_error),9) AS bias, round(median(signed_error),9) AS median_error, round(avg(CAST(signed_error>0 AS INT)),9) AS prop_over, round(avg(CAST(signed_error<0 AS INT)),9) AS prop_under, round(regr_slope(pred,gold),9) AS slope, round(regr_intercept(pred,gold),9) AS intercept, round(corr(gold,pred),9) AS pearson, round(avg(CAST(abs_error<=0.5 AS INT)),9) AS within_05, round(avg(CAST(abs_error<=1 AS INT)),9) AS within_10"


@query(EP + f"SELECT {_METRICS} FROM ep")
def global_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Error metrics over all predictions."""
    return rounded(analysis.metrics_by(ep(spark, folder)), 9)


@query(EP + f"SELECT bin_idx, {_METRICS} FROM ep GROUP BY bin_idx")
def bin_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Error metrics per difficulty bin."""
    return rounded(analysis.metrics_by(ep(spark, folder), ["bin_idx"]), 9)


@query(EP + "SELECT lang, model_name, bin_idx, count(*) AS n, round(sqrt(avg(signed_error*signed_error)),9) AS rmse, round(avg(abs_error),9) AS mae, round(avg(signed_error),9) AS bias FROM ep GROUP BY ALL")
def group_bin_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Errors per language, model and bin."""
    return rounded(analysis.metrics_by(ep(spark, folder), ["lang", "model_name", "bin_idx"]).select("lang", "model_name", "bin_idx", "n", "rmse", "mae", "bias"), 9)


@query(EP + "SELECT row_id, model_name, bin_idx, CASE WHEN gold < -6 OR gold > 6 THEN NULL WHEN gold <= -2 THEN 'easy' WHEN gold <= 2 THEN 'medium' ELSE 'hard' END AS band FROM ep")
def gold_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Quantile bin and fixed band of every gold value."""
    return ep(spark, folder).select("row_id", "model_name", "bin_idx", fixed_bins(F.col("gold"), (-6, -2, 2, 6), ("easy", "medium", "hard")).alias("band"))


@query(EP + ", t AS (SELECT model_name, quantile_cont(abs_error, 0.25) AS lo, quantile_cont(abs_error, 0.75) AS hi, count(*) AS n FROM ep GROUP BY model_name) SELECT row_id, model_name, CASE WHEN n < 10 THEN 'middle' WHEN abs_error >= hi THEN 'high_error' WHEN abs_error <= lo THEN 'low_error' ELSE 'middle' END AS error_group FROM ep JOIN t USING (model_name)")
def error_group_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Low, middle and high error labels inside each model."""
    return analysis.error_groups(ep(spark, folder), ["model_name"]).select("row_id", "model_name", "error_group")


_LONG = ", l AS (SELECT model_name, row_id, signed_error, abs_error, gold, unnest(['target_len','source_len','clue_len']) AS feature, unnest([target_len, source_len, clue_len]) AS value FROM ep)"


@query(EP + _LONG + """, s AS (SELECT *, CASE WHEN signed_error > 0 THEN 'over' ELSE 'under' END AS side FROM l WHERE signed_error <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY model_name, feature ORDER BY value) + (count(*) OVER (PARTITION BY model_name, feature, value) - 1) / 2.0 AS rk FROM s),
g AS (SELECT model_name, feature, count(*) FILTER (side='over') AS n1, count(*) FILTER (side='under') AS n2, avg(value) FILTER (side='over') AS mean1, avg(value) FILTER (side='under') AS mean2, median(value) FILTER (side='over') AS median1, median(value) FILTER (side='under') AS median2, sum(rk) FILTER (side='over') AS r1 FROM r GROUP BY ALL)
SELECT model_name, feature, n1, n2, round(mean1,6) AS mean1, round(mean2,6) AS mean2, round(median1,6) AS median1, round(median2,6) AS median2, round(r1 - n1*(n1+1)/2.0, 6) AS u, round(2*(r1 - n1*(n1+1)/2.0)/(n1*n2) - 1, 6) AS delta FROM g WHERE n1 > 0 AND n2 > 0
""")
def over_under_contrast(spark: SparkSession, folder: str) -> DataFrame:
    """Features of over- against under-predicted records: U and Cliff's delta per model."""
    df = ep(spark, folder).filter("signed_error <> 0").withColumn("side", F.when(F.col("signed_error") > 0, "over").otherwise("under"))
    return rounded(analysis.contrasts(df, FEATURES, ["model_name"], "side", "over", "under").drop("p"))


_SF2 = "(1 / (1 + 0.3275911 * {x})) * (0.254829592 + (1 / (1 + 0.3275911 * {x})) * (-0.284496736 + (1 / (1 + 0.3275911 * {x})) * (1.421413741 + (1 / (1 + 0.3275911 * {x})) * (-1.453152027 + (1 / (1 + 0.3275911 * {x})) * 1.061405429)))) * exp(-{x} * {x})"


@query(EP + """, th AS (SELECT model_name, quantile_cont(abs_error, 0.25) AS lo, quantile_cont(abs_error, 0.75) AS hi, count(*) AS n FROM ep GROUP BY model_name),
s AS (SELECT model_name, CASE WHEN abs_error >= hi THEN 'h' ELSE 'l' END AS side, unnest(['target_len','source_len','clue_len']) AS feature, unnest([target_len, source_len, clue_len]) AS value FROM ep JOIN th USING (model_name) WHERE n >= 10 AND (abs_error >= hi OR abs_error <= lo)),
r AS (SELECT *, rank() OVER (PARTITION BY model_name, feature ORDER BY value) + (count(*) OVER (PARTITION BY model_name, feature, value) - 1) / 2.0 AS rk FROM s),
ti AS (SELECT model_name, feature, sum(c * c * c - c) AS ties FROM (SELECT model_name, feature, value, count(*)::DOUBLE AS c FROM s GROUP BY ALL) GROUP BY ALL),
g AS (SELECT model_name, feature, count(*) FILTER (side='h') AS n1, count(*) FILTER (side='l') AS n2, avg(value) FILTER (side='h') AS mean1, avg(value) FILTER (side='l') AS mean2, median(value) FILTER (side='h') AS median1, median(value) FILTER (side='l') AS median2, sum(rk) FILTER (side='h') AS r1 FROM r GROUP BY ALL),
u AS (SELECT g.*, r1 - n1*(n1+1)/2.0 AS u, n1*n2/12.0 * ((n1+n2+1) - ties / ((n1+n2)*(n1+n2-1.0))) AS var FROM g JOIN ti USING (model_name, feature)),
z AS (SELECT *, greatest(abs(u - n1*n2/2.0) - 0.5, 0) / nullif(sqrt(var), 0) / sqrt(2.0) AS x FROM u)
SELECT model_name, feature, n1, n2, round(mean1,6) AS mean1, round(mean2,6) AS mean2, round(median1,6) AS median1, round(median2,6) AS median2, round(u,6) AS u, round(""" + _SF2.format(x="x") + ", 6) AS p, round(2*u/(n1*n2) - 1, 6) AS delta FROM z WHERE n1 > 0 AND n2 > 0")
def low_high_contrast(spark: SparkSession, folder: str) -> DataFrame:
    """Features of low- against high-error records with p-values."""
    df = analysis.error_groups(ep(spark, folder), ["model_name"])
    return rounded(analysis.contrasts(df, FEATURES, ["model_name"], "error_group", "high_error", "low_error"))


@query(EP + _LONG + " SELECT model_name, feature, count(*) AS n, round(corr(value, abs_error),6) AS pearson_r FROM l GROUP BY ALL")
def correlations_pearson(spark: SparkSession, folder: str) -> DataFrame:
    """Pearson correlation of features with the absolute error per model."""
    long = analysis.long_features(ep(spark, folder), FEATURES, ["model_name", "abs_error"])
    return rounded(long.groupBy("model_name", "feature").agg(F.count("*").alias("n"), pearson("value", "abs_error").alias("pearson_r")))


@query(EP + _LONG + """, r AS (SELECT model_name, feature, rank() OVER (PARTITION BY model_name, feature ORDER BY value) + (count(*) OVER (PARTITION BY model_name, feature, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model_name, feature ORDER BY abs_error) + (count(*) OVER (PARTITION BY model_name, feature, abs_error) - 1) / 2.0 AS b FROM l)
SELECT model_name, feature, round(corr(a, b), 6) AS spearman_rho FROM r GROUP BY ALL
""")
def correlations_spearman(spark: SparkSession, folder: str) -> DataFrame:
    """Spearman correlation by average ranks."""
    long = analysis.long_features(ep(spark, folder), FEATURES, ["model_name", "abs_error"])
    ranked = average_ranks(average_ranks(long, "value", ["model_name", "feature"], "a"), "abs_error", ["model_name", "feature"], "b")
    return rounded(ranked.groupBy("model_name", "feature").agg(pearson("a", "b").alias("spearman_rho")))


_SMALL = "SELECT part_of_speech AS g, kelly_rank::DOUBLE AS x, zipf AS y FROM lexicon WHERE part_of_speech IS NOT NULL AND kelly_rank IS NOT NULL AND zipf IS NOT NULL"


@query(f"""
WITH s AS (SELECT *, row_number() OVER () AS k FROM ({_SMALL})), p AS (SELECT a.g, sign(a.x-b.x)*sign(a.y-b.y) AS c, a.x=b.x AS tx, a.y=b.y AS ty FROM s a JOIN s b ON a.g=b.g AND a.k<b.k)
SELECT g, round(sum(c) / sqrt(count(*) FILTER (NOT tx) * 1.0 * count(*) FILTER (NOT ty)), 6) AS tau FROM p GROUP BY g HAVING count(*) FILTER (NOT tx) > 0 AND count(*) FILTER (NOT ty) > 0
""")
def kendall_by_tag(spark: SparkSession, folder: str) -> DataFrame:
    """Kendall's tau-b of rank and frequency inside each tag."""
    lex = table(spark, folder, "lexicon").filter("part_of_speech IS NOT NULL")
    return rounded(kendall(lex, "kelly_rank", "zipf", ["part_of_speech"]).filter("tau IS NOT NULL").select(F.col("part_of_speech").alias("g"), "tau"))


@query()
def feature_associations(spark: SparkSession, folder: str) -> DataFrame:
    """Kendall association of features with the absolute error, p-values adjusted."""
    return rounded(analysis.associations(ep(spark, folder), FEATURES, ["model_name"]))


@query("""
WITH p AS (SELECT word, part_of_speech AS g, least(1.0, kelly_rank / 20000.0) AS p FROM lexicon WHERE kelly_rank IS NOT NULL AND part_of_speech IS NOT NULL AND word IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, word) AS k, count(*) OVER (PARTITION BY g) AS n FROM p)
SELECT word, g, round(p, 6) AS p, round(greatest(0, least(1, min(p * n / k) OVER (PARTITION BY g ORDER BY k DESC ROWS UNBOUNDED PRECEDING))), 6) AS p_adjusted FROM r
""")
def bh_adjust(spark: SparkSession, folder: str) -> DataFrame:
    """Adjusted values of a p-like column per group."""
    lex = table(spark, folder, "lexicon").filter("kelly_rank IS NOT NULL AND part_of_speech IS NOT NULL AND word IS NOT NULL").select("word", F.col("part_of_speech").alias("g"), F.least(F.lit(1.0), F.col("kelly_rank") / 20000.0).alias("p"))
    return rounded(benjamini_hochberg(lex, "p", ["g"], "p_adjusted", ["word"]))


@query(EP + ", pm AS (SELECT item_id, model_name, avg(abs_error) AS abs_error FROM ep WHERE item_id IS NOT NULL GROUP BY ALL), d AS (SELECT a.model_name AS m, round(a.abs_error - b.abs_error, 9) AS d FROM pm a JOIN pm b ON a.item_id = b.item_id AND b.model_name = 'ridge' AND a.model_name <> 'ridge'), r AS (SELECT *, rank() OVER (PARTITION BY m ORDER BY abs(d)) + (count(*) OVER (PARTITION BY m, abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0) SELECT m AS model_name, count(*) AS n, round(coalesce(sum(rk) FILTER (d > 0), 0), 6) AS w_plus, round(coalesce(sum(rk) FILTER (d < 0), 0), 6) AS w_minus FROM r GROUP BY m")
def paired_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Signed-rank sums of each model's mean absolute error against ridge's on the same items."""
    df = ep(spark, folder).filter("item_id IS NOT NULL").groupBy("item_id", "model_name").agg(F.avg("abs_error").alias("abs_error"))
    d = df.filter("model_name <> 'ridge'").join(df.filter("model_name = 'ridge'").select("item_id", F.col("abs_error").alias("base")), "item_id").withColumn("d", F.round(F.col("abs_error") - F.col("base"), 9))
    return rounded(wilcoxon(d, "d", ["model_name"]).select("model_name", "n", "w_plus", "w_minus"))


@query(EP + ", r AS (SELECT *, row_number() OVER (PARTITION BY lang, model_name ORDER BY abs_error, row_id) AS b, row_number() OVER (PARTITION BY lang, model_name ORDER BY abs_error DESC, row_id) AS w FROM ep) SELECT lang, model_name, row_id, 'best' AS kind, b::INT AS place FROM r WHERE b <= 5 UNION ALL SELECT lang, model_name, row_id, 'worst', w::INT FROM r WHERE w <= 5")
def best_worst_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Five best and worst predictions per language and model."""
    return analysis.extremes(ep(spark, folder), ["lang", "model_name"], 5).select("lang", "model_name", "row_id", "kind", "place")


@query(EP + _LONG + """, z AS (SELECT row_id, model_name, feature, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM l WINDOW w AS (PARTITION BY model_name, feature)),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id, model_name ORDER BY abs(round(coalesce(z,0),9)) DESC, feature) AS place FROM z) SELECT row_id, model_name, feature, round(coalesce(z,0),6) AS z FROM k WHERE place = 1
""")
def feature_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The feature that stands out most in each record."""
    long = analysis.long_features(ep(spark, folder), FEATURES, ["row_id", "model_name"])
    z = zscores(long, "value", ["model_name", "feature"], "z")
    return rounded(top_k(z, ["row_id", "model_name"], [F.abs(F.round("z", 9)).desc(), F.col("feature")], 1).select("row_id", "model_name", "feature", "z"))


@query(EP + "SELECT lang, " + ", ".join(f"coalesce(round(avg(signed_error) FILTER (bin_idx = {b}), 9), 0) AS \"{b}\"" for b in range(5)) + " FROM ep GROUP BY lang")
def pivot_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    """Mean error by language and bin as a pivot."""
    return rounded(analysis.heatmap(ep(spark, folder), "lang", "bin_idx", range(5), F.avg("signed_error")), 9)


@query("SELECT event_type, round(value, 4) AS value, round(max(c), 6) AS cdf FROM (SELECT event_type, value, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS c FROM events WHERE value IS NOT NULL) GROUP BY event_type, value")
def ecdf(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative distribution of event values per type."""
    return analysis.ecdf(table(spark, folder, "events"), "value", ["event_type"]).select("event_type", F.round("value", 4).alias("value"), F.round("cdf", 6).alias("cdf"))


@query("SELECT event_id, round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def zscore_strata(spark: SparkSession, folder: str) -> DataFrame:
    """Standardized event values inside their type."""
    return rounded(zscores(table(spark, folder, "events"), "value", ["event_type"], "z").select("event_id", "z"))


@query("""
WITH v AS (SELECT CASE WHEN isnan(GLMM_score) THEN NULL ELSE GLMM_score END AS g, item_id, length(en_target_clue) AS c, 7 AS flat FROM items)
SELECT feature, round(m, 6) AS missing_rate, d AS n_distinct, CASE WHEN m > 0.3 THEN 'missing' WHEN d <= 1 THEN 'constant' ELSE 'kept' END AS status FROM (
 SELECT unnest(['GLMM_score','item_id','clue_len','flat']) AS feature, unnest([avg((g IS NULL)::DOUBLE), avg((item_id IS NULL)::DOUBLE), avg((c IS NULL)::DOUBLE), 0.0]) AS m, unnest([count(DISTINCT g), count(DISTINCT item_id), count(DISTINCT c), 1]) AS d FROM v)
""")
def feature_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Missing rate and distinct values of item columns with what becomes of them."""
    items = table(spark, folder, "items").select(F.when(~F.isnan("GLMM_score"), F.col("GLMM_score")).alias("GLMM_score"), "item_id", F.length("en_target_clue").alias("clue_len"), F.lit(7).alias("flat"))
    return rounded(analysis.feature_diagnostics(items, ["GLMM_score", "item_id", "clue_len", "flat"]))


@query("SELECT row_id, 'TEXT: ' || coalesce(L1_context,'') || ' [SEP] ' || coalesce(en_target_word,'') || ' [SEP] FEATURES: n=' || printf('%.4f', length(coalesce(en_target_word,''))::DOUBLE) AS prompt FROM items")
def prompt_text(spark: SparkSession, folder: str) -> DataFrame:
    """Records as prompts."""
    df = table(spark, folder, "items").withColumn("n", F.length(F.coalesce("en_target_word", F.lit(""))))
    return df.select("row_id", analysis.prompt(["L1_context", "en_target_word"], ["n"]).alias("prompt"))


# --- modelling ---------------------------------------------------------------------------------------------------
@query(EP + ", w AS (SELECT model_name, 1 / sqrt(avg(signed_error*signed_error)) AS w FROM ep GROUP BY model_name) SELECT row_id, round(sum(pred * w) / sum(w), 6) AS prediction, count(*) AS n_models FROM ep JOIN w USING (model_name) GROUP BY row_id")
def ensemble_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions weighted by inverse RMSE."""
    return rounded(models.weighted_ensemble(ep(spark, folder), "model_name", "gold", "pred", "row_id"))


@query(EP + ", f AS (SELECT cv_fold, sqrt(avg(signed_error*signed_error)) AS rmse, avg(abs_error) AS mae, corr(gold, pred) AS pearson FROM ep GROUP BY cv_fold), a AS (SELECT sqrt(avg(signed_error*signed_error)) AS rmse, avg(abs_error) AS mae, corr(gold, pred) AS pearson FROM ep) SELECT 'rmse' AS metric, round(avg(f.rmse),6) AS mean, round(stddev_samp(f.rmse),6) AS std, round(any_value(a.rmse),6) AS overall FROM f, a UNION ALL SELECT 'mae', round(avg(f.mae),6), round(stddev_samp(f.mae),6), round(any_value(a.mae),6) FROM f, a UNION ALL SELECT 'pearson', round(avg(f.pearson),6), round(stddev_samp(f.pearson),6), round(any_value(a.pearson),6) FROM f, a")
def fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Fold metrics of the delivered out-of-fold predictions."""
    return rounded(folds.fold_summary(ep(spark, folder), "gold", "pred"))


@query("SELECT coalesce(item_id, -1) AS k, count(*) AS n_rows, 1 AS n_folds, true AS known FROM items GROUP BY 1")
def fold_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and folds of every item in a group fold assignment: one fold each, of the five."""
    dealt = folds.kfold(table(spark, folder, "items").withColumn("k", F.coalesce("item_id", F.lit(-1))), "k")
    return dealt.groupBy("k").agg(F.count("*").alias("n_rows"), F.countDistinct("cv_fold").cast("int").alias("n_folds"), F.bool_and(F.col("cv_fold").between(1, 5)).alias("known"))


@query(EP + ", s AS (SELECT count(*) AS n, avg(target_len) AS a, avg(source_len) AS b, avg(gold) AS y FROM ep), g AS (SELECT sum((target_len-a)*(target_len-a)) + 1 AS aa, sum((target_len-a)*(source_len-b)) AS ab, sum((source_len-b)*(source_len-b)) + 1 AS bb, sum((target_len-a)*(gold-y)) AS ay, sum((source_len-b)*(gold-y)) AS bz FROM ep, s), w AS (SELECT (ay*bb - ab*bz)/(aa*bb - ab*ab) AS wa, (aa*bz - ab*ay)/(aa*bb - ab*ab) AS wb FROM g) SELECT 'target_len' AS feature_name, round(wa,6) AS score FROM w UNION ALL SELECT 'source_len', round(wb,6) FROM w")
def ridge_closed_form(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge coefficients of two length features."""
    df = ep(spark, folder)
    _, coef = models.ridge(df, ["target_len", "source_len"], "gold", 1.0)
    return rounded(models.importance(coef, df).select("feature_name", "score"))


@query("WITH m AS (SELECT median(CASE WHEN isnan(GLMM_score) THEN NULL ELSE GLMM_score END) AS md FROM items WHERE split = 'train'), f AS (SELECT row_id, coalesce(CASE WHEN isnan(GLMM_score) THEN NULL ELSE GLMM_score END, md) AS v FROM items, m WHERE split = 'train') SELECT row_id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS GLMM_score FROM f")
def impute_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Median fill and population scaling of the score."""
    train = table(spark, folder, "items").filter("split = 'train'").select("row_id", F.when(~F.isnan("GLMM_score"), F.col("GLMM_score")).alias("GLMM_score"))
    return rounded(models.Preprocessor(train, ["GLMM_score"])(train))


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def embedding_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Euclidean norms of embeddings."""
    return table(spark, folder, "embeddings").select("vec_id", "label", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4).alias("norm"))


@query()
def pca_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Eight principal components of embeddings."""
    return models.pca(table(spark, folder, "embeddings"), "embedding", 8)[0].select("vec_id", "label", "pca")


@query()
def kmeans_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of high-error records."""
    df = analysis.error_groups(ep(spark, folder), ["model_name"]).filter("error_group = 'high_error'")
    return models.clusters(df, FEATURES).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.avg("distance").alias("mean_distance"))


@query()
def gbt_oof(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold boosted trees on length features."""
    df = keep_first(ep(spark, folder).select("row_id", "gold", *FEATURES), ["row_id"], [F.col("gold")])
    return folds.out_of_fold(folds.kfold(df, "row_id", 3), 3, lambda train: models.mllib("gbr", train, FEATURES, "gold"), ["row_id", "gold"])


@query()
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Bootstrap intervals of RMSE, MAE and bias."""
    df = ep(spark, folder).select("row_id", "signed_error", "abs_error")
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    return bootstrap(df, "row_id", {"rmse": F.sqrt(mean(F.col("signed_error") * F.col("signed_error"))), "mae": mean(F.col("abs_error")), "bias": mean(F.col("signed_error"))}, 200)


@query()
def greedy_matching(spark: SparkSession, folder: str) -> DataFrame:
    """High-error records matched with low-error ones of the same language, model and bin."""
    return analysis.greedy_matches(analysis.error_groups(ep(spark, folder), ["model_name"]), ["lang", "model_name", "bin_idx"], FEATURES)


@query()
def predicted_word(spark: SparkSession, folder: str) -> DataFrame:
    """Best corpus word for each clue with margin and entropy."""
    return predicted_words(table(spark, folder, "items"), token_frequencies(table(spark, folder, "documents")), "row_id", "en_target_clue")


@query()
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """All nine feature groups over items."""
    from glossmill.features.build import Resources, build

    res = Resources(table(spark, folder, "lexicon"), token_frequencies(table(spark, folder, "documents")), table(spark, folder, "cognet_edges"))
    return build(table(spark, folder, "items"), res)[0]
