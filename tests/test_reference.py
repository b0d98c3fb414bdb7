"""Hand-worked values of features and statistics, and SQL twins on the smallest tables."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.features.build import Resources, build
from glossmill.features.frequency import tag_columns, token_frequencies
from glossmill.features.lexical import lexical_columns, syllables
from glossmill.features.retrieval import clue_matches, entropy, retrieval_columns, semantic_columns
from glossmill.functions.similarity import cognate_columns
from glossmill.functions.stats import kendall_arrays, mann_whitney
from glossmill.functions.windows import benjamini_hochberg, right_closed_bin
from glossmill.operators.concepts import candidates
from glossmill.operators.source_words import entry_struct
from glossmill.plans import core_queries, reference_queries
from glossmill.sources.tables import table

SMALL = "/root/testdata/sf0.001"
WORKED = [("música", "music", "m____", 0.755833, 0.833333, 0.556208), ("familia", "family", "f_____", 0.596429, 0.785714, 0.48375), ("Haus", "house", "h____", 0.33, 0.7, 0.3605), ("perro", "dog", "d__", 0.08, 0.1, 0.063), ("mesa", "table", "ta___", 0.08, 0.2, 0.098)]


def test_worked_similarities(spark):
    df = spark.createDataFrame([w[:3] for w in WORKED], "s string, t string, c string")
    got = {r.s: (round(r.char_sim, 6), round(r.weighted_levenshtein_sim, 6), round(r.cognate_sim, 6)) for r in cognate_columns(df, "s", "t").collect()}
    for s, _, _, *want in WORKED:
        assert got[s] == pytest.approx(want, abs=2e-6), s


def test_surface(spark):
    df = spark.createDataFrame([("música", "music", "m____"), (None, None, None)], "s string, t string, c string")
    cols = lexical_columns(F.col("t"), F.col("s"), F.col("c"))
    a, b = df.select(*[c.alias(n) for n, c in cols.items()]).collect()
    assert (a.target_syllables, a.clue_visible_chars, a.clue_hidden_chars, a.clue_ratio, round(a.shared_char_ratio, 6)) == (2, 1, 4, 0.2, 0.666667)
    assert (b.target_len, b.target_syllables, b.clue_ratio) == (0, 0, 0.0)
    words = ["table", "house", "the", "rhythm", "eye", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(syllables(F.col("w")).alias("n")).collect()
    assert [r.n for r in got] == [2, 1, 1, 1, 1, 0]


def test_retrieval_entropy_clue(spark):
    df = spark.createDataFrame([("music", "m____", "none here", ["a", "b", "c"], [1.0, 1.0, 2.0])], "t string, c string, x string, d array<string>, w array<double>")
    r = df.select(retrieval_columns(F.col("t"), F.col("c"), F.col("x"))["retrieval_target_prior"].alias("p"), entropy(F.col("w")).alias("e"), clue_matches(F.col("t"), F.col("c")).alias("m"), clue_matches(F.col("t"), F.lit("x____")).alias("n")).first()
    assert (round(r.p, 6), round(r.e, 6), r.m, r.n) == (0.45, 1.039721, True, False)


def test_kendall_against_pairs():
    assert kendall_arrays(np.array([1, 2, 2, 3.0]), np.array([1, 3, 2, 4.0]))[0] == pytest.approx(0.912871, abs=1e-6)
    rng = np.random.default_rng(3)
    for n in (2, 3, 7, 50, 200):
        x, y = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
        c = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
        i = np.triu_indices(n, 1)
        den = math.sqrt((np.sign(x[:, None] - x)[i] != 0).sum() * (np.sign(y[:, None] - y)[i] != 0).sum())
        tau = kendall_arrays(x, y)[0]
        assert math.isnan(tau) if den == 0 else tau == pytest.approx(c[i].sum() / den)


def test_mann_whitney_against_pairs(spark):
    rng = random.Random(5)
    rows = [("g", "a" if i % 3 else "b", float(rng.randint(0, 6))) for i in range(60)]
    r = mann_whitney(spark.createDataFrame(rows, "g string, s string, v double"), "v", "s", ["g"], "a", "b").first()
    a, b = [v for _, s, v in rows if s == "a"], [v for _, s, v in rows if s == "b"]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.u == u and r.delta == pytest.approx(2 * u / (len(a) * len(b)) - 1)


def test_benjamini_hochberg_and_bins(spark):
    df = spark.createDataFrame([("g", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])] + [("g", 9, None)], "g string, i int, p double")
    got = {r.i: r.q for r in benjamini_hochberg(df, "p", ["g"], "q", ["i"]).collect()}
    assert [round(got[i], 6) for i in range(4)] == [0.02, 0.04, 0.04, 0.02] and got[9] is None
    bins = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.5)], "v double").select(right_closed_bin(F.col("v"), F.array(*[F.lit(float(e)) for e in range(4)])).alias("b")).collect()
    assert [r.b for r in bins] == [0, 0, 1, 1, None]


def test_source_entries(spark):
    rows = [
        ("Haus, Gebäude (nicht: Heim, Bau)", "Das Gebäude ist alt", "de"), ("cosecha (no termina en: -ción)", "", "es"), ("浅薄／图 (不是书)", "图书", "cn"), (None, None, "de"),
        ("(书,本)图书；(不以子结尾)书、(a，(b，c)，d)杯", "一本图书", "cn"), ("(书,本)图册；纸", "一本图册", "cn"), ("etw. tun; jdn. Mögen; MÖGEN", "wir mögen es", "de"), ("etwas vergessen-", "nichts", "de"), ("la casa (no: el piso) (x)", "en el piso", "es"), ("jemand", "", "de"),
    ]
    got = [r.e for r in spark.createDataFrame(rows, "w string, c string, l string").select(entry_struct(F.col("w"), F.col("c"), F.col("l")).alias("e")).collect()]
    assert (got[0].word, got[0].excluded, got[0].note_type, got[0].alternatives) == ("Gebäude", "Heim|Bau", "lexical_exclusion", "Haus")
    assert (got[1].note_type, got[1].excluded) == ("suffix_constraint", "-ción")
    assert (got[2].word, got[2].excluded, got[2].context_excluded, got[2].alternative_count) == ("浅薄／图", "书", "书", 0)  # a wide slash is no separator
    assert got[3].word == "" and got[3].alternative_count == 0
    assert (got[4].word, got[4].excluded, got[4].note_type, got[4].alternatives) == ("书", "子", "suffix_constraint", "(书,本)图书|(a，(b，c)，d)杯")
    assert (got[5].word, got[5].alternatives) == ("图册", "纸")
    assert (got[6].word, got[6].alternatives) == ("MÖGEN", "etw. tun|jdn. Mögen")
    assert got[7].word == "vergessen" and got[9].word == "jemand"
    assert (got[8].word, got[8].excluded, got[8].context_excluded, got[8].note_type) == ("la", "el piso", "el piso", "lexical_exclusion")


def test_candidates(spark):
    rows = [("sich auf etw. freuen", "", "sich auf etwas freuen (nicht: lachen)", "de"), ("jdn. grüßen", "a|b", "", "de"), ("coger", "", "coger / tomar (x)", "es"), ("(书)图", "", "图、画", "cn"), ("", None, None, "de")]
    got = [r.c for r in spark.createDataFrame(rows, "w string, a string, r string, l string").select(candidates(F.col("w"), F.col("a"), F.col("r"), F.col("l")).alias("c")).collect()]
    assert got == [["freuen"], ["grüßen", "a", "b"], ["coger", "tomar"], ["图", "画"], []]


def test_tags_need_a_tagger_and_both_sides(spark):
    df = spark.createDataFrame([("gehen", "de", "Verb"), ("Haus", "de", "n"), ("Haus", "de", " "), (None, "de", "jj")], "L1_source_word string, L1 string, en_target_pos string")
    none = tag_columns(df).collect()
    assert [(r.target_pos_norm, r.target_pos_code, r.target_pos_known, r.source_pos_norm, r.source_pos_known, r.source_target_pos_match) for r in none] == [("VERB", 3, 1, "", 0, 0), ("NOUN", 1, 1, "", 0, 0), ("", 0, 0, "", 0, 0), ("ADJ", 5, 1, "", 0, 0)]
    tagger = lambda words: words.withColumn("tag", F.when(F.col("word") == "gehen", "vv").otherwise("VERB"))
    assert sorted((r.source_pos_norm, r.source_target_pos_match) for r in tag_columns(df, tagger).collect()) == [("", 0), ("VERB", 0), ("VERB", 0), ("VERB", 1)]


def test_semantic_scores(spark):
    df = spark.createDataFrame([("a;b", "b|c", "2;x", "3"), ("a", "", "-1", None), ("", None, "5", "5")], "s string, t string, ss string, ts string")
    cols = semantic_columns(F.lit("x"), F.lit("y"), F.lit("z"), F.lit("w"), F.col("s"), F.col("t"), F.col("ss"), F.col("ts"))
    got = df.select(*[c.alias(n) for n, c in cols.items()]).collect()
    h = lambda *w: -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert got[0].semantic_usas_domain_match == 1 / 3 and got[0].semantic_usas_entropy_unweighted == pytest.approx(math.log(4)) and got[0].semantic_usas_entropy_weighted == pytest.approx(h(2, 1, 3, 1))
    assert (got[1].semantic_usas_entropy_unweighted, got[1].semantic_usas_entropy_weighted) == (0.0, 0.0)
    assert got[2].semantic_usas_entropy_unweighted == 1.0  # no domains: the overlap stands in


def test_feature_groups_add_the_listed_columns(spark):
    res = Resources(table(spark, SMALL, "lexicon"), token_frequencies(table(spark, SMALL, "documents")), table(spark, SMALL, "cognet_edges"))
    df, catalog = build(table(spark, SMALL, "items"), res, ["frequency", "lexical", "retrieval", "semantic", "mlm_predicted_word", "baseline_meta"])
    assert {g: len(c) for g, c in catalog.items()} == {"frequency": 25, "lexical": 26, "retrieval": 4, "semantic": 4, "mlm_predicted_word": 4, "baseline_meta": 3}
    assert df.count() == table(spark, SMALL, "items").count()


@pytest.mark.parametrize("name", ["lex_surface", "lex_overlap", "retrieval_features", "token_frequency", "lexicon_lookup", "freq_percentile", "dedupe_first", "validation_violations", "global_metrics", "over_under_contrast", "bh_adjust", "ensemble_weighted", "ridge_closed_form", "p6_found"])
def test_sql_twins(spark, name):
    c = duckdb.connect()
    for t in ("items", "loads", "oof_predictions", "lexicon", "documents", "cognet_edges", "events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    query, sql = ({**reference_queries.QUERIES, **core_queries.QUERIES}[name], {**reference_queries.ORACLE, **core_queries.ORACLE}[name])
    clean = lambda df: sorted(tuple(None if v != v else round(v, 5) if isinstance(v, float) else v for v in r) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None))
    mine, other = query(spark, SMALL).toPandas(), c.sql(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    a, b = ([tuple(map(str, r)) for r in clean(x)] for x in (mine, other))
    assert sorted(a) == sorted(b)
