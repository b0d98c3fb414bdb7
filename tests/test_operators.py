"""Ranks by ranges, column steps, selection, tagging, encoders, stacking, metrics and configuration on small tables."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.config import validate_blocks
from glossmill.features.language import built_in_scores, ngram_model, predicted_words, shortlist
from glossmill.features.tags import best_token, lemma_map, semantic_tags
from glossmill.functions.ranges import min_ranks, quantiles, value_ranks
from glossmill.functions.similarity import cognate_columns
from glossmill.functions.stats import bootstrap_difference, evaluate, kendall, register_metric
from glossmill.functions.windows import average_ranks
from glossmill.ml import models, pipeline
from glossmill.operators import columns
from glossmill.operators.checks import ConfigError, DataError, ModelError
from glossmill.plans import analysis, selection
from glossmill.sources import ingest


def test_quantiles_and_ranks_against_numpy(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.8 else "b", rng.choice([None, float(rng.randint(0, 9)), rng.random() * 10])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.total, r.q) for r in quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).collect()}
    for g in "ab":
        own = [v for h, v in rows if h == g and v is not None]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(np.quantile(own, [0, 0.25, 0.5, 0.9, 1.0]))
    ranks = {(r.g, r.v): (r.a, r.m) for r in min_ranks(average_ranks(df, "v", ["g"], "a"), "v", ["g"], "m").collect()}
    own = sorted(v for h, v in rows if h == "a" and v is not None)
    for v in set(own):
        below, ties = sum(x < v for x in own), own.count(v)
        assert ranks[("a", v)] == (below + (ties + 1) / 2, len(own) - below - ties + 1)
    assert quantiles(df.filter("false"), "v", [0.5]).first().total is None and value_ranks(df.filter("false"), "v").count() == 0


def test_kendall_by_blocks_equals_one_task(spark):
    rng = random.Random(7)
    rows = [("a" if i % 4 else "b", float(rng.randint(0, 40)), rng.choice([rng.random() * 20, float(rng.randint(0, 5)), None])) for i in range(900)] + [("c", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    whole, blocks = ({r.g: (r.n, r.tau, r.p) for r in kendall(df, "x", "y", ["g"], task_rows=n).collect()} for n in (10_000, 25))
    assert set(whole) == set(blocks) == set("abc") and whole["c"] == blocks["c"] == (1, None, None)
    for g in "ab":
        assert blocks[g][0] == whole[g][0] and blocks[g][1:] == pytest.approx(whole[g][1:], abs=1e-12)


def test_column_steps(spark):
    df = spark.createDataFrame([(1, "5", None, 0.0, 2.0), (2, "x", "t", 0.0, 0.0)], "k int, s string, t string, z double, y double")
    assert [r.s for r in columns.cast_columns(df, {"s": "double"}).collect()] == [5.0, None]
    with pytest.raises(DataError):
        columns.cast_columns(df, {"s": "int"})
    assert [r.s for r in columns.cast_columns(df, {"s": "int"}, ["s"]).collect()] == [5, None]
    with pytest.raises(DataError):
        columns.keep_only(df, "s", "none")
    assert columns.should_compute(df, ["t"], "compute_if_missing") is False and columns.should_compute(df.filter("k = 1"), ["t"], "compute_if_missing") is True
    assert columns.should_compute(df, ["absent"], "compute_if_missing") and not columns.should_compute(df, ["z"], "use_existing_only")
    with pytest.raises(DataError):
        columns.should_compute(df, ["absent"], "use_existing_only")
    assert [r.z for r in columns.replace_if_all_zero(df, {"z": "y", "y": "z", "no": "y"}).collect()] == [2.0, 0.0]
    assert columns.feature_columns(df.withColumn("item_id", F.lit(1)), exclude=["z"]) == ["k", "y"] and columns.feature_columns(df, df.drop("y"), include=["z", "y"]) == ["z"]
    r = df.limit(1).select(columns.slug(F.lit(" Ä b--c! ")).alias("a"), columns.first_variant(F.lit("(x) la casa ; b")).alias("b"), columns.first_variant(F.lit(None).cast("string")).alias("c"), columns.join_text(["t", "s"], "space").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("ä_b_c", "la casa", "", " 5")
    assert columns.sample_rows(df, "k", 1).count() == 1 and [r.k for r in columns.order_by_size(df, ["z"], "y").collect()] == [1, 2]


def test_families_and_groups(spark):
    names = ["semantic_x", "cognet_n", "weighted_levenshtein_sim", "wf_zipf", "clue_len", "syllables", "mlm_rank", "zzz", "target_log_prob", "retrieval_domain_match"]
    got = {r.n: (r.f, r.g) for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", selection.family(F.col("n")).alias("f"), selection.group(F.col("n")).alias("g")).collect()}
    assert got["weighted_levenshtein_sim"] == ("cognate", "cognate") and got["wf_zipf"] == ("frequency", "frequency") and got["zzz"] == ("other", "other")
    assert got["target_log_prob"] == ("lexical", "mlm_surprisal") and got["syllables"] == ("lexical", "lexical_surface") and got["retrieval_domain_match"] == ("retrieval", "retrieval_baseline")
    df = spark.createDataFrame([(1.0, "a", 3), (float("nan"), "b", 3)], "x double, s string, c int")
    kept = {r.feature: (r.kept, r.drop_reason) for r in selection.select_features(df, "families", families={"f": ["x", "s"], "g": ["c", "none"]}, most_missing=0.5).collect()}
    assert kept == {"x": (False, "constant"), "s": (False, "non_numeric"), "c": (False, "constant")}
    assert [r.feature for r in selection.select_features(df, "infer_numeric", drop_constant=False).collect()] == ["c", "x"]
    assert selection.select_features(df, "explicit", []).count() == 0
    with pytest.raises(DataError):
        selection.select_features(df, "other")


def test_tags_tokens_and_lemmas(spark):
    df = spark.createDataFrame([("going", ["He", "is", "Going"]), ("running", ["a", "run", "ruin"]), ("", ["a"]), ("x", [])], "w string, t array<string>")
    assert [r.i for r in df.select(best_token(F.col("t"), F.col("w")).alias("i")).collect()] == [2, 2, None, None]
    lemmas = spark.createDataFrame([("going", "go"), ("houses", "house"), ("going", "going")], "form string, lemma string")
    words = spark.createDataFrame([("Going houses",), ("cats",), (None,)], "w string")
    assert sorted(r.lemma for r in lemma_map(words, lemmas, "w").collect()) == ["", "cats", "go house"]
    tagger = lambda asked: asked.withColumns({"tokens": F.split("text", " "), "tags": F.transform(F.split("text", " "), lambda t: F.concat(F.upper(t), F.lit("1.2|X3"))), "lemmas": F.split(F.lower("text"), " ")})
    items = spark.createDataFrame([("dog", "the big", "en"), (None, "c", "en"), ("haus", None, "fr")], "w string, c string, l string")
    got = [(r.p_tags, r.p_domains, r.p_lemma) for r in semantic_tags(items, tagger, "w", "c", "l", "p").orderBy("w").collect()]
    assert got == [("", "", ""), ("DOG1.2|X3", "dog|x", "dog"), ("HAUS1.2|X3", "haus|x", "haus")]


def test_ridge_cv_permutation_and_saved_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(scale=0.3, size=300) + 5
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), i % 5 + 1) for i in range(300)], "k int, a double, b double, c double, y double, cv_fold int")
    alphas, best = (0.01, 1.0, 1000.0), None
    for alpha in alphas:
        err = 0.0
        for f in range(1, 6):
            m = models.ridge(df.filter(F.col("cv_fold") != f), ["a", "b", "c"], "y", alpha)[0]
            err += m(df.filter(F.col("cv_fold") == f)).agg(F.sum(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0]
        best = min(best, (err, alpha)) if best else (err, alpha)
    model, alpha = models.ridge_cv(df, ["a", "b", "c"], "y", alphas)
    assert alpha == best[1]
    plain, coefficients = models.ridge(df, ["a", "b", "c"], "y", alpha)
    assert model(df).join(plain(df).select("k", F.col("prediction").alias("p")), "k").agg(F.max(F.abs(F.col("prediction") - F.col("p")))).first()[0] < 1e-9
    drops = {r.feature_name: r["drop"] for r in models.permutation_importance(df, model, ["a", "b", "c"], "y", "k", 1).collect()}
    assert drops["a"] > drops["b"] > drops["c"] > -0.1 and drops["a"] > 1.5
    pipeline.save_linear(str(tmp_path / "m"), spark, coefficients, {"target": "y"})
    loaded, about = pipeline.load_linear(str(tmp_path / "m"), spark)
    assert about == {"target": "y"} and loaded(df.drop("y")).agg(F.sum("prediction")).first()[0] == pytest.approx(plain(df).agg(F.sum("prediction")).first()[0])
    with pytest.raises(ModelError):
        loaded(df.drop("a"))
    summary, table = pipeline.error_regression(df, "y", ["a", "b", "c"], [], "k", alphas=(0.001,), ratios=(0.5,))
    assert summary.first().status == "ok" and summary.first().oof_r2 > 0.9 and table.first().feature_name == "a"
    assert pipeline.error_regression(df.limit(3), "y", ["a"], [], "k")[0].first().status == "insufficient_rows"
    assert pipeline.error_regression(df.withColumn("z", F.lit(1.0)), "y", ["z"], [], "k")[0].first().status == "empty_design_matrix"
    v = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>")
    assert v.select(pipeline.interaction_vector("a", "b").alias("v")).first().v == [1.0, 2.0, 3.0, -1.0, 2.0, 3.0, 3.0, -2.0]
    pipeline.check_matrix(v, "a", 2)
    with pytest.raises(ModelError):
        pipeline.check_matrix(v.withColumn("a", F.array(F.lit(float("nan")))), "a")
    fused, names = pipeline.late_fusion(df.select("k", "y"), spark.createDataFrame([(0, [1.0, 2.0])], "k int, embedding array<double>"), "k")
    assert names == ["text_0", "text_1"] and fused.count() == 300


def test_metrics_with_guards(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (3.0, 2.0)], "g double, p double")
    got = evaluate(df, "g", "p")
    assert got["mae"] == pytest.approx(2 / 3) and got["spearman"] == pytest.approx(0.5) and got["kendall_tau"] == pytest.approx(1 / 3)
    for bad in (df.filter("false"), df.withColumn("p", F.lit(float("nan"))), df.withColumn("p", F.lit(1.0))):
        with pytest.raises(DataError):
            evaluate(bad, "g", "p")
    assert evaluate(df.withColumn("p", F.lit(1.0)), "g", "p", ["rmse", "pearson"], strict=False)["pearson"] is None
    with pytest.raises(DataError):
        evaluate(df, "g", "p", ["nope"])
    with pytest.raises(DataError):
        register_metric("rmse", lambda g, p: F.lit(0))


def test_matched_pairs(spark):
    rng = random.Random(3)
    values = {i: rng.random() for i in range(40)}
    df = spark.createDataFrame([(i, "m", v) for i, v in values.items()], "row_id bigint, model string, x double")
    pairs = spark.createDataFrame([("m", i, i + 20) for i in range(20)], "model string, high_key bigint, low_key bigint")
    details = analysis.matched_pair_details(pairs, df, ["x"], keep=["model"])
    r = analysis.matched_pair_summary(details, ["model"]).first()
    diffs = [values[i + 20] - values[i] for i in range(20)]
    order = sorted(diffs, key=abs)
    assert r.n_pairs == 20 and r.mean_diff == pytest.approx(np.mean(diffs)) and r.median_diff == pytest.approx(np.median(diffs)) and r.w_plus == sum(i + 1 for i, d in enumerate(order) if d > 0)
    assert r.ci_low < r.mean_diff < r.ci_high
    two = spark.createDataFrame([(i, "g", "a" if i % 2 else "b", float(i % 2) + rng.random()) for i in range(200)], "k int, g string, s string, v double")
    ci = bootstrap_difference(two, "k", "v", ["g"], "s", "a", "b").first()
    assert ci.ci_low < 1.0 < ci.ci_high + 0.2 and ci.ci_high - ci.ci_low < 0.4


def test_language_scores(spark):
    words = spark.createDataFrame([("ab", 3), ("ac", 1)], "word string, n bigint")
    model = ngram_model(words)
    got = {r.word: r for r in built_in_scores(spark.createDataFrame([("ab",), ("q",), ("",)], "word string"), model, words).collect()}
    counts, prev = Counter({("^", "a"): 4, ("a", "b"): 3, ("a", "c"): 1, ("b", "$"): 3, ("c", "$"): 1}), Counter({"^": 4, "a": 4, "b": 3, "c": 1})
    cost = lambda p, c: -math.log((counts[(p, c)] + 1) / (prev[p] + 4))
    assert got["ab"].surprisal_pll == pytest.approx(cost("^", "a") + cost("a", "b") + cost("b", "$")) and got["ab"].mlm_rank == 1
    assert got["q"].surprisal_pll == pytest.approx(cost("^", "z") + math.log(8)) and set(got) == {"ab", "q"}
    assert len({round(getattr(got["ab"], c), 6) for c in ("mlm_entropy", "surprisal_masked", "surprisal_subword_mean")}) == 3
    vocabulary = spark.createDataFrame([("art", 5, "noun"), ("ant", 9, "noun"), ("able", 7, "adj"), ("axe", 1, "verb")], "word string, n bigint, pos string")
    items = spark.createDataFrame([(1, "a_t", "xyz", "NOUN"), (2, "az__", None, "adj"), (3, "a__", "four", "verb"), (4, "__", "x", "")], "k int, clue string, t string, p string")
    found = {}
    for r in shortlist(items, vocabulary, "k", "clue", target="t", tag="p").orderBy("place").collect():
        found.setdefault(r.k, []).append(r.word)
    assert found == {1: ["ant", "art"], 2: ["able"], 3: ["axe"]}


def test_lexicon_blend(spark):
    df = spark.createDataFrame([("casa", "house"), ("x", "")], "s string, t string")
    lexicon = spark.createDataFrame([("house", "casa", 1.0)], "source string, target string, score double")
    plain = {r.s: r.cognate_sim for r in cognate_columns(df, "s", "t").collect()}
    mixed = {r.s: (r.cognate_sim, r.weighted_levenshtein_sim) for r in cognate_columns(df, "s", "t", lexicon=lexicon).collect()}
    assert mixed["casa"][0] == pytest.approx(0.7 * plain["casa"] + 0.3) and mixed["x"] == (0.0, 0.0)
    assert {r.s: r.cognate_sim for r in cognate_columns(df, "s", "t", weights=(3.5, 3.5, 3.0)).collect()} == pytest.approx(plain)


def test_ingest_steps(spark, tmp_path):
    assert ingest.splits_to_load({"train": "a", "dev": "b", "test": ""}) == ["train", "dev"]
    for paths in ({"train": "a"}, {"train": "a", "dev": "b", "other": "c"}):
        with pytest.raises(ConfigError):
            ingest.splits_to_load(paths)
    df = spark.createDataFrame([(1, "es", " café ", "3"), (1, "es", "x", "4"), (2, "de", "y", "5")], "id int, L1 string, w string, n string")
    out = ingest.clean_split(df, ["w"], {"n": "int"}, only=("L1", "es"), unique=["id"], order="n").collect()
    assert [(r.id, r.w, r.n) for r in out] == [(1, "café", 3)]
    d = ingest.split_diagnostics(df, "id", "L1", "n").first()
    assert (d.n_rows, d.n_columns, d.n_ids, d.languages) == (3, 4, 2, ["de", "es"])
    for s in ("train", "dev"):
        df.write.parquet(f"{tmp_path}/{s}")
    ingest.write_sidecars(spark, str(tmp_path), {"train": {"feature_columns": ["w"]}, "dev": {"feature_columns": ["w", "n"]}}, {"rows": 3})
    assert ingest.processed_splits(spark, str(tmp_path))[1] == ["w"]
    with pytest.raises(DataError):
        ingest.processed_splits(spark, str(tmp_path), ("dev", "train"))
    assert ingest.extend_catalog(["a", "e_2"], ["e_10", "e_2", "e_9"]) == ["a", "e_2", "e_9", "e_10"]
    edges = "concept_id,lang_1,word_1,lang_2,word_2,translit_1,translit_2\nc1, SPA ,Casa  azul,eng,House,,\n"
    (tmp_path / "e.csv").write_text(edges)
    r = ingest.load_edges(spark, str(tmp_path / "e.csv")).first()
    assert (r.lang_1, r.word_1_norm, r.translit_1, r.translit_2_norm) == ("spa", "casa azul", "", "")


def test_configuration_blocks():
    good = {"evaluation": {"metrics": ["rmse", "kendall"], "primary_metric": "kendall"}, "model": {"name": "xgb"}, "cv": {"folds": 5, "scheme": "kfold"}, "other": 1}
    out = validate_blocks(good)
    assert out["evaluation"]["primary_metric"] == "kendall_tau" and out["model"]["name"] == "xgboost" and out["other"] == 1
    bad = [{"cv": {"folds": 1}}, {"cv": {}}, {"cv": {"folds": 3, "scheme": "none"}}, {"model": 3}, {"evaluation": {"metrics": ["nope"]}}, {"feature_groups": {"enabled": ["a", "a"]}}, {"feature_groups": {"enabled": ["a"], "disabled": ["a"]}}, {"feature_groups": {"enabled": []}}, {"runtime": {"debug": "yes"}}, {"evaluation": {"metrics": ["rmse"], "primary_metric": "mae"}}]
    for config in bad:
        with pytest.raises(ConfigError):
            validate_blocks(config)
    with pytest.raises(ConfigError):
        validate_blocks({}, ["schema"])


def test_prompts(spark):
    df = spark.createDataFrame([("t", 2.5, 1, "x", True), (None, None, 0, " ", None)], "t string, a double, b int, s string, f boolean")
    kinds = analysis.prompt_kinds(df, ["a", "b", "s", "f"])
    assert kinds == {"a": "float", "b": "bool", "s": "str", "f": "bool"}
    got = [r.p for r in df.select(analysis.prompt(["t"], ["a", "b", "s", "f"], kinds=kinds | {"a": "int"}).alias("p")).collect()]
    assert got == ["TEXT: t [SEP] FEATURES: a=2 | b=true | s=x | f=true", "TEXT:  [SEP] FEATURES: a=NA | b=false | s=NA | f=NA"]


def test_shortlist_against_brute_force(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))): rng.randint(1, 30) for _ in range(150)}
    tagged = [(w, n, rng.choice(["NOUN", "VERB", None])) for w, n in words.items()]
    clue = lambda: "".join(rng.choice("abc_") for _ in range(rng.randint(1, 7)))
    items = [(i, c, "".join(rng.choice("ab") for _ in range(rng.randint(0, 8))), rng.choice(["NOUN", "ADJ", "", None])) for i, c in enumerate(["zz", "", None, " A__ ", *[clue() for _ in range(60)]])]

    def best(c, target, tag, k, tolerance):
        first = next((x for x in (c or "").lower() if x.isascii() and x.isalpha()), None)
        left, c = [w for w in tagged if first and w[0].startswith(first)], (c or "").strip(" ").lower()
        length = len(target or c)
        for fit in (lambda w: len(w[0]) == len(c) and all(x in ("_", y) for x, y in zip(c, w[0])), lambda w: abs(len(w[0]) - length) <= tolerance, lambda w: not tag or (w[2] or "").lower() == tag.lower()):
            left = [w for w in left if fit(w)] or left
        return [w[0] for w in sorted(left, key=lambda w: (-w[1], w[0]))[:k]]

    df, vocabulary = spark.createDataFrame(items, "k int, clue string, t string, p string"), spark.createDataFrame(tagged, "word string, n int, pos string")
    for k, target, tag, tolerance in ((3, None, None, 0), (4, "t", "p", 1), (50, "t", "p", 0)):
        got = {}
        for r in shortlist(df, vocabulary, "k", "clue", k=k, target=target, tag=tag, tolerance=tolerance).orderBy("place").collect():
            got.setdefault(r.k, []).append(r.word)
        want = {i: w for i, c, t, p in items if (w := best(c, t if target else "", p if tag else "", k, tolerance))}
        assert got == want and len(want) > 30


def test_predicted_words_move_clues_not_items(spark):
    """feature_table's time: 50 candidates of every item were sorted and summed, where few clues are asked."""
    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    items = spark.range(20_000).select(F.col("id").alias("k"), F.element_at(F.array(F.lit("a__"), F.lit("b__")), (F.col("id") % 2 + 1).cast("int")).alias("clue"))
    vocabulary = spark.createDataFrame([(a + b + c, 1 + i) for i, (a, b, c) in enumerate(product("ab", "abcdefgh", "abcdefgh"))], "word string, n int")
    before = shuffled()
    got = predicted_words(items, vocabulary, "k", "clue").collect()
    assert len(got) == 20_000 and {r.mlm_pred_word for r in got} == {"ahh", "bhh"}
    assert shuffled() - before < 500_000
