"""Language-model features behind an interface, with a built-in smoothed character n-gram model fitted by aggregates.

A scorer maps distinct (context, word) pairs to scores; the plan scores distinct pairs only and joins them back.
Models with weights plug in as a callable on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.ranges import min_ranks
from glossmill.functions.windows import top_k
from glossmill.session import bounded, durable

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
COLUMNS = ("mlm_log_prob", "mlm_rank", "mlm_entropy", "surprisal_masked", "surprisal_pll", "surprisal_subword_mean", "surprisal_subword_sum")


def ngram_model(words: DataFrame, n: str = "n") -> DataFrame:
    """Character model from word counts: prev, char, cost (-ln of the add-one probability of char after prev), unseen (that of a char never seen
    after prev), alone (-ln of the add-one probability of char by itself), doubt (entropy of what follows prev)."""
    padded = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"), F.col(n).alias("n"))
    pairs = padded.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.struct(F.substring("w", i, F.lit(1)).alias("prev"), F.substring("w", i + 1, F.lit(1)).alias("char")))).alias("p"), "n").groupBy("p.prev", "p.char").agg(F.sum("n").alias("n"))
    single = pairs.groupBy("char").agg(F.sum("n").alias("cn"))
    whole = single.agg(F.count("*").alias("v"), F.sum("cn").alias("all_n"))
    prev = pairs.groupBy("prev").agg(F.sum("n").alias("t"), (F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("doubt"))
    out = pairs.join(prev, "prev").join(single, "char").crossJoin(F.broadcast(whole))  # one row
    return out.select("prev", "char", (-F.ln((F.col("n") + 1) / (F.col("t") + F.col("v")))).alias("cost"), F.ln(F.col("t") + F.col("v")).alias("unseen"), (-F.ln((F.col("cn") + 1) / (F.col("all_n") + F.col("v")))).alias("alone"), "doubt")


def built_in_scores(pairs: DataFrame, model: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Scores of distinct words under the built-in model: word and COLUMNS.

    The word masked as a whole costs its characters by themselves (mlm_log_prob is minus their sum, surprisal_masked their mean);
    masked one at a time each costs what it does after the one before it (surprisal_pll and surprisal_subword_sum their sum,
    surprisal_subword_mean their mean). mlm_entropy is the mean entropy of what might follow. Pairs and characters that the
    model lacks cost the add-one floor. mlm_rank is the word's rank by frequency, 1 for unknown ones.
    """
    words = pairs.select("word").filter("word <> ''").distinct()
    steps = words.select("word", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.struct(F.substring(F.concat(F.lit("^"), "word", F.lit("$")), i, F.lit(1)).alias("prev"), F.substring(F.concat(F.lit("^"), "word", F.lit("$")), i + 1, F.lit(1)).alias("char")))).alias("at", "s")).select("word", "at", "s.*")
    after = model.groupBy("prev").agg(F.first("unseen").alias("floor"), F.first("doubt").alias("doubt"))
    single = model.groupBy("char").agg(F.first("alone").alias("alone"))
    worst = F.broadcast(model.agg(F.coalesce(F.max("unseen"), F.lit(0.0)).alias("most"), F.coalesce(F.max("alone"), F.lit(0.0)).alias("rarest")))  # one row
    costed = steps.join(model.select("prev", "char", "cost"), ["prev", "char"], "left").join(after, "prev", "left").join(single, "char", "left").crossJoin(worst)
    costed = costed.withColumns({"cost": F.coalesce("cost", "floor", "most"), "alone": F.coalesce("alone", "rarest"), "doubt": F.coalesce("doubt", F.lit(0.0))})
    per = costed.groupBy("word").agg(F.sum("cost").alias("total"), F.avg("cost").alias("mean"), F.sum("alone").alias("masked"), F.avg("alone").alias("masked_mean"), F.avg("doubt").alias("doubt"))
    ranks = min_ranks(vocabulary.select("word", "n"), "n", [], "rank").select("word", "rank")
    out = per.join(ranks, "word", "left")
    return out.select("word", (-F.col("masked")).alias("mlm_log_prob"), F.coalesce("rank", F.lit(1)).alias("mlm_rank"), F.col("doubt").alias("mlm_entropy"), F.col("masked_mean").alias("surprisal_masked"), F.col("total").alias("surprisal_pll"), F.col("mean").alias("surprisal_subword_mean"), F.col("total").alias("surprisal_subword_sum"))


def masked_word(word: str) -> Column:
    """The word as the scorers take it."""
    return F.lower(F.trim(F.coalesce(word, F.lit(""))))


def word_scores(items: DataFrame, corpus: DataFrame, word: str = "en_target_word") -> DataFrame:
    """built_in_scores() of the items' words under the corpus model. A written table."""
    return durable(built_in_scores(items.select(masked_word(word).alias("word")), ngram_model(corpus), corpus))


def language_group(items: DataFrame, corpus: DataFrame, scorer: Scorer | None = None, context: str = "L1_context", word: str = "en_target_word", columns: tuple[str, ...] = COLUMNS, scores: DataFrame | None = None) -> DataFrame:
    """Append language-model columns; blank words score (0, 1, 0, 0, ...). scores: word_scores() of the items, if made already."""
    keyed = items.withColumn("_w", masked_word(word))
    if scorer is None:
        scores = word_scores(items, corpus, word) if scores is None else scores
        out = keyed.join(bounded(scores.select(F.col("word").alias("_w"), *columns)), "_w", "left")
    else:
        pairs = keyed.select(F.col(context).alias("context"), F.col("_w").alias("word")).distinct()
        scores = pairs.mapInPandas(scorer, "context string, word string, " + ", ".join(f"{c} double" for c in COLUMNS))
        out = keyed.join(scores.select(F.col("context").alias(context), F.col("word").alias("_w"), *columns), [context, "_w"], "left")
    rest = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns if c != "mlm_rank"}
    rank = {"mlm_rank": F.coalesce(F.col("mlm_rank").cast("int"), F.lit(1))} if "mlm_rank" in columns else {}
    return out.withColumns(rest | rank).drop("_w")


def shortlist(items: DataFrame, vocabulary: DataFrame, key: str, clue: str, k: int = 50, target: str | None = None, tag: str | None = None, tolerance: int = 0) -> DataFrame:
    """Candidate words of each item: key, word, place, n, by falling frequency.

    Steps: the clue's first letter joins, then its pattern, then a length (the target word's where `target` names its column, else
    the clue's) within `tolerance`, then the item's tag where `tag` names its column and the vocabulary has a column pos. A step
    that would leave no word of an item is passed over. vocabulary: word, n (and pos). Items whose clue shows no letter have no candidates.
    """
    from glossmill.features.retrieval import clue_matches

    none = F.lit("")
    wanted = F.lower(F.trim(F.coalesce(F.col(target), none))) if target else none
    asked = items.select(key, F.col(clue).alias("_clue"), F.lower(F.regexp_extract(F.coalesce(clue, none), "([A-Za-z])", 1)).alias("_first"), F.length(F.when(wanted != "", wanted).otherwise(F.lower(F.trim(F.coalesce(clue, none))))).alias("_len"), (F.lower(F.trim(F.coalesce(F.col(tag), none))) if tag else none).alias("_tag")).filter("_first <> ''")
    kind = ["_clue", "_first", "_len", "_tag"]
    order = [F.col("n").desc(), F.col("word")]
    words = vocabulary.filter("word rlike '^[a-z]+$'").select("word", "n", F.substring("word", 1, 1).alias("_first"), F.length("word").alias("_letters"), (F.coalesce(F.lower("pos"), none) if "pos" in vocabulary.columns else none).alias("_pos"))
    kinds = durable(asked.select(*kind).distinct())
    # a pattern fits words of its length only, so all or none of them are within the tolerance: of each tag, k are enough
    hits = words.join(bounded(kinds.withColumn("_letters", F.length(F.lower(F.trim("_clue"))))), ["_first", "_letters"]).filter(clue_matches(F.col("word"), F.col("_clue")))
    hits = durable(top_k(hits, [*kind, "_pos"], order, k, "_at").drop("_at"))
    # where no pattern fits, the steps take or leave all words of a length and tag: of these, too, k are enough
    heads = top_k(words, ["_first", "_letters", "_pos"], order, k, "_at").drop("_at")
    fits = hits.unionByName(kinds.join(hits.select(*kind).distinct(), kind, "left_anti").join(heads, "_first"))
    of_kind = Window.partitionBy(*kind)
    for fit in (F.abs(F.col("_letters") - F.col("_len")) <= tolerance, (F.col("_tag") == "") | (F.col("_pos") == F.col("_tag"))):
        fits = fits.withColumn("_fit", fit).withColumn("_any", F.max("_fit").over(of_kind)).filter(F.col("_fit") | ~F.col("_any"))
    placed = top_k(fits, kind, order, k)
    return asked.join(placed.select(*kind, "word", "place", "n"), kind).select(key, "word", "place", "n")


def clue_predictions(items: DataFrame, vocabulary: DataFrame, clue: str) -> DataFrame:
    """Best candidate of each distinct clue by corpus frequency with log share, margin to the second and entropy: the built-in predictor."""
    c = shortlist(items.select(clue).distinct(), vocabulary, clue, clue)
    p = c.withColumn("lp", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy(clue))))
    return p.groupBy(clue).agg(F.max(F.when(F.col("place") == 1, F.col("word"))).alias("mlm_pred_word"), F.max("lp").alias("mlm_pred_log_prob"), F.coalesce(F.max(F.when(F.col("place") == 1, F.col("lp"))) - F.max(F.when(F.col("place") == 2, F.col("lp"))), F.lit(0.0)).alias("mlm_pred_margin"), (-F.sum(F.exp("lp") * F.col("lp"))).alias("mlm_pred_entropy"))


def predicted_words(items: DataFrame, vocabulary: DataFrame, key: str, clue: str) -> DataFrame:
    """The prediction of each item's clue: key and the columns of clue_predictions(). Items without candidates are absent."""
    return items.select(key, clue).join(bounded(durable(clue_predictions(items, vocabulary, clue))), clue).drop(clue)
