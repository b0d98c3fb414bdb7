"""Semantic tags and lemmas behind a pluggable tagger: template texts, the token that stands for a word, coarse domains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct (text, word, lang) to rows with tokens and, parallel to them, tags and lemmas (arrays of strings).
TextTagger = Callable[[DataFrame], DataFrame]
# Texts around a word that has no context.
TEMPLATES = {"en": ("This is ", "."), "es": ("Esto es ", "."), "de": ("Das ist ", ".")}


def coarse_domain(tag: Column) -> Column:
    """Leading letters of a tag in lower case; its first character if it has none, '' for a missing one."""
    t = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    letters = F.regexp_extract(t, "^([a-z]+)", 1)
    return F.when(letters != "", letters).otherwise(F.substring(t, 1, 1))


def template_text(word: Column, context: Column, lang: Column) -> Column:
    """The context with the word behind it, or a short sentence around the word; other languages have the word alone."""
    w, c = F.trim(F.coalesce(word, F.lit(""))), F.trim(F.coalesce(context, F.lit("")))
    out = F.when(c != "", F.concat_ws(" ", c, w))
    for key, (before, after) in TEMPLATES.items():
        out = out.when(lang == key, F.concat(F.lit(before), w, F.lit(after)))
    return out.otherwise(w)


def best_token(tokens: Column, word: Column) -> Column:
    """Position, from 0, of the token that stands for a word: an equal one, else the one most alike (0.8 character overlap, 0.2 equal first two letters); NULL for a blank word or no tokens. Ties: the first."""
    w = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    folded = F.transform(tokens, lambda t: F.lower(F.trim(t)))
    letters = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)))
    alike = lambda t: F.coalesce(F.try_divide(F.size(F.array_intersect(letters(t), letters(w))), F.size(F.array_union(letters(t), letters(w)))), F.lit(0.0))
    start = lambda t: F.when((F.length(w) >= 2) & F.startswith(t, F.substring(w, 1, 2)), 1.0).otherwise(0.0)
    scored = F.filter(F.transform(folded, lambda t, i: F.struct((-F.when(t == w, 2.0).otherwise(0.8 * alike(t) + 0.2 * start(t))).alias("s"), i.alias("i"), t.alias("t"))), lambda x: x["t"] != "")
    return F.when(w != "", F.get(F.array_sort(scored), F.lit(0))["i"])


def lemma_map(words: DataFrame, lemmas: DataFrame, word: str) -> DataFrame:
    """Lower-case lemma of each text, word by word from a table (form, lemma); forms it lacks stay, several words are joined by blanks."""
    asked = words.select(F.lower(F.trim(word)).alias("_w")).filter("_w <> ''").distinct()
    parts = asked.select("_w", F.posexplode(F.split("_w", "\\s+")).alias("i", "form"))
    best = lemmas.groupBy(F.lower("form").alias("form")).agg(F.min(F.lower("lemma")).alias("lemma"))
    found = parts.join(best, "form", "left").groupBy("_w").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("lemma", "form").alias("l")))).alias("ls")).select("_w", F.array_join(F.transform("ls", lambda x: x["l"]), " ").alias("lemma"))
    out = words.withColumn("_w", F.lower(F.trim(F.coalesce(F.col(word), F.lit("")))))
    return out.join(found, "_w", "left").withColumn("lemma", F.coalesce("lemma", F.lit(""))).drop("_w")


def semantic_tags(items: DataFrame, tagger: TextTagger, word: str, context: str, lang: str, prefix: str) -> DataFrame:
    """Append <prefix>_tags ('|'-list), <prefix>_domains (distinct coarse ones) and <prefix>_lemma; each distinct text is tagged once."""
    keyed = items.withColumns({"_text": template_text(F.col(word), F.col(context), F.col(lang)), "_word": F.trim(F.coalesce(F.col(word), F.lit(""))), "_lang": F.coalesce(F.col(lang), F.lit(""))})
    asked = keyed.select(F.col("_text").alias("text"), F.col("_word").alias("word"), F.col("_lang").alias("lang")).filter("word <> ''").distinct()
    found = tagger(asked).withColumn("_at", best_token(F.col("tokens"), F.col("word")))
    tags = F.filter(F.split(F.coalesce(F.get("tags", F.col("_at")), F.lit("")), "\\|"), lambda t: t != "")
    found = found.select(F.col("text").alias("_text"), F.col("word").alias("_word"), F.col("lang").alias("_lang"), F.array_join(tags, "|").alias(f"{prefix}_tags"), F.array_join(F.array_distinct(F.transform(tags, coarse_domain)), "|").alias(f"{prefix}_domains"), F.coalesce(F.get("lemmas", F.col("_at")), F.lit("")).alias(f"{prefix}_lemma"))
    out = keyed.join(found, ["_text", "_word", "_lang"], "left").drop("_text", "_word", "_lang")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in (f"{prefix}_tags", f"{prefix}_domains", f"{prefix}_lemma")})
