"""Lexicon and frequency features: deduplicated lexicons, (word, tag) lookup with word fallback, corpus frequencies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.features.lexical import clean_key
from glossmill.functions.windows import keep_first, percentile_ranks
from glossmill.session import durable

# Surface tags and their universal tags.
TAGS = {
    "noun": "NOUN", "n": "NOUN", "nn": "NOUN", "propn": "PROPN", "proper noun": "PROPN",
    "verb": "VERB", "v": "VERB", "vv": "VERB",
    "adj": "ADJ", "adjective": "ADJ", "jj": "ADJ",
    "adv": "ADV", "adverb": "ADV", "rb": "ADV",
    "pron": "PRON", "pronoun": "PRON",
    "det": "DET", "determiner": "DET",
    "adp": "ADP", "prep": "ADP", "preposition": "ADP",
    "conj": "CCONJ", "cconj": "CCONJ", "coord conj": "CCONJ", "coordinating conjunction": "CCONJ", "sconj": "SCONJ", "subordinating conjunction": "SCONJ",
    "num": "NUM", "number": "NUM",
    "intj": "INTJ", "interjection": "INTJ",
    "aux": "AUX", "part": "PART", "particle": "PART",
}
# Codes of universal tags.
TAG_CODES = {"": 0, "UNK": 0, "NOUN": 1, "PROPN": 2, "VERB": 3, "AUX": 4, "ADJ": 5, "ADV": 6, "PRON": 7, "DET": 8, "ADP": 9, "CCONJ": 10, "SCONJ": 11, "NUM": 12, "PART": 13, "INTJ": 14}
CEFR_CODES = {"UNK": 0, "A1": 1, "A2": 2, "B1": 3, "B2": 4, "C1": 5, "C2": 6}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def universal_tag(c: Column) -> Column:
    """Universal tag of a surface tag; unknown ones in upper case, missing ones ''."""
    return F.coalesce(F.try_element_at(_map(TAGS), clean_key(c)), F.upper(clean_key(c)))


def tag_code(c: Column) -> Column:
    """Code of a universal tag, 0 for others."""
    return F.coalesce(F.try_element_at(_map(TAG_CODES), c), F.lit(0))


def cefr_code(c: Column) -> Column:
    """Ordinal of a CEFR band, NULL for others."""
    return F.try_element_at(_map(CEFR_CODES), F.upper(F.trim(c)))


def best_entries(lexicon: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One lexicon entry per key, the best in the given (total) order."""
    return keep_first(lexicon, keys, order)


def lookup_with_fallback(items: DataFrame, lexicon: DataFrame, word: str, tag: str, values: Sequence[str], order: Sequence[Column], prefix: str) -> DataFrame:
    """Values of the (word, tag) entry if there is one, even if NULL, else of the word's best entry; found and exact flags.

    lexicon: word, tag and the values. Both joins leave the choice of strategy to its measured size.
    """
    pairs = best_entries(lexicon.filter("word <> ''"), ["word", "tag"], order).select(F.col("word").alias("_w"), F.col("tag").alias("_t"), F.struct(*values).alias("_pair"))
    words = best_entries(lexicon.filter("word <> ''"), ["word"], order).select(F.col("word").alias("_w"), F.struct(*values).alias("_word"))
    out = items.withColumn("_w", clean_key(F.col(word))).withColumn("_t", universal_tag(F.col(tag)))
    out = out.join(pairs, ["_w", "_t"], "left").join(words, "_w", "left")
    hit = F.col("_pair").isNotNull()
    chosen = {f"{prefix}_{v}": F.when(hit, F.col(f"_pair.{v}")).otherwise(F.col(f"_word.{v}")) for v in values}
    return out.withColumns({**chosen, f"{prefix}_found": F.col("_word").isNotNull().cast("int"), f"{prefix}_pos_match": hit.cast("int")}).drop("_w", "_t", "_pair", "_word")


def token_frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """Corpus lexicon: word, n, docs, rank, freq, zipf, cd (share of documents). Partial aggregates combine map-side; the counts are written, so texts are taken apart once."""
    words = documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{M}]+"), F.lit(0))).alias("word"))
    per = durable(words.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")))
    total = per.agg(F.sum("n").alias("t")).crossJoin(documents.agg(F.countDistinct("doc_id").alias("d")))
    out = per.crossJoin(F.broadcast(total))  # one row
    return out.select("word", "n", "docs", (F.col("n") / F.col("t")).alias("freq"), F.log10(F.col("n") / F.col("t") * 1e9).alias("zipf"), (F.col("docs") / F.col("d")).alias("cd"))


def word_cost(freq: Column, least: float = 1e-12) -> Column:
    """-ln of a frequency, floored so that unseen words cost a finite amount."""
    return -F.ln(F.greatest(F.coalesce(freq, F.lit(0.0)), F.lit(least)))


#: Tags of distinct words: a table (word, l1) to a table (word, l1, tag).
Tagger = Callable[[DataFrame], DataFrame]


def tag_columns(items: DataFrame, tagger: Tagger | None = None, target: str = "en_target_pos", source: str = "L1_source_word", l1: str = "L1") -> DataFrame:
    """Tags of target and source word: *_pos_norm, *_pos_code, *_pos_known, source_target_pos_match.

    The target's tag is the stated one. The source word's comes from `tagger`, asked once per distinct word and
    language; without one it is '' and unknown. Tags match if both are known and equal.
    """
    out = items.withColumn("target_pos_norm", universal_tag(F.col(target)))
    if tagger is None:
        out = out.withColumn("source_pos_norm", F.lit(""))
    else:
        asked = items.select(F.trim(F.col(source)).alias("word"), F.col(l1).alias("l1")).filter("word <> ''").distinct()
        found = tagger(asked).select(F.col("word").alias("_tw"), F.col("l1").alias("_tl"), universal_tag(F.col("tag")).alias("source_pos_norm")).dropDuplicates(["_tw", "_tl"])
        out = out.join(found, (F.trim(F.col(source)) == F.col("_tw")) & F.col(l1).eqNullSafe(F.col("_tl")), "left").drop("_tw", "_tl").withColumn("source_pos_norm", F.coalesce("source_pos_norm", F.lit("")))
    t, s = F.col("target_pos_norm"), F.col("source_pos_norm")
    out = out.withColumns({f"{k}_pos_code": tag_code(F.col(f"{k}_pos_norm")) for k in ("target", "source")} | {f"{k}_pos_known": (F.col(f"{k}_pos_norm") != "").cast("int") for k in ("target", "source")})
    return out.withColumn("source_target_pos_match", ((t != "") & (s != "") & (t == s)).cast("int"))


def frequency_group(items: DataFrame, lexicon: DataFrame, corpus: DataFrame, split: str = "split", tagger: Tagger | None = None) -> DataFrame:
    """Frequency features of the target word: tags, Kelly-like and SUBTLEX-like lookups, corpus frequencies, percentiles in the split."""
    lex = lexicon.select(clean_key(F.col("word")).alias("word"), universal_tag(F.col("part_of_speech")).alias("tag"), "kelly_rank", "cefr", "points", "zipf", "subtl_wf")
    out = lookup_with_fallback(items, lex, "en_target_word", "en_target_pos", ["kelly_rank", "cefr", "points"], [F.coalesce("kelly_rank", F.lit(1 << 30)), F.coalesce("points", F.lit(0.0)), F.coalesce("cefr", F.lit("")), F.col("tag")], "kelly")
    out = out.withColumnsRenamed({"kelly_kelly_rank": "kelly_rank"})
    out = lookup_with_fallback(out, lex, "en_target_word", "en_target_pos", ["subtl_wf", "zipf"], [-F.coalesce("subtl_wf", F.lit(-1.0)), -F.coalesce("zipf", F.lit(-1.0)), F.col("tag")], "subtlex").withColumnsRenamed({"subtlex_subtl_wf": "subtlex_wf"})
    seen = corpus.select(F.col("word").alias("_cw"), F.col("freq").alias("wf_value"), F.col("zipf").alias("wf_zipf"), F.col("cd").alias("subtlex_cd"))
    out = out.withColumn("_cw", clean_key(F.col("en_target_word"))).join(seen, "_cw", "left").drop("_cw")
    out = out.withColumns(
        {
            "wf_found": F.col("wf_value").isNotNull().cast("int"), "wf_cost": word_cost(F.col("wf_value")),
            "subtlex_lg10wf": F.when(F.col("subtlex_wf") > 0, F.log10(F.col("subtlex_wf"))), "subtlex_lg10cd": F.when(F.col("subtlex_cd") > 0, F.log10(F.col("subtlex_cd"))),
        }
    )
    out = tag_columns(out, tagger)
    out = percentile_ranks(out, "kelly_rank", [split], "kelly_rank_percentile", descending=True)
    out = percentile_ranks(out, "wf_zipf", [split], "wf_percentile")
    zero = ["wf_value", "wf_zipf", "wf_percentile", "kelly_rank", "kelly_rank_percentile", "kelly_points", "subtlex_wf", "subtlex_lg10wf", "subtlex_cd", "subtlex_lg10cd", "subtlex_zipf"]
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in zero} | {"kelly_cefr": F.coalesce("kelly_cefr", F.lit("UNK"))})
