"""String similarity of word pairs. Set measures are native; the two alignment measures run in Arrow batches over
distinct pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import spread

# Letter pairs that replace each other at half cost, and the vowels that do.
HALF_COST = ("ck", "fv", "iy", "sz", "uw", "gj")
VOWELS = "aeiou"
CHAR_WEIGHTS = (0.45, 0.40, 0.15)
COGNATE_WEIGHTS = (0.35, 0.35, 0.30)
LEXICON_SHARE = 0.3


def unaccented_word(c: Column) -> Column:
    """Lower-case word characters without accents (Latin letters), NULL as ''."""
    marked, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.regexp_replace(F.translate(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss")), marked, plain), "(?U)[^\\w]", "")


def bigram_set(c: Column) -> Column:
    """Distinct character pairs; a single character is its own set."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def set_jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b|, 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def shared_char_ratio(a: Column, b: Column) -> Column:
    """Characters in common as bags, over the longer length."""
    count = lambda s, ch: F.length(s) - F.length(F.replace(s, ch, F.lit("")))
    chars = F.array_distinct(F.regexp_extract_all(a, F.lit("(?s)."), F.lit(0)))
    common = F.aggregate(chars, F.lit(0), lambda n, ch: n + F.least(count(a, ch), count(b, ch)).cast("int"))
    return F.coalesce(F.try_divide(common, F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def prefix_suffix_ratio(a: Column, b: Column) -> Column:
    """(common prefix + common suffix) / (2 * longer length)."""
    n = F.least(F.length(a), F.length(b))
    steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    head = F.size(F.filter(steps, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    tail = F.size(F.filter(steps, lambda i: F.right(a, i) == F.right(b, i)))
    return F.coalesce(F.try_divide(head + tail, 2 * F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number (Hyyro)."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


#: Letter pairs, both ways round, that replace each other at half cost.
_HALF = {(x, y) for p in HALF_COST for x, y in (p, p[::-1])} | {(x, y) for x in VOWELS for y in VOWELS if x != y}


def _weighted_edits(a: str, b: str) -> float:
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        corner, left = row[0], float(i)
        row[0] = left
        for j, y in enumerate(b, 1):
            above = row[j]
            least = corner if x == y else corner + 0.5 if (x, y) in _HALF else corner + 1
            if above + 1 < least:
                least = above + 1
            if left + 1 < least:
                least = left + 1
            corner = above
            row[j] = left = least
    return row[-1]


def alignments(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs with lcs_ratio and weighted_levenshtein_sim in [0, 1]; two empty words are 1 alike by edits, 0 by LCS."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x, y in zip(batch[a], batch[b]):
                n = max(len(x), len(y))
                rows.append((x, y, _lcs(x, y) / n if n else 0.0, max(0.0, 1 - _weighted_edits(x, y) / n) if n else 1.0))
            yield pd.DataFrame(rows, columns=[a, b, "lcs_ratio", "weighted_levenshtein_sim"])

    return spread(pairs.select(a, b), a, b).distinct().mapInPandas(scan, f"{a} string, {b} string, lcs_ratio double, weighted_levenshtein_sim double")


def graph_signal(kind: Column, shared: Column) -> Column:
    """Concept-graph evidence: exact pair 1, shared concept .75, both found .25, one found .10, plus a little for several."""
    base = F.when(kind == "exact_pair", 1.0).when(kind == "shared_concept_only", 0.75).when(kind == "both_found_no_shared_concept", 0.25).when(kind.isin("source_only_found", "target_only_found"), 0.10).otherwise(0.0)
    return F.least(F.lit(1.0), base + F.when(shared > 1, F.least(F.lit(0.10), 0.02 * shared)).otherwise(0.0))


def cognate_columns(df: DataFrame, source: str, target: str, kind: Column | None = None, shared: Column | None = None, least: int = 1, lexicon: DataFrame | None = None, weights: tuple[float, float, float] = COGNATE_WEIGHTS) -> DataFrame:
    """Add bigram_jaccard, lcs_ratio, prefix_suffix, char_sim, weighted_levenshtein_sim and cognate_sim of a word pair.

    weights are taken as shares of their sum. lexicon: source, target, score (folded words); a pair it holds, either
    way round, has its score mixed in by LEXICON_SHARE.
    """
    keyed = df.withColumn("_a", unaccented_word(F.col(source))).withColumn("_b", unaccented_word(F.col(target)))
    same = (F.col("_a") == F.col("_b")) & (F.col("_a") != "")
    alike = {"bigram_jaccard": F.when(same, 1.0).otherwise(set_jaccard(bigram_set(F.col("_a")), bigram_set(F.col("_b")))), "prefix_suffix": prefix_suffix_ratio(F.col("_a"), F.col("_b"))}
    measured = alignments(keyed, "_a", "_b").withColumns(alike)  # of distinct pairs
    out = keyed.join(measured.select("_a", "_b", "lcs_ratio", "weighted_levenshtein_sim", *alike), ["_a", "_b"], "left")
    x, y, z = CHAR_WEIGHTS
    out = out.withColumn("char_sim", F.least(F.lit(1.0), x * F.col("bigram_jaccard") + y * F.col("lcs_ratio") + z * F.col("prefix_suffix")))
    signal = F.lit(0.0) if kind is None else graph_signal(kind, shared)
    x, y, z = (w / sum(weights) for w in weights)
    score = x * F.col("char_sim") + y * F.col("weighted_levenshtein_sim") + z * signal
    if lexicon is not None:
        swapped = lexicon.select(F.col("target").alias("_a"), F.col("source").alias("_b"), "score", F.lit(1).alias("way"))
        both = lexicon.select(F.col("source").alias("_a"), F.col("target").alias("_b"), "score", F.lit(0).alias("way")).unionByName(swapped)
        best = both.groupBy("_a", "_b").agg(F.min_by("score", F.struct("way", (-F.col("score")).alias("s"))).alias("_lexicon"))
        out = out.join(best, ["_a", "_b"], "left")
        score = F.when(F.col("_lexicon").isNotNull(), (1 - LEXICON_SHARE) * score + LEXICON_SHARE * F.col("_lexicon")).otherwise(score)
    short = (F.length("_a") < least) | (F.length("_b") < least)
    out = out.withColumn("cognate_sim", F.when(short, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))
    return out.withColumn("weighted_levenshtein_sim", F.when(short, 0.0).otherwise(F.col("weighted_levenshtein_sim"))).drop("_a", "_b", "_lexicon")
