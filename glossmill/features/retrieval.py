"""Retrieval, semantic-domain and prediction features: row-local expressions over words, clues and contexts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.features.lexical import clean_key
from glossmill.functions.similarity import set_jaccard


def retrieval_columns(target: Column, clue: Column, context: Column, candidates: Column | None = None) -> dict[str, Column]:
    """Target in clue and context, number of candidates, and the pseudo prior."""
    t, c, x = clean_key(target), clean_key(clue), clean_key(context)
    in_clue, in_context = ((t != "") & F.contains(c, t)).cast("int"), ((t != "") & F.contains(x, t)).cast("int")
    n = F.greatest(F.lit(1), in_clue + in_context) if candidates is None else F.greatest(F.lit(0), F.coalesce(candidates, F.lit(0)))
    chance = F.coalesce(F.least(F.lit(0.35), F.try_divide(F.lit(1.0), n)), F.lit(0.05))
    prior = 0.05 + 0.25 * in_clue + 0.20 * in_context + chance + 0.05 / (1 + F.greatest(F.lit(0), F.length(t) - 5))
    return {"retrieval_target_in_clue": in_clue, "retrieval_target_in_context": in_context, "retrieval_candidate_count": n, "retrieval_target_prior": F.greatest(F.lit(0.0), F.least(F.lit(1.0), prior))}


def domains(c: Column) -> Column:
    """Lower-case domain list of a string split at the first separator present among ; | , without blanks."""
    t = F.lower(F.coalesce(c, F.lit("")))
    parts = F.when(F.contains(t, F.lit(";")), F.split(t, ";")).when(F.contains(t, F.lit("|")), F.split(t, "\\|")).otherwise(F.split(t, ","))
    return F.filter(F.transform(parts, lambda d: F.trim(d)), lambda d: d != "")


def scores(c: Column, n: Column) -> Column:
    """`n` scores of a string split like a domain list: missing or unreadable ones are 1, surplus ones are dropped."""
    t = F.trim(F.coalesce(c, F.lit("")))
    parts = F.when(F.contains(t, F.lit(";")), F.split(t, ";")).when(F.contains(t, F.lit("|")), F.split(t, "\\|")).otherwise(F.split(t, ","))
    read = F.transform(parts, lambda x: F.coalesce(F.trim(x).try_cast("double"), F.lit(1.0)))
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.coalesce(F.get(read, i), F.lit(1.0))))


def entropy(weights: Column, base: float = math.e) -> Column:
    """Entropy of a list of weights as shares of their sum (negative ones count 0); 0 for an empty list."""
    if base <= 1:
        raise ValueError("the base must be over 1")
    positive = F.transform(weights, lambda x: F.greatest(F.lit(0.0), x))
    mass = F.aggregate(positive, F.lit(0.0), lambda a, x: a + x)
    return F.when(mass > 0, F.aggregate(positive, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / mass * F.ln(x / mass) / math.log(base)).otherwise(0.0))).otherwise(0.0)


def tokens(c: Column) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))


def chars(c: Column) -> Column:
    """Distinct characters of trimmed lower-case text."""
    return F.array_distinct(F.regexp_extract_all(clean_key(c), F.lit("(?s)."), F.lit(0)))


def semantic_columns(source: Column, target: Column, clue: Column, context: Column, source_domains: Column | None = None, target_domains: Column | None = None, source_scores: Column | None = None, target_scores: Column | None = None) -> dict[str, Column]:
    """Domain match, unweighted and weighted entropy, and the semantic shift; without domains, token and character overlap stand in."""
    st, ct = set_jaccard(tokens(source), tokens(target)), set_jaccard(chars(source), chars(target))
    near = lambda a, b, x, y: 0.5 * set_jaccard(chars(a), chars(b)) + 0.5 * set_jaccard(tokens(x), tokens(y))
    match, plain, weighted = 0.5 * set_jaccard(tokens(source), tokens(clue)), 1 - st, 1 - ct
    if source_domains is not None and target_domains is not None:
        s, g, none = domains(source_domains), domains(target_domains), F.lit(None).cast("string")
        some = F.size(s) + F.size(g) > 0
        weighed = F.concat(scores(none if source_scores is None else source_scores, F.size(s)), scores(none if target_scores is None else target_scores, F.size(g)))
        match = F.when(some, set_jaccard(s, g)).otherwise(match)
        plain, weighted = F.when(some, entropy(F.transform(F.concat(s, g), lambda _: F.lit(1.0)))).otherwise(plain), F.when(some, entropy(weighed)).otherwise(weighted)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    shift = unit(1 - (0.45 * near(source, target, source, target) + 0.25 * match + 0.30 * near(target, clue, target, context)))
    return {"semantic_usas_domain_match": unit(match), "semantic_usas_entropy_unweighted": plain, "semantic_usas_entropy_weighted": weighted, "semantic_semantic_shift": shift}


def baseline_columns(predicted: Column, target: Column, clue: Column) -> dict[str, Column]:
    """Length of a predicted word, whether it is the target, and its character overlap with the clue."""
    p = clean_key(predicted)
    return {"baseline_pred_len": F.length(p), "baseline_pred_matches_target": ((p != "") & (p == clean_key(target))).cast("int"), "baseline_clue_overlap": set_jaccard(chars(p), F.array_remove(chars(clue), "_"))}


def clue_matches(word: Column, clue: Column) -> Column:
    """Equal length and equal letters where the clue shows one; '_' stands for any; a blank clue fits all."""
    w, c = F.lower(word), F.lower(F.trim(F.coalesce(clue, F.lit(""))))
    shown = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: (F.substring(c, i, F.lit(1)) != "_") & (F.substring(c, i, F.lit(1)) != F.substring(w, i, F.lit(1))))
    return (c == "") | ((F.length(w) == F.length(c)) & (F.size(shown) == 0))
