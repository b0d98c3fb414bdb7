"""Same or near-same records across splits by an exact prefix-filter bipartite join on rare shingles.

Contexts become bags of words (characters in Chinese) with numbered repeats. Two contexts agree if they share
at least `agree` of the longer one's tokens. With tokens in order of global rarity, contexts that share t or
more tokens share at least two among the rarest |A| - t + 2 of each, so the index holds pairs of rare tokens
(shingles) of evaluation contexts and training contexts probe it, inside one group key. Length and positions
filter, the overlap is then counted exactly. Contexts too long for pairs (their rare tokens would be many) and
those so short that one shared token may be enough meet on single rare tokens; where the ways change follows
from `agree`, so that any two contexts that may agree have one in common. Equal contexts are folded to one before the join and unfolded after it, so copies cost
their output only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import fold_case, is_missing, let, occurrences
from glossmill.llm.canonical import closest_entries
from glossmill.operators.delimited import distinct_fields, parse_fields
from glossmill.operators.fill import load_languages
from glossmill.session import durable, settle, spread

#: Rare tokens of a bag that is indexed by their pairs, at most (496 pairs); bags with more go by single tokens.
RARE_TOKENS = 32
#: Tokens whose frequencies are broadcast, at most (about 20 MB): the most frequent ones.
BROADCAST_TOKENS = 200_000
#: Languages of loads, and candidate pairs, up to these numbers are broadcast (about 10 MB each); more are joined by a shuffle.
BROADCAST_LOADS, BROADCAST_PAIRS = 100_000, 200_000


def bag(context: Column, language: Column) -> Column:
    """Numbered tokens of a context: characters in Chinese, words elsewhere; case, marks, blanks and look-alikes don't count."""
    folded = fold_case(context)
    return let(folded, lambda t: occurrences(F.when(language == "cn", F.regexp_extract_all(t, F.lit("[\\p{L}\\p{N}]"), F.lit(0))).otherwise(F.regexp_extract_all(t, F.lit("[\\p{L}\\p{M}\\p{N}]+"), F.lit(0)))))


def ways(agree: float) -> tuple[int, int, int]:
    """Sizes of bags by way: paired up to the first, by single tokens from the second, and also up to the third.

    Bags that agree share need(larger) = ceil(agree * size) tokens or more, so the smaller has that many. Either both
    are paired; or the larger isn't, then the smaller has need(paired + 1) tokens at least; or need is 1, then the
    larger has 1 / agree tokens at most. In the last two cases both are indexed by single tokens.
    """
    if not 0 < agree <= 1:
        raise ValueError("agree must be in (0, 1]")
    paired = int((RARE_TOKENS - 2) / (1 - agree) + 1e-9) if agree < 1 else 1 << 30
    return paired, math.ceil((paired + 1) * agree - 1e-9), int(1 / agree + 1e-9)


def _keys(prefix: Column, size: Column, agree: float) -> Column:
    """Index keys of a bag, with the position of the (second) token: pairs of its rare tokens, single ones, or both (see ways())."""
    paired, single, tiny = ways(agree)
    short = F.slice(prefix, F.lit(1), F.least(size, (size - F.ceil(size * agree - 1e-9) + 2).cast("int")))
    long = F.slice(prefix, F.lit(1), (size - F.ceil(size * agree - 1e-9) + 1).cast("int"))
    pairs = let(short, lambda p: F.flatten(F.transform(p, lambda x, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y, j: F.struct(F.xxhash64(x, y).alias("k"), (i + j + 2).alias("at"))))))
    singles = F.transform(long, lambda x, i: F.struct(F.xxhash64(x, F.lit(1)).alias("k"), (i + 1).alias("at")))
    none = F.array().cast("array<struct<k:bigint,at:int>>")
    return F.concat(F.when(size <= paired, pairs).otherwise(none), F.when((size >= single) | (size <= tiny), singles).otherwise(none))


def _common(counts: DataFrame) -> DataFrame:
    """The most frequent tokens, BROADCAST_TOKENS at most: language, token, freq. The rest counts as rare alike."""
    if counts.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS:
        return counts
    cut, many = None, 0
    for row in counts.groupBy("freq").count().orderBy(F.desc("freq")).toLocalIterator():  # a row per distinct frequency, the largest first
        many += row["count"]
        if many > BROADCAST_TOKENS:
            break
        cut = row["freq"]
    return counts.filter(F.lit(False) if cut is None else F.col("freq") >= cut)


def _bits(token: Column, half: int) -> Column:
    """The bit that stands for a token in one half of a bag's signature of 128 bits."""
    h = F.xxhash64(token)
    return F.when(h.bitwiseAND(64) == 64 * half, F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("bigint"))


def near_pairs(bags: DataFrame, agree: float = 0.85) -> DataFrame:
    """Pairs of an evaluation bag and a training bag of one group that agree: eval_id, train_id, similarity.

    bags: id (unique), g (group key), language, tokens (numbered set), is_train, is_eval. Empty bags agree with
    nothing; a bag on both sides agrees with itself. Exact: no candidate is dropped but by a proven bound.
    Bags go by a number; their tokens move once, and again only those of candidates.
    """
    numbered = durable(bags.select(F.monotonically_increasing_id().alias("no"), "id", "g", "language", "tokens", "is_train", "is_eval"))
    counts = durable(numbered.select("language", F.explode("tokens").alias("token")).groupBy("language", "token").agg(F.count("*").alias("freq")))
    # any order of tokens that all bags share is exact, rarity makes it fast: what is rarer than the broadcast tokens stands first
    tokens = spread(numbered, "no").select("no", "g", "is_train", "is_eval", "language", F.explode("tokens").alias("token"))
    ranked = tokens.join(F.broadcast(_common(counts)), ["language", "token"], "left").select("no", "g", "is_train", "is_eval", F.struct(F.coalesce("freq", F.lit(0)).alias("f"), "token").alias("t"))
    halves = [F.bit_or(_bits(F.col("t.token"), i)).alias(f"s{i}") for i in (0, 1)]
    whole = ranked.groupBy("no").agg(F.first("g").alias("g"), F.first("is_train").alias("is_train"), F.first("is_eval").alias("is_eval"), F.count("*").cast("int").alias("size"), *halves, F.array_sort(F.collect_list("t")).alias("p"))
    rare = F.slice("p", F.lit(1), F.least("size", (F.col("size") - F.ceil(F.col("size") * agree - 1e-9) + 2).cast("int")))
    ready = durable(whole.select("no", "g", "is_train", "is_eval", "size", "s0", "s1", F.transform(rare, lambda t: t["token"]).alias("p")))
    posted = ready.select("no", "g", "is_train", "is_eval", "size", "s0", "s1", F.explode(_keys(F.col("p"), F.col("size"), agree)).alias("x")).select("no", "is_train", "is_eval", "size", "s0", "s1", F.xxhash64("g", "x.k").alias("k"), F.col("x.at").alias("at"))
    index = posted.filter("is_eval").select("k", F.col("no").alias("eval_no"), F.col("size").alias("es"), F.col("at").alias("ea"), F.col("s0").alias("e0"), F.col("s1").alias("e1"))
    probe = posted.filter("is_train").select("k", F.col("no").alias("train_no"), F.col("size").alias("ts"), F.col("at").alias("ta"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
    need = F.ceil(F.greatest("es", "ts") * agree - 1e-9)
    met = probe.join(index, "k").filter("eval_no <> train_no").filter(F.least("es", "ts") >= need)  # length
    met = met.filter(F.least("ea", "ta") + F.least(F.col("es") - F.col("ea"), F.col("ts") - F.col("ta")) >= need)  # position
    # signature: every bit that differs is there for another token of one bag only, of which es + ts - 2 need may be
    met = met.filter(F.bit_count(F.col("e0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("e1").bitwiseXOR(F.col("t1"))) <= F.col("es") + F.col("ts") - 2 * need)
    met = durable(met.select("eval_no", "train_no").distinct())
    few = met.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    asked = met.select(F.explode(F.array("eval_no", "train_no")).alias("no")).distinct()
    wanted = durable(numbered.select("no", "id", "g", "tokens").join(F.broadcast(asked) if few else asked, "no"))
    side = lambda name: wanted.select(*[F.col(c).alias(f"{name}_{c}") for c in ("no", "id", "g", "tokens")])
    full = met.join(side("eval"), "eval_no").join(side("train"), "train_no").filter("eval_g = train_g")
    shared = full.withColumn("similarity", F.size(F.array_intersect("eval_tokens", "train_tokens")) / F.greatest(F.size("eval_tokens"), F.size("train_tokens")))
    same = numbered.filter("is_train AND is_eval AND size(tokens) > 0").select(F.col("id").alias("eval_id"), F.col("id").alias("train_id"), F.lit(1.0).alias("similarity"))
    return shared.filter(F.col("similarity") >= agree - 1e-9).select("eval_id", "train_id", "similarity").unionByName(same)


def asked_groups(items: DataFrame, refs: DataFrame) -> DataFrame:
    """What distinct words ask, where a train and another record ask it: load_l1, en_target_word, L1_source_word, g.

    items: load_l1, en_target_word, L1_source_word, is_train. g: L1 of the load, the entry meant by en_target_word and
    the one meant by the first value of L1_source_word; words that mean none ask nothing.
    """
    key = ["load_l1", "en_target_word", "L1_source_word"]
    base = durable(items.filter(~is_missing(F.col("en_target_word")) & F.col("L1_source_word").isNotNull()).groupBy(*key).agg(F.max("is_train").alias("t"), F.min("is_train").alias("e")))
    words = base.select(F.lit("en_target_word").alias("field_name"), F.lit("").alias("l1"), F.col("en_target_word").alias("value")).distinct()
    first = durable(parse_fields(distinct_fields(base, "L1_source_word")).filter(F.size("parts") > 0).select("field", F.get("parts", F.lit(0)).alias("value")))
    sources = base.select("load_l1", F.col("L1_source_word").alias("field")).distinct().join(first, "field").select(F.lit("L1_source_word").alias("field_name"), F.col("load_l1").alias("l1"), "value", "field")
    meant = settle(items.sparkSession, lambda: closest_entries(words.unionByName(sources.select("field_name", "l1", "value").distinct()), refs)).filter("ref_id > 0")
    word_ref = meant.filter("field_name = 'en_target_word'").select(F.col("value").alias("en_target_word"), F.col("ref_id").alias("word_ref"))
    source_ref = sources.join(meant.filter("field_name = 'L1_source_word'"), ["field_name", "l1", "value"]).select(F.col("l1").alias("load_l1"), F.col("field").alias("L1_source_word"), F.col("ref_id").alias("source_ref"))
    asked = durable(base.join(word_ref, "en_target_word").join(source_ref, ["load_l1", "L1_source_word"]).select(*key, "t", "e", F.concat_ws("|", "load_l1", "word_ref", "source_ref").alias("g")))
    both = asked.groupBy("g").agg(F.max("t").alias("t"), F.min("e").alias("e")).filter("t AND NOT e").select("g")
    return asked.select(*key, "g").join(both, "g")


def overlap_classes(items: DataFrame, refs: DataFrame, agree: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Records with the class of equal questions they are in, and the pairs of classes that agree.

    Records: row_id, split, source, id (class), is_train. Pairs: eval_id, train_id, similarity. A question is the L1 of
    the load, the headword and first source word meant, and the context's bag. Records without an entry for either
    word, without context tokens, or of a load without L1 are in no class. Contexts move only to their words' group.
    """
    spark = items.sparkSession

    def grouped() -> DataFrame:
        loads = durable(load_languages(items).select("load_id", F.col("l1").alias("load_l1")))
        base = items.select("row_id", "load_id", "split", "source", "L1_context", "L1_source_word", "en_target_word").filter("L1_context IS NOT NULL AND split IN ('train', 'dev', 'test')")
        base = base.join(F.broadcast(loads) if loads.limit(BROADCAST_LOADS + 1).count() <= BROADCAST_LOADS else loads, "load_id").drop("load_id").withColumn("is_train", F.col("split") == "train")
        groups = settle(spark, lambda: asked_groups(base, refs))
        rows = spread(base.join(groups, ["load_l1", "en_target_word", "L1_source_word"]).drop("en_target_word", "L1_source_word"), "row_id").withColumn("tokens", bag(F.col("L1_context"), F.col("load_l1")))
        return rows.withColumn("id", F.md5(F.concat_ws("\x02", "g", F.array_join("tokens", "\x03")))).select("row_id", "split", "source", "g", "load_l1", "is_train", "tokens", "id")

    # the filter follows the written table: before it, it would be pushed below the exchange and make every bag twice
    rows = settle(spark, grouped).filter(F.size("tokens") > 0)
    bags = spread(rows, "id").groupBy("id").agg(F.first("g").alias("g"), F.first("load_l1").alias("language"), F.first("tokens").alias("tokens"), F.max("is_train").alias("is_train"), (~F.min("is_train")).alias("is_eval"))
    return rows.select("row_id", "split", "source", "id", "is_train"), settle(spark, lambda: near_pairs(bags, agree))


def cross_split_pairs(items: DataFrame, refs: DataFrame, agree: float = 0.85) -> DataFrame:
    """Pairs of a train record and a dev or test record that ask the same: train_row, eval_row, split, source, similarity.

    The classes' pairs (see overlap_classes()) unfolded to their records.
    """
    rows, pairs = overlap_classes(items, refs, agree)
    train = rows.filter("is_train").select(F.col("id").alias("train_id"), F.col("row_id").alias("train_row"))
    held = rows.filter("NOT is_train").select(F.col("id").alias("eval_id"), F.col("row_id").alias("eval_row"), "split", "source")
    return pairs.join(train, "train_id").join(held, "eval_id").select("train_row", "eval_row", "split", "source", "similarity")


def overlap_report(items: DataFrame, refs: DataFrame, agree: float = 0.85) -> DataFrame:
    """Leaks per split and source of the evaluation records: split, source, n_pairs, n_records (those in a pair).

    Counted on classes: a class pair weighs its records' numbers, no pair of records is made.
    """
    rows, pairs = overlap_classes(items, refs, agree)
    sizes = rows.filter("is_train").groupBy(F.col("id").alias("train_id")).agg(F.count("*").alias("n"))
    hits = pairs.join(sizes, "train_id").groupBy("eval_id").agg(F.sum("n").alias("n"))
    held = rows.filter("NOT is_train").groupBy(F.col("id").alias("eval_id"), "split", "source").agg(F.count("*").alias("k"))
    return held.join(hits, "eval_id").groupBy("split", "source").agg(F.sum(F.col("k") * F.col("n")).alias("n_pairs"), F.sum("k").alias("n_records"))
