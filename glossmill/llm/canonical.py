"""Mapping free-entered values to a canonical list by a prefix-filter set-similarity join.

Values and entries become sets of numbered, padded character bigrams. Tokens are ordered by global
rarity (counts over all distinct keys); two sets that share enough tokens must share one of the
rarest few of each, so only those prefixes are joined, within one field and language. Length and
positional filters thin the candidates, Jaccard is verified exactly, an exact one-edit check follows
and the best entry is kept.

How many tokens must be shared: one typing error (a letter left out, added, replaced, or two swapped)
changes at most `slack` = 3 padded bigrams, so sets of a and b tokens share at least max(a, b) - 3,
a Jaccard of (max - 3) / (max + 3) or more. The prefix then has 4 tokens whatever the length.

The list is looked up, not moved against: its postings carry the length in their key and are broadcast
where their number is checked, so the words stay spread over all cores by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.spelling import bigrams, edit_distance
from glossmill.functions.text import is_missing
from glossmill.functions.vocabulary import entry_keys, typed_keys
from glossmill.operators.delimited import parse_fields
from glossmill.operators.fill import load_languages
from glossmill.session import durable, spread

SLACK = 3
GROUP = ["field_name", "l1"]
#: Entry keys and tokens up to these numbers are broadcast (each about 30 MB at most); larger tables join by shuffles.
BROADCAST_KEYS, BROADCAST_TOKENS = 100_000, 400_000


def near_length(key: Column) -> Column:
    """Letters that an entry must have for a typing error to be told from another entry: 3, and 4 of Chinese."""
    return F.when(key.rlike("\\p{IsHan}"), 4).otherwise(3)


def _prefixes(keyed: DataFrame, counts: DataFrame, small: bool, key: str, length: Column) -> DataFrame:
    """Rarest tokens of every key with their positions and the key's number of tokens: GROUP, key, m, at, token.

    keyed: GROUP, key, grams. length: how many tokens the prefix has. Keys are spread before their tokens come
    out, so with broadcast counts the tokens are never shuffled.
    """
    tokens = spread(keyed, *GROUP, key).select(*GROUP, key, F.explode("grams").alias("token"))
    ranked = tokens.join(F.broadcast(counts) if small else counts, [*GROUP, "token"])
    rare = ranked.groupBy(*GROUP, key).agg(F.count("*").cast("int").alias("m"), F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("p")).withColumn("p", F.slice("p", F.lit(1), length))
    return rare.select(*GROUP, key, "m", F.posexplode("p").alias("at", "t")).select(*GROUP, key, "m", (F.col("at") + 1).alias("at"), F.col("t.token").alias("token"))


def closest_entries(values: DataFrame, refs: DataFrame) -> DataFrame:
    """The entry each distinct typed value means: values' columns, ref_id (0 if none), canonical, similarity.

    values: distinct rows of field_name, l1 ('' where entries have none), value. refs: ref_id, field_name,
    L1, canonical, aliases. Near matches need entries of near_length() letters or more: shorter ones differ
    from each other by one letter. Values without letters mean nothing. Ties: fewer edits, earlier key,
    higher Jaccard, smaller ref_id. Values longer than any entry can't be near one and leave early.
    """
    values = durable(values)
    entries = durable(entry_keys(refs).withColumns({"size": F.length("key"), "near": F.length("key") >= near_length(F.col("key"))}))
    few = entries.count() <= BROADCAST_KEYS
    small = F.broadcast if few else (lambda df: df)
    typed = spread(values, *GROUP, "value").select(*GROUP, "value", F.posexplode(typed_keys(F.col("value"))).alias("rank", "typed"))
    longest = entries.groupBy(*GROUP).agg((F.max("size") + 1).alias("longest"))
    typed = durable(typed.join(F.broadcast(longest), GROUP).filter(F.length("typed") <= F.col("longest")).drop("longest"))  # a row per field and language of the list
    words = durable(typed.select(*GROUP, F.col("typed").alias("word")).distinct().withColumn("grams", bigrams(F.col("word"))))
    listed = entries.select(*GROUP, "key", "near", bigrams(F.col("key")).alias("grams"))

    tokens = words.select(*GROUP, F.explode("grams").alias("token")).unionByName(listed.select(*GROUP, F.explode("grams").alias("token")))
    counts = durable(tokens.groupBy(*GROUP, "token").agg(F.count("*").alias("freq")))
    known = counts.count() <= BROADCAST_TOKENS
    a = _prefixes(words.select(*GROUP, "word", "grams"), counts, known, "word", F.lit(SLACK + 1)).withColumnsRenamed({"m": "a", "at": "i"})
    b = _prefixes(listed.select(*GROUP, "key", "grams"), counts, known, "key", F.when(F.length("key") >= near_length(F.col("key")), SLACK + 1).otherwise(1)).withColumnsRenamed({"m": "b", "at": "j"})

    # one edit changes the number of tokens by one at most: entries stand under three lengths, so the length is part of the key
    posted = durable(b.select(*GROUP, "key", "b", "j", "token", F.explode(F.array(*[F.col("b") + d for d in (-1, 0, 1)])).alias("a")))
    enough = F.when(F.length("key") >= near_length(F.col("key")), F.greatest("a", "b") - SLACK).otherwise(F.greatest("a", "b"))  # short entries: equality
    pairs = a.join(small(posted), [*GROUP, "token", "a"])
    pairs = pairs.filter(F.least("i", "j") + F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j")) >= enough)  # positional filter
    pairs = pairs.select(*GROUP, "word", "key", "a", "b").distinct()
    shared = F.size(F.array_intersect(bigrams(F.col("word")), bigrams(F.col("key"))))
    near = pairs.withColumn("shared", shared).filter(F.col("shared") >= F.greatest(enough, F.lit(1)))
    near = near.withColumn("similarity", F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")))
    near = near.withColumn("edits", F.when(F.col("word") == F.col("key"), 0).otherwise(edit_distance(F.col("word"), F.col("key"))))
    near = near.filter((F.col("edits") == 0) | ((F.col("edits") == 1) & (F.length("key") >= near_length(F.col("key")))))

    scored = near.join(small(entries.select(*GROUP, "key", "ref_id", "canonical")), [*GROUP, "key"]).withColumnRenamed("word", "typed").join(typed, [*GROUP, "typed"])
    best = scored.groupBy(*GROUP, "value").agg(F.min(F.struct("edits", "rank", (-F.col("similarity")).alias("s"), "ref_id", "canonical")).alias("m"))
    return values.join(best, [*GROUP, "value"], "left").select(*values.columns, F.coalesce("m.ref_id", F.lit(0)).cast("bigint").alias("ref_id"), "m.canonical", (-F.col("m.s")).alias("similarity"))


def with_language(items: DataFrame) -> DataFrame:
    """items with load_l1, the L1 of the load; records whose load states none get NULL."""
    return items.join(load_languages(items).withColumnRenamed("l1", "load_l1"), "load_id", "left")


def mapped_fields(items: DataFrame, refs: DataFrame) -> DataFrame:
    """Every stated value of the three fields by row: row_id, field_name, l1, value, ref_id, exact.

    A source field with several values or a parenthesised note is left out. `exact`: the value is a
    canonical entry as it stands. Values are resolved once each; rows then look their value up.
    """
    known = with_language(items.select("row_id", "load_id", "L1", "L1_source_word", "en_target_word", "en_target_pos"))
    long = known.select(
        "row_id",
        F.explode(
            F.array(
                F.struct(F.lit("en_target_word").alias("field_name"), F.lit("").alias("l1"), F.col("en_target_word").alias("value")),
                F.struct(F.lit("en_target_pos").alias("field_name"), F.lit("").alias("l1"), F.col("en_target_pos").alias("value")),
                F.struct(F.lit("L1_source_word").alias("field_name"), F.col("load_l1").alias("l1"), F.col("L1_source_word").alias("value")),
            )
        ).alias("x"),
    ).select("row_id", "x.*")
    stated = long.filter(~is_missing(F.col("value")))
    distinct = durable(stated.groupBy(*GROUP, "value").agg(F.count("*").alias("n")))
    sources = distinct.filter("field_name = 'L1_source_word'").groupBy(F.col("value").alias("field")).agg(F.sum("n").alias("n"))
    packed = parse_fields(sources).filter((F.size("parts") > 1) | F.col("has_note")).select(F.lit("L1_source_word").alias("field_name"), F.col("field").alias("value"))
    single = durable(distinct.drop("n").join(packed, ["field_name", "value"], "left_anti").filter("l1 IS NOT NULL").select(*GROUP, "value"))
    canonical = refs.select("field_name", F.coalesce("L1", F.lit("")).alias("l1"), F.col("canonical").alias("value"), F.lit(True).alias("is_entry")).distinct()
    meant = closest_entries(single, refs).join(canonical, [*GROUP, "value"], "left")
    meant = durable(meant.select(*GROUP, "value", "ref_id", "canonical", F.coalesce("is_entry", F.lit(False)).alias("exact")))
    return stated.join(meant, [*GROUP, "value"])
