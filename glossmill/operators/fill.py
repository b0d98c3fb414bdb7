"""Filling missing values from the records they depend on.

1. Mine functional dependencies: over complete records, how surely does each candidate
   determinant fix the target (share of records that agree with their determinant's majority)?
   All candidates of all targets are counted in one scan and one aggregate.
2. Verified ones give a dictionary determinant value -> target value.
3. Missing values are left-joined to the dictionaries of all verified dependencies in order of
   preference; what they leave open takes the majority of a fallback group. Provenance says which.

Every count is a partially aggregated groupBy, so a determinant value that holds a third of all
rows is combined map-side; dictionary joins are left to adaptive execution, which broadcasts a
dictionary only at its measured size and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.spelling import deletions, edit_distance
from glossmill.functions.text import is_missing, strip
from glossmill.functions.vocabulary import entry_keys, typed_keys
from glossmill.session import durable


def meant_tags(values: DataFrame, refs: DataFrame, least: int = 4) -> DataFrame:
    """Distinct typed values with the reference entry each means (ref_id, canonical; NULL if none).

    values: columns field_name, l1, value. A value means an entry if a key of it equals a key of
    the entry or, from `least` letters on, lies one edit away. Equi-joins on one-letter deletions
    find the latter; ties go to the earlier key, then the smallest ref_id.
    """
    entries = entry_keys(refs)
    typed = values.select("field_name", "l1", "value", F.posexplode(typed_keys(F.col("value"))).alias("rank", "typed"))
    near = lambda c: F.when(F.length(c) >= least - 1, deletions(c)).otherwise(F.array(c))
    a = typed.withColumn("cut", F.explode(near(F.col("typed"))))
    b = entries.withColumn("cut", F.explode(near(F.col("key"))))
    found = a.join(b, ["field_name", "l1", "cut"]).withColumn("edits", F.when(F.col("typed") == F.col("key"), 0).otherwise(edit_distance(F.col("typed"), F.col("key"))))
    found = found.filter((F.col("edits") == 0) | ((F.col("edits") == 1) & (F.length("key") >= least)))
    best = found.groupBy("field_name", "l1", "value").agg(F.min(F.struct("edits", "rank", "ref_id", "canonical")).alias("m"))
    return values.join(best, ["field_name", "l1", "value"], "left").select(*values.columns, "m.ref_id", "m.canonical")


def majority(rows: DataFrame, determinants: Sequence[str], target: str) -> DataFrame:
    """Determinant value -> its most frequent target (ties: smallest), with `n` records and `agree` of them."""
    counted = rows.groupBy(*determinants, target).agg(F.count("*").alias("c"))
    top = counted.groupBy(*determinants).agg(F.sum("c").alias("n"), F.max("c").alias("agree"), F.min(F.struct((-F.col("c")).alias("c"), F.col(target).alias("v"))).alias("m"))
    return top.select(*determinants, F.col("m.v").alias(target), "n", "agree")


@dataclass(frozen=True)
class Target:
    """A column to fill: `determinants` in order of preference, `fallback` groups, and how its stated values read.

    raw: what is counted (default: the column). understood: maps the distinct raw values, a table with the one
    column raw, to a table (raw, stated); raw values it leaves out count as not stated. valid: per determinant,
    which of its values identify something (others determine nothing).
    """

    column: str
    determinants: Sequence[str]
    fallback: Sequence[str] = ()
    raw: Column | None = None
    understood: Callable[[DataFrame], DataFrame] | None = None
    valid: Mapping[str, Column] = field(default_factory=dict)

    def of(self, determinant: str) -> Column:
        """The determinant's value where it identifies something, as text."""
        return F.when(self.valid.get(determinant, F.lit(True)), F.col(determinant).cast("string"))


def determinant_counts(rows: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """Records per target, determinant, its value and the stated value, for all candidate dependencies of all targets.

    One scan and one aggregate: every row gives a short pair per candidate, combined map-side before the shuffle.
    The stated values are read on their distinct raw forms afterwards. The result is a written table.
    """
    pairs = []
    for i, t in enumerate(targets):
        raw = (F.col(t.column) if t.raw is None else t.raw).cast("string")
        stated = F.when(~is_missing(raw), raw)
        pairs += [F.struct(F.lit(i).alias("target"), F.lit(d).alias("determinant"), t.of(d).alias("value"), stated.alias("raw")) for d in dict.fromkeys([*t.determinants, *t.fallback])]
    long = rows.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").filter("value IS NOT NULL AND raw IS NOT NULL")
    counted = durable(long.groupBy("target", "determinant", "value", "raw").agg(F.count("*").alias("c")))
    read = None
    for i, t in enumerate(targets):
        own = counted.filter(F.col("target") == i).select("raw").distinct()
        known = (t.understood(own) if t.understood else own.withColumn("stated", F.col("raw"))).select(F.lit(i).alias("target"), "raw", "stated")
        read = known if read is None else read.unionByName(known)
    return durable(counted.join(read.filter("stated IS NOT NULL"), ["target", "raw"]).groupBy("target", "determinant", "value", "stated").agg(F.sum("c").alias("c")))


def dictionaries(counts: DataFrame) -> DataFrame:
    """Every determinant value's most frequent stated value (ties: smallest), with `n` records and `agree` of them."""
    key = ["target", "determinant", "value"]
    top = counts.groupBy(*key).agg(F.sum("c").alias("n"), F.max("c").alias("agree"), F.min(F.struct((-F.col("c")).alias("c"), F.col("stated").alias("v"))).alias("m"))
    return durable(top.select(*key, F.col("m.v").alias("stated"), "n", "agree"))


def mine_dependencies(books: DataFrame) -> DataFrame:
    """target, determinant, n, confidence of each candidate: the share of records that agree with their dictionary.

    Only determinant values with at least two records count: one record agrees with itself. Candidates without
    such values are absent.
    """
    return books.filter("n >= 2").groupBy("target", "determinant").agg(F.sum("n").alias("n"), (F.sum("agree") / F.sum("n")).alias("confidence"))


def fill_missing(rows: DataFrame, targets: Sequence[Target], keys: Sequence[str], verified: float = 0.9, pure: float = 0.6) -> DataFrame:
    """Missing values of the targets' columns: keys, field_name, fill_value, provenance.

    Dependencies of a confidence of `verified` or more are verified; all of them serve, in the order their target
    names them, and a dictionary entry must hold the share `pure` of its records. What they leave open takes the
    majority of the first fallback group that has one. provenance is 'dependency:<determinant>',
    'group:<fallback>' or 'none' (fill_value NULL). Values missing by is_missing() come out, each row of repeated
    ones too; no row is dropped. Empty input, empty result. Names of the keys must differ from the result's.
    """
    books = dictionaries(determinant_counts(rows, targets))
    found = {(r.target, r.determinant): r.confidence for r in mine_dependencies(books).collect()}  # a row per candidate
    plans = []
    for i, t in enumerate(targets):
        sure = [(d, f"dependency:{d}", pure) for d in t.determinants if found.get((i, d), 0.0) >= verified]
        plans.append(sure + [(f, f"group:{f}", 0.0) for f in t.fallback])
    open_fields = []
    for i, (t, plan) in enumerate(zip(targets, plans)):
        tries = F.array(*[F.struct(F.lit(d).alias("determinant"), t.of(d).alias("value"), F.lit(p).alias("provenance"), F.lit(least).alias("least")) for d, p, least in plan]) if plan else F.array().cast("array<struct<determinant:string,value:string,provenance:string,least:double>>")
        open_fields.append(F.when(is_missing(F.col(t.column).cast("string")), F.struct(F.lit(i).alias("target"), F.lit(t.column).alias("field_name"), tries.alias("tries"))))
    out = rows.select(*keys, F.explode(F.array_compact(F.array(*open_fields))).alias("_o")).select(*keys, "_o.*")
    entries = books.select("target", "determinant", "value", "stated", (F.col("agree") / F.col("n")).alias("share"))
    fills = []
    for k in range(max(map(len, plans), default=0)):
        own = entries.withColumnsRenamed({"determinant": "_d", "value": "_v", "stated": f"_s{k}", "share": f"_p{k}"})
        step = out.withColumns({"_d": F.get("tries", F.lit(k))["determinant"], "_v": F.get("tries", F.lit(k))["value"]})
        out = step.join(own, ["target", "_d", "_v"], "left").drop("_d", "_v")
        good = F.col(f"_p{k}") >= F.get("tries", F.lit(k))["least"] - 1e-12
        fills.append(F.when(good, F.struct(F.col(f"_s{k}").alias("v"), F.get("tries", F.lit(k))["provenance"].alias("p"))))
    best = F.coalesce(*fills, F.struct(F.lit(None).cast("string").alias("v"), F.lit("none").alias("p")))
    return out.select(*keys, "field_name", best["v"].alias("fill_value"), best["p"].alias("provenance"))


def stated_language(c: Column, languages: Sequence[str] = ("es", "de", "cn")) -> Column:
    """The language that a value states, NULL if it states none of them."""
    return F.when(F.lower(strip(c)).isin(*languages), F.lower(strip(c)))


def load_languages(items: DataFrame, languages: Sequence[str] = ("es", "de", "cn")) -> DataFrame:
    """load_id -> l1: the L1 that most of a load's records state; loads whose records state none are absent."""
    stated = items.select("load_id", stated_language(F.col("L1"), languages).alias("l1")).filter("l1 is not null and load_id is not null")
    return majority(stated, ["load_id"], "l1").select("load_id", "l1")


def fill_items(items: DataFrame, refs: DataFrame) -> DataFrame:
    """Fills for L1 (determined by the load) and en_target_pos (by the item): row_id, field_name, fill_value, provenance."""

    def tags(raw: DataFrame) -> DataFrame:
        typed = raw.select(F.lit("en_target_pos").alias("field_name"), F.lit("").alias("l1"), F.col("raw").alias("value"))
        return meant_tags(typed, refs.filter("field_name = 'en_target_pos'")).select(F.col("value").alias("raw"), F.col("canonical").alias("stated"))

    languages = lambda raw: raw.withColumn("stated", stated_language(F.col("raw")))
    real = (F.col("item_id") > 0) & (F.col("item_id") < 999_999_999)  # 0, -1 and all nines stand for no item
    by_load = Target("L1", ["load_id", "source", "split"], ["source"], understood=languages)
    by_item = Target("en_target_pos", ["item_id", "en_target_clue", "load_id"], ["en_target_word"], understood=tags, valid={"item_id": real})
    return fill_missing(items, [by_load, by_item], ["row_id"])
