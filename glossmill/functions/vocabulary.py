"""Keys under which freely typed values and reference entries meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import all_latin, bare_letters, consistent, fold_case, let, simplify_han

# Articles and particles that do not change what a word means.
ARTICLES = ("a", "an", "the", "to", "el", "la", "los", "las", "lo", "un", "una", "unos", "unas", "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "zu")
HAN_PARTICLES = "的了着过"


def typed_keys(value: Column) -> Column:
    """Keys of a typed value, best first: as written, without article or particle, without note, before a comma."""
    def keys(folded: Column) -> Column:
        whole = letters_of(folded)
        no_article = letters_of(F.regexp_replace(folded, f"^[^\\p{{L}}]*(?:{'|'.join(ARTICLES)})[\\s\\p{{Z}}]+(?=.*\\p{{L}})", ""))
        no_particle = F.regexp_replace(whole, f"(?<=\\p{{IsHan}})[{HAN_PARTICLES}]$", "")
        no_note = letters_of(F.regexp_replace(folded, "[(（\\[][^)）\\]]*[)）\\]]", ""))
        before_comma = letters_of(F.regexp_extract(folded, "^([^,;，；]*)", 1))
        return F.filter(F.array_distinct(F.array(whole, no_article, no_particle, no_note, before_comma)), lambda k: k != "")

    return let(fold_case(all_latin(consistent(value))), keys)


def letters_of(folded: Column) -> Column:
    """Letters of folded text, Chinese ones simplified."""
    return simplify_han(F.regexp_replace(folded, "[^\\p{L}]+", ""))


def entry_keys(refs: DataFrame) -> DataFrame:
    """Reference entries and their aliases by key: field_name, l1, key, ref_id, canonical.

    Aliases are a '|'-list; a key that several entries share goes to the smallest ref_id
    whose canonical spelling has it, before any alias.
    """
    names = F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("canonical").alias("name"))), F.transform(F.split(F.coalesce("aliases", F.lit("")), "\\|"), lambda a: F.struct(F.lit(1).alias("rank"), a.alias("name"))))
    spelled = refs.select("field_name", F.coalesce("L1", F.lit("")).alias("l1"), "ref_id", "canonical", F.explode(names).alias("n"))
    unmarked = lambda k: F.array_distinct(F.array(k, F.translate(F.replace(F.replace(F.replace(k, F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue")), "áéíóúñ", "aeioun")))
    keyed = spelled.select("*", F.posexplode(let(simplify_han(bare_letters(F.col("n.name"))), unmarked)).alias("spelled", "key")).filter("key <> ''")
    return keyed.groupBy("field_name", "l1", "key").agg(F.min(F.struct("spelled", "n.rank", "ref_id", "canonical")).alias("e")).select("field_name", "l1", "key", "e.ref_id", "e.canonical")
