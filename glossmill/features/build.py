"""Feature orchestration: a registry of groups folded over an item table, with guards and a catalog of what they added."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.features.frequency import frequency_group
from glossmill.features.language import clue_predictions, language_group, word_scores
from glossmill.features.lexical import lexical_group
from glossmill.features.retrieval import baseline_columns, retrieval_columns, semantic_columns
from glossmill.functions.similarity import cognate_columns
from glossmill.operators.checks import ConfigError, FeatureError
from glossmill.operators.concepts import ask, match_concepts
from glossmill.session import bounded, durable

PROTECTED = ("item_id", "L1", "L1_context", "L1_source_word", "en_target_word", "en_target_pos", "GLMM_score")


@dataclass
class Resources:
    """Side tables of the groups; `corpus` is a token_frequencies() table."""

    lexicon: DataFrame
    corpus: DataFrame
    edges: DataFrame
    key: str = "row_id"
    extra: dict = field(default_factory=dict)


#: Where a build keeps the words' scores in Resources.extra.
SCORES = "word_scores"
Group = Callable[[DataFrame, Resources], DataFrame]
REGISTRY: dict[str, Group] = {}


def group(name: str) -> Callable[[Group], Group]:
    """Register a feature group."""

    def add(f: Group) -> Group:
        REGISTRY[name] = f
        return f

    return add


@group("frequency")
def _frequency(df: DataFrame, r: Resources) -> DataFrame:
    return frequency_group(df, r.lexicon, r.corpus)


@group("lexical")
def _lexical(df: DataFrame, r: Resources) -> DataFrame:
    return lexical_group(df)


def _scores(df: DataFrame, r: Resources) -> DataFrame:
    """Scores of the words, made once for the groups of a build."""
    if SCORES not in r.extra:
        r.extra[SCORES] = word_scores(df, r.corpus)
    return r.extra[SCORES]


@group("mlm")
def _mlm(df: DataFrame, r: Resources) -> DataFrame:
    return language_group(df, r.corpus, scores=_scores(df, r), columns=("mlm_log_prob", "mlm_rank", "mlm_entropy"))


@group("surprisal")
def _surprisal(df: DataFrame, r: Resources) -> DataFrame:
    return language_group(df, r.corpus, scores=_scores(df, r), columns=("surprisal_masked", "surprisal_pll", "surprisal_subword_mean", "surprisal_subword_sum"))


@group("retrieval")
def _retrieval(df: DataFrame, r: Resources) -> DataFrame:
    return df.withColumns(retrieval_columns(F.col("en_target_word"), F.col("en_target_clue"), F.col("L1_context")))


@group("cognate")
def _cognate(df: DataFrame, r: Resources) -> DataFrame:
    m = match_concepts(ask(df, r.edges, r.key, "L1", F.col("L1_source_word"), F.col("en_target_word"))).select(r.key, "match_type", F.col("n_shared").alias("_n"))
    out = cognate_columns(df.join(m, r.key, "left"), "L1_source_word", "en_target_word", F.col("match_type"), F.col("_n"))
    parts = F.size(F.split(F.coalesce("L1_source_word", F.lit("")), "[,;|]"))
    note = F.coalesce("L1_source_word", F.lit("")).rlike("(?i)[(（]\\s*(nicht|no|la respuesta no|不)")
    out = out.withColumns({"cognate_source_has_alternative": (parts > 1).cast("int"), "cognate_source_alternative_count": parts - 1, "cognate_source_has_excluded_word": note.cast("int")})
    return out.drop("match_type", "_n", "bigram_jaccard", "lcs_ratio", "prefix_suffix", "char_sim")


@group("semantic")
def _semantic(df: DataFrame, r: Resources) -> DataFrame:
    return df.withColumns(semantic_columns(F.col("L1_source_word"), F.col("en_target_word"), F.col("en_target_clue"), F.col("L1_context")))


@group("mlm_predicted_word")
def _predicted(df: DataFrame, r: Resources) -> DataFrame:
    found = durable(clue_predictions(df, r.corpus, "en_target_clue")).withColumnRenamed("en_target_clue", "_clue")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("mlm_pred_log_prob", "mlm_pred_margin", "mlm_pred_entropy")}
    return df.join(bounded(found), df["en_target_clue"] == found["_clue"], "left").drop("_clue").withColumns(zero | {"mlm_pred_word": F.coalesce("mlm_pred_word", F.lit(""))})


@group("baseline_meta")
def _baseline(df: DataFrame, r: Resources) -> DataFrame:
    return df.withColumns(baseline_columns(F.col("mlm_pred_word"), F.col("en_target_word"), F.col("en_target_clue")))


#: Groups that read the table more than once; it is written before them, so plans don't multiply.
REUSING = ("frequency", "lexical", "mlm", "surprisal", "cognate", "mlm_predicted_word")


def build(items: DataFrame, resources: Resources, groups: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """Fold groups over the items in order; returns the wider table and the columns each group added.

    Row-local groups share one projection. Unknown groups raise; a group that drops a protected column or adds nothing raises.
    """
    catalog: dict[str, list[str]] = {}
    out = items
    resources.corpus = durable(resources.corpus)
    resources.extra.pop(SCORES, None)  # those of other items
    for name in groups or list(REGISTRY):
        if name not in REGISTRY:
            raise ConfigError("unknown feature group", group=name, known=sorted(REGISTRY))
        before = out.columns
        if name in REUSING and catalog:
            out = durable(out)
        out = REGISTRY[name](out, resources)
        lost = [c for c in PROTECTED if c in before and c not in out.columns]
        catalog[name] = [c for c in out.columns if c not in before]
        if lost or not catalog[name]:
            raise FeatureError("bad feature group", group=name, lost=lost, added=catalog[name])
    return out, catalog


def save(df: DataFrame, catalog: dict[str, list[str]], path: str, split: str = "split") -> None:
    """Feature table as Parquet by split, its catalog as one JSON row beside it."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/features")
    body = json.dumps({"feature_columns": [c for g in catalog.values() for c in g], "groups": catalog, "schema": df.schema.jsonValue()})
    df.sparkSession.range(1).select(F.lit(body).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/catalog")


def load(spark, path: str) -> tuple[DataFrame, list[str]]:
    """Feature table and its catalogued columns; raises if the table lacks one."""
    body = json.loads(spark.read.text(f"{path}/catalog").first().value)
    df = spark.read.parquet(f"{path}/features")
    missing = [c for c in body["feature_columns"] if c not in df.columns]
    if missing:
        raise FeatureError("catalogued columns are missing", missing=missing)
    return df, body["feature_columns"]
