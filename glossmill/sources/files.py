"""Delimited files, edge lists, lexicons, embeddings and result folders as plans over Spark readers and writers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators.checks import ConfigError, DataError

SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}
EDGE_COLUMNS = ("concept_id", "lang_1", "word_1", "lang_2", "word_2", "translit_1", "translit_2")
# Accepted column names of a cognate lexicon.
LEXICON_PAIRS = (("word 1", "word 2"), ("source_word", "target_word"), ("l1_word", "en_word"))
LEXICON_SCORES = ("cognate_sim", "score", "similarity")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Table by suffix: CSV, TSV, TXT (tab) or Parquet; other suffixes raise. Quoted line breaks are read."""
    suffix = path[path.rfind(".") :].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix not in SEPARATORS:
        raise ConfigError("unsupported table suffix", path=path)
    reader = spark.read.option("header", True).option("sep", SEPARATORS[suffix]).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def write_table(df: DataFrame, path: str, suffix: str = ".parquet") -> None:
    """Table as Parquet or CSV with header, replacing what is there."""
    if suffix == ".parquet":
        df.write.mode("overwrite").parquet(path)
    elif suffix == ".csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        raise ConfigError("unsupported table suffix", suffix=suffix)


def read_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edge list from unquoted TSV: good rows by its first seven columns, and lines that don't parse."""
    text = spark.read.text(path)
    cells = text.select("value", F.split("value", "\t").alias("c"))
    good = cells.filter(F.size("c") >= len(EDGE_COLUMNS)).select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(EDGE_COLUMNS)]).filter("concept_id <> 'concept_id'")
    return good, cells.filter(F.size("c") < len(EDGE_COLUMNS)).select("value")


def read_cognate_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon of word pairs with a score (1 where none): the separator is the one its header holds most."""
    head = spark.read.text(path).first()
    if head is None:
        raise DataError("empty lexicon", path=path)
    sep = max((";", "\t", "|", ","), key=head.value.count)
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    names = {c.strip().lower(): c for c in df.columns}
    pair = next((p for p in LEXICON_PAIRS if all(x in names for x in p)), None)
    if pair is None:
        raise DataError("no known pair of word columns", columns=df.columns)
    score = next((F.expr(f"try_cast(`{names[s]}` AS DOUBLE)") for s in LEXICON_SCORES if s in names), F.lit(1.0))
    return df.select(F.lower(F.trim(F.col(f"`{names[pair[0]]}`"))).alias("source"), F.lower(F.trim(F.col(f"`{names[pair[1]]}`"))).alias("target"), F.coalesce(score, F.lit(1.0)).alias("score"))


def symmetric_scores(pairs: DataFrame, lexicon: DataFrame, source: str, target: str) -> DataFrame:
    """Pairs with the lexicon's score for (source, target), else for the swapped pair, else NULL."""
    both = lexicon.select("source", "target", "score", F.lit(0).alias("way")).unionByName(lexicon.select(F.col("target").alias("source"), F.col("source").alias("target"), "score", F.lit(1).alias("way")))
    best = both.groupBy("source", "target").agg(F.min_by("score", F.struct("way", -F.col("score"))).alias("lexicon_score"))
    return pairs.join(best.withColumnsRenamed({"source": source, "target": target}), [source, target], "left")


def write_submission(df: DataFrame, key: str, prediction: str, path: str) -> None:
    """Exactly (key, prediction) as CSV; reads the header back and raises if it differs."""
    df.select(key, F.col(prediction).alias("prediction")).write.mode("overwrite").option("header", True).csv(path)
    found = df.sparkSession.read.option("header", True).csv(path).columns
    if found != [key, "prediction"]:
        raise DataError("submission header differs", found=found)


def write_frames(frames: dict[str, DataFrame], folder: str, wanted: Sequence[str] | None = None) -> list[str]:
    """Named results as Parquet folders; returns the names written."""
    names = [n for n in frames if wanted is None or n in wanted]
    for n in names:
        frames[n].write.mode("overwrite").parquet(f"{folder}/{n}")
    return names


def read_frames(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Those of the named results that exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = {}
    for n in names:
        p = hadoop.Path(f"{folder}/{n}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            out[n] = spark.read.parquet(f"{folder}/{n}")
    return out


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of a that b has too, in a's order."""
    return [c for c in a.columns if c in b.columns]


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both on their common columns."""
    names = common_columns(a, b)
    return a.select(*names).unionByName(b.select(*names))


def manifest(frames: dict[str, DataFrame]) -> str:
    """Column names and types of named frames as JSON, from their schemas alone."""
    return json.dumps({n: dict(f.dtypes) for n, f in frames.items()})
