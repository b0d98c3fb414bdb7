"""Queries of the llm operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import is_missing
from glossmill.llm.canonical import closest_entries, mapped_fields, with_language
from glossmill.llm.leaks import leaked
from glossmill.llm.lookalike import consistent_values
from glossmill.llm.overlap import cross_split_pairs, overlap_report
from glossmill.llm.packing import pack, packing_report
from glossmill.llm.sentences import split_sentences
from glossmill.llm.splits import read_components, update
from glossmill.session import durable, scratch_path
from glossmill.sources.tables import table

TEXT_FIELDS = ["L1_context", "L1_source_word", "en_target_word"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a train and a dev or test record that ask the same."""
    pairs = cross_split_pairs(table(spark, folder, "items"), table(spark, folder, "ref_values"))
    return pairs.select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked evaluation records and pairs per split and source."""
    return overlap_report(table(spark, folder, "items"), table(spark, folder, "ref_values"))


#: Batches in which the loads' records come, in order of delivery.
BATCHES = 2


def _component_table(spark: SparkSession, folder: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The component table over spellings and headwords of each L1, and the records: row_id, l1, split, canonical, node.

    Loads come in BATCHES by delivery; each is an update of the table at `path` (a fresh one if None). A record whose
    word is missing, or whose load states no L1, hangs together with nothing: its node is its own.
    """
    path = path or scratch_path(spark, "components")
    items, loads = table(spark, folder, "items"), table(spark, folder, "loads")
    when = F.unix_micros(F.col("delivered_at").cast("timestamp"))
    cuts = loads.agg(F.percentile_approx(when, [i / BATCHES for i in range(1, BATCHES)], 10_000).alias("c")).first().c or []
    at = loads.select("load_id", sum((F.when(when > c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("batch"))
    rows = with_language(items.select("row_id", "load_id", "L1", "split", "en_target_word")).join(at, "load_id", "left")
    word = F.when(F.col("load_l1").isNotNull() & ~is_missing(F.col("en_target_word")), F.col("en_target_word"))
    rows = durable(rows.select("row_id", F.col("load_l1").alias("l1"), "split", word.alias("value"), F.coalesce("batch", F.lit(0)).alias("batch")))
    words = rows.filter("value IS NOT NULL").select(F.lit("en_target_word").alias("field_name"), F.lit("").alias("l1"), "value").distinct()
    meant = durable(closest_entries(words, table(spark, folder, "ref_values")).select("value", "canonical"))
    node = F.when(F.col("value").isNotNull(), F.concat_ws("|", F.lit("w"), "l1", "value")).otherwise(F.concat_ws("|", F.lit("r"), "row_id"))
    records = durable(rows.join(meant, "value", "left").select("row_id", "l1", "split", "canonical", "batch", node.alias("node")))
    for b in range(BATCHES):
        nodes = durable(records.filter(F.col("batch") == b).groupBy("node", "l1", "canonical").agg(F.count("*").alias("n")))
        edges = nodes.filter("canonical IS NOT NULL").select(F.col("node").alias("a"), F.concat_ws("|", F.lit("h"), "l1", "canonical").alias("b"))
        update(spark, path, b, edges, nodes.select("node", "n"))
    return read_components(spark, path, BATCHES), records


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Headwords of an L1 whose records the delivered split tears apart."""
    found, records = _component_table(spark, folder)
    counted = records.filter("canonical IS NOT NULL").groupBy("node", "l1", "canonical", "split").agg(F.count("*").alias("n"))
    placed = counted.join(found.select("node", "component"), "node")
    torn = placed.groupBy("component").agg(F.countDistinct("split").alias("splits"), F.first("l1").alias("l1"), F.max("canonical").alias("headword"))
    return torn.filter("splits > 1").select("l1", "headword")


def p3_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """The split assigned to every record, with its component, the component's rows and whether splits met in it."""
    found, records = _component_table(spark, folder)
    return records.select("row_id", "node", F.col("split").alias("delivered_split")).join(found, "node").select("row_id", "component", "n", "split", "conflict", "delivered_split")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records and fields whose text differs from its consistent form."""
    return consistent_values(table(spark, folder, "items"), TEXT_FIELDS, ["row_id"]).filter("changed").select("row_id", "field_name")


def p4_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every field that isn't NULL."""
    return consistent_values(table(spark, folder, "items"), TEXT_FIELDS, ["row_id"], every=True).select("row_id", "field_name", "consistent", "changed")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every freely typed value with the reference entry it means, 0 if none."""
    found = mapped_fields(table(spark, folder, "items"), table(spark, folder, "ref_values"))
    return found.filter("NOT exact").select("row_id", "field_name", "ref_id")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container and place of every document in containers of 2,048 tokens."""
    return pack(table(spark, folder, "documents").select("doc_id", "text", "n_tokens"))


def p8_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Windows, tokens and unused share per tier, and containers over all."""
    return packing_report(pack(table(spark, folder, "documents").select("doc_id", "text", "n_tokens")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a run of a held-out passage."""
    return leaked(table(spark, folder, "documents"), table(spark, folder, "heldout_passages"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every document."""
    return split_sentences(table(spark, folder, "documents"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_assignment": p3_assignment, "p4_found": p4_found, "p4_consistent": p4_consistent, "p7_found": p7_found, "p8_containers": p8_containers, "p8_summary": p8_summary, "p9_found": p9_found, "p10_found": p10_found}
ORACLE: dict[str, str] = {}
