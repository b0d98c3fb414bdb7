"""Column-level data quality: declarative checks over one shared aggregate scan per partition.

The scan gives mergeable states (counts, sums, central moments, bounds, sketches): states of partitions
merge into states of any union of them. They are kept in a table, a folder per batch, so a new load costs
one pass over itself and old rows aren't read again. Checks are expressions over merged states; anomaly
tests compare a partition's metrics with control limits of its history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions.text import is_missing
from glossmill.session import scratch_path


@dataclass(frozen=True)
class Check:
    """An issue of a column: a condition over its metrics (and the base's, prefixed base_), where `when` holds."""

    column: str
    issue: str
    condition: str
    when: str = "true"


@dataclass(frozen=True)
class ColumnRule:
    """What counts as a valid value of a column: bounds of numbers, allowed values or a pattern of text; `exact` asks for exact distinct counts.

    distinct_share: a check compares distinct over non-null values with this share; partitions whose sketch comes
    near it are counted exactly.
    """

    column: str
    low: float | None = None
    high: float | None = None
    exact: bool = False
    allowed: tuple[str, ...] = ()
    pattern: str | None = None
    distinct_share: float | None = None


#: A sketch of 2^12 registers errs by 1.6 % (one deviation); counts nearer to a threshold than six of them are made exact.
SKETCH_MARGIN = 0.1


def _value(df: DataFrame, column: str) -> Column:
    """The column with NaN as NULL."""
    kind = dict(df.dtypes)[column]
    return F.when(~F.isnan(column), F.col(column)) if kind in ("double", "float") else F.col(column)


def states(rows: DataFrame, partition: str, columns: Sequence[str], rules: Sequence[ColumnRule] = ()) -> DataFrame:
    """Mergeable state of every column in every partition, from one scan.

    One row per (partition, column_name): n, non_null, total, m2 (squared differences from the mean), low, high (numbers), in_range,
    in_range_total, longest (text only), sketch (distinct values; HyperLogLog, mergeable), first and last (text),
    placeholders (text that stands for a missing value; NULL for other types), broken. NaN counts as NULL; broken
    counts numbers beyond the rule's bounds and text that is a placeholder or neither allowed nor of the pattern, and
    is NULL where the column has no such rule. Empty input, empty result.
    """
    bounds = {r.column: r for r in rules}
    types = dict(rows.dtypes)
    packed = []
    for c in columns:
        v = _value(rows, c)
        numeric = types[c] in ("bigint", "int", "smallint", "tinyint", "double", "float") or types[c].startswith("decimal")
        number = (v if numeric else F.unix_micros(v.cast("timestamp")) / 1e6 if types[c].startswith("timestamp") else F.lit(None)).cast("double")
        rule = bounds.get(c, ColumnRule(c))
        inside = F.lit(True)
        if rule.low is not None:
            inside = inside & (number >= rule.low)
        if rule.high is not None:
            inside = inside & (number <= rule.high)
        kept = F.when(inside & number.isNotNull(), number)
        none = F.lit(None).cast("bigint")
        text = v if types[c] == "string" else F.lit(None).cast("string")
        placeholder = v.isNotNull() & is_missing(v) if types[c] == "string" else F.lit(False)
        wrong = placeholder
        if rule.allowed:
            wrong = wrong | ~v.isin(*rule.allowed)
        if rule.pattern is not None:
            wrong = wrong | ~v.rlike(rule.pattern)
        if types[c] == "string":
            broken = F.count_if(v.isNotNull() & wrong) if rule.allowed or rule.pattern is not None else none
        else:
            broken = F.count_if(number.isNotNull() & ~inside) if rule.low is not None or rule.high is not None else none
        # the sketch ignores empty strings, so every value carries a sign
        packed.append(
            F.struct(
                F.count("*").alias("n"), F.count(v).alias("non_null"), F.sum(number).alias("total"), (F.var_pop(number) * F.count(number)).alias("m2"), F.min(number).alias("low"), F.max(number).alias("high"),
                F.count(kept).alias("in_range"), F.sum(kept).alias("in_range_total"), F.max(F.length(text)).alias("longest"), F.hll_sketch_agg(F.concat(F.lit("="), v.cast("string")), F.lit(12)).alias("sketch"),
                F.min(text).alias("first"), F.max(text).alias("last"), (F.count_if(placeholder) if types[c] == "string" else none).alias("placeholders"), broken.alias("broken"),
            ).alias(f"_s_{c}")
        )
    wide = rows.groupBy(partition).agg(*packed)
    return wide.select(partition, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_s_{c}").alias("s")) for c in columns])).alias("x")).select(partition, "x.column_name", "x.s.*")


def merge_states(parts: DataFrame, into: Sequence[str]) -> DataFrame:
    """States of unions of partitions; associative, so increments merge in any order."""
    between = F.sum(F.when(F.col("non_null") > 0, F.col("total") * F.col("total") / F.col("non_null"))) - F.when(F.sum("non_null") > 0, F.sum("total") * F.sum("total") / F.sum("non_null"))
    m2 = F.sum("m2") + between  # between is exactly 0 for a single state
    return parts.groupBy(*into, "column_name").agg(
        F.sum("n").alias("n"), F.sum("non_null").alias("non_null"), F.sum("total").alias("total"), m2.alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("in_range").alias("in_range"), F.sum("in_range_total").alias("in_range_total"), F.max("longest").alias("longest"), F.hll_union_agg("sketch").alias("sketch"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("placeholders").alias("placeholders"), F.sum("broken").alias("broken"),
    )


def exact_distinct(rows: DataFrame, partition: str, columns: Sequence[str]) -> DataFrame:
    """Exact distinct values (NaN as NULL) of few columns: unpivot, then two aggregates; a hot partition spreads by value."""
    long = rows.select(partition, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _value(rows, c).cast("string").alias("v")) for c in columns])).alias("x")).select(partition, "x.column_name", "x.v")
    return long.groupBy(partition, "column_name", "v").agg(F.lit(1).alias("one")).groupBy(partition, "column_name").agg(F.count("v").alias("distinct_values"))


def add_batch(rows: DataFrame, partition: str, columns: Sequence[str], rules: Sequence[ColumnRule], path: str, batch: int) -> None:
    """Write the states of a batch of rows to the state table at `path`; a batch that runs again replaces itself.

    Rows without a partition belong to nothing and are left out. Columns and rules must be those of the other batches.
    """
    states(rows.filter(F.col(partition).isNotNull()), partition, columns, rules).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_states(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """Merged states of all batches of a state table; a partition that came in several batches is one."""
    return merge_states(spark.read.parquet(path), [partition])


def metrics(rows: DataFrame, partition: str, columns: Sequence[str], rules: Sequence[ColumnRule] = (), known: DataFrame | None = None) -> DataFrame:
    """States with their derived metrics: null_rate, mean, deviation, mean_in_range, distinct_values, violations (NULL where no rule says what is valid).

    known: the states, if they are kept in a table. Rows are then read again only where a distinct count must be
    exact: for `exact` rules, and for the partitions whose sketch comes near a rule's distinct_share.
    """
    s = states(rows, partition, columns, rules) if known is None else known
    rough = F.hll_sketch_estimate("sketch")
    exact = [r.column for r in rules if r.exact and r.column in columns]
    close = [r for r in rules if r.distinct_share is not None and not r.exact and r.column in columns]
    counted = exact_distinct(rows, partition, exact) if exact else None
    if close:
        at = lambda r: (F.col("column_name") == r.column) & (F.abs(rough - r.distinct_share * F.col("non_null")) <= SKETCH_MARGIN * r.distinct_share * F.col("non_null"))
        near = s.filter(reduce(or_, map(at, close)) & (F.col("non_null") > 0)).select(partition, "column_name")
        # a row for each partition at most; an empty one leaves nothing to scan
        again = exact_distinct(rows.join(near.select(partition).distinct(), partition, "left_semi"), partition, [r.column for r in close]).join(near, [partition, "column_name"], "left_semi")
        counted = again if counted is None else counted.unionByName(again)
    out, distinct = s, rough
    if counted is not None:
        out = s.join(counted, [partition, "column_name"], "left")
        distinct = F.coalesce("distinct_values", rough)
    some = F.col("non_null") > 0
    return out.select(
        partition, "column_name", "n", "non_null", ((F.col("n") - F.col("non_null")) / F.col("n")).alias("null_rate"), distinct.alias("distinct_values"), "low", "high",
        F.when(some, F.col("total") / F.col("non_null")).alias("mean"), F.when(some & F.col("m2").isNotNull(), F.sqrt(F.greatest(F.col("m2") / F.col("non_null"), F.lit(0.0)))).alias("deviation"),
        F.when(F.col("in_range") > 0, F.col("in_range_total") / F.col("in_range")).alias("mean_in_range"), F.col("broken").alias("violations"), "longest",
        "first", "last", "placeholders",
    )


def with_base(profile: DataFrame, partitions: DataFrame, partition: str, base: str, about: Sequence[str] = ()) -> DataFrame:
    """Join every partition's metrics to those of its base partition (columns prefixed base_)."""
    own = profile.join(partitions.select(partition, F.col(base).alias("_base"), *about), partition)
    ref = profile.select(F.col(partition).alias("_base"), "column_name", F.col("mean_in_range").alias("base_mean_in_range"), F.col("null_rate").alias("base_null_rate"), F.col("n").alias("base_n"), F.col("distinct_values").alias("base_distinct_values"))
    return own.join(ref, ["_base", "column_name"], "left").drop("_base")


def violations(profile: DataFrame, checks: Sequence[Check], partition: str) -> DataFrame:
    """One row per failed check: partition, column_name, issue. Unknown metrics (NULL) fail nothing."""
    failed = F.array_compact(F.array(*[F.when((F.col("column_name") == c.column) & F.expr(c.when) & F.expr(c.condition), F.lit(c.issue)) for c in checks]))
    return profile.select(partition, "column_name", F.explode(failed).alias("issue"))


#: Metrics of a profile that have control limits.
METRICS = ("n", "non_null", "null_rate", "placeholders", "distinct_values", "low", "high", "mean", "deviation", "mean_in_range", "violations", "longest")


def control_limits(profile: DataFrame, partition: str, series: Sequence[str], order: str, metric: str | Sequence[str], width: float = 3.0, history: int = 8, least: int = 3) -> DataFrame:
    """Anomalies of one or more metrics against their own history: outside mean ± width · deviation of up to `history` earlier loads.

    Series are (group, column) sequences of partitions, one row each, so windows hold partitions, not rows of data.
    A metric that is NULL has no anomaly and no part in the history.
    """
    names = [metric] if isinstance(metric, str) else list(metric)
    kept = dict.fromkeys([partition, *series, order, "column_name"])
    long = profile.select(*kept, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("_m")).select(*kept, "_m.metric", "_m.value")
    w = Window.partitionBy(*series, "column_name", "metric").orderBy(order, partition).rowsBetween(-history, -1)
    past = long.withColumn("past_n", F.count("value").over(w)).withColumn("center", F.avg("value").over(w)).withColumn("spread", F.stddev_pop("value").over(w))
    least_spread = 1e-9 * F.greatest(F.lit(1.0), F.abs("center"))  # sums of another order are no anomaly
    out = F.abs(F.col("value") - F.col("center")) > width * F.greatest(F.col("spread"), least_spread)
    return past.withColumn("anomaly", F.when(F.col("past_n") >= least, out)).select(partition, "column_name", "metric", "value", "past_n", "center", "spread", "anomaly")


ITEM_RULES = (ColumnRule("GLMM_score", -6.0, 6.0, distinct_share=0.5), ColumnRule("item_id", 100_000, 99_999_999, distinct_share=0.85))
# What the text columns of items may hold. Columns in neither list have no rule.
TEXT_RULES = (
    ColumnRule("L1", allowed=("es", "de", "cn")),
    ColumnRule("split", allowed=("train", "dev", "test")),
    ColumnRule("en_target_pos", allowed=("NOUN", "VERB", "ADJ", "ADV", "PRON", "PROPN", "DET", "ADP", "CCONJ", "SCONJ", "NUM", "INTJ", "AUX", "PART", "SYM", "X")),
    ColumnRule("L1_context", pattern="\\p{L}"),
    ColumnRule("L1_source_word", pattern="\\p{L}"),
    ColumnRule("en_target_word", pattern="\\p{L}"),
    ColumnRule("en_target_clue", pattern="^\\p{L}[\\p{L}_ '-]*$"),
    ColumnRule("source", pattern="^[a-z]+_[0-9]+$"),
)
ITEM_CHECKS = (
    Check("GLMM_score", "nulls", "null_rate > 0.1", "split in ('train', 'dev')"),
    Check("GLMM_score", "range", "violations > 0", "split in ('train', 'dev')"),
    Check("GLMM_score", "shift", "abs(mean_in_range - base_mean_in_range) > 1.0", "split in ('train', 'dev')"),
    Check("GLMM_score", "distinct", "distinct_values < 0.5 * non_null", "split in ('train', 'dev')"),
    Check("item_id", "nulls", "null_rate > 0.02"),
    Check("item_id", "range", "violations > 0"),
    Check("item_id", "distinct", "distinct_values < 0.85 * non_null"),
)


def profile_items(items: DataFrame, loads: DataFrame, columns: Sequence[str] | None = None, path: str | None = None, batches: int = 1) -> DataFrame:
    """Profile of items columns per load, with split and the base load's metrics, from a state table.

    path: the state table's folder (a fresh one if None). Loads are taken in by `batches` in order of delivery, as
    they would arrive; the result is the same for any number. Rows of a load that `loads` lacks are in no profile.
    """
    spark = items.sparkSession
    wanted = [c for c in items.columns if c not in ("load_id",)] if columns is None else list(columns)
    path = path or scratch_path(spark, "profile")
    if batches == 1:
        add_batch(items, "load_id", wanted, ITEM_RULES + TEXT_RULES, path, 0)
    else:
        when = F.unix_micros(F.col("delivered_at").cast("timestamp"))
        cuts = loads.agg(F.percentile_approx(when, [i / batches for i in range(1, batches)], 10_000).alias("c")).first().c or []
        at = F.coalesce(sum((F.when(when > c, 1).otherwise(0) for c in cuts), F.lit(0)), F.lit(0))
        for b in range(batches):
            add_batch(items.join(loads.filter(at == b).select("load_id"), "load_id", "left_semi"), "load_id", wanted, ITEM_RULES + TEXT_RULES, path, b)
    known = read_states(spark, path, "load_id")
    return with_base(metrics(items, "load_id", wanted, ITEM_RULES + TEXT_RULES, known), loads, "load_id", "base_load_id", ["split", "delivered_at"])


def offending_loads(items: DataFrame, loads: DataFrame) -> DataFrame:
    """Loads whose GLMM_score or item_id breaks a declared check."""
    return violations(profile_items(items, loads, [r.column for r in ITEM_RULES]), ITEM_CHECKS, "load_id")
