"""Queries of the training-data operators that live in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import PLACEHOLDERS
from glossmill.operators.delimited import split_values
from glossmill.operators.fill import fill_items
from glossmill.operators.profile import ITEM_RULES, METRICS, TEXT_RULES, control_limits, offending_loads, profile_items
from glossmill.sources.tables import table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so engines that add in another order agree."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each value of a record whose L1_source_word holds two or more."""
    return split_values(table(spark, folder, "items"), "L1_source_word", ["row_id"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Missing L1 and en_target_pos with the value that the load's or the item's other records carry."""
    filled = fill_items(table(spark, folder, "items"), table(spark, folder, "ref_values"))
    carried = ((F.col("field_name") == "L1") & (F.col("provenance") == "dependency:load_id")) | ((F.col("field_name") == "en_target_pos") & (F.col("provenance") == "dependency:item_id"))
    return filled.filter(carried).select("row_id", "field_name", "fill_value")


def p5_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Every missing L1 and en_target_pos with its fill and provenance, group fallback included."""
    return fill_items(table(spark, folder, "items"), table(spark, folder, "ref_values"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Loads whose GLMM_score or item_id breaks a declared check."""
    return offending_loads(table(spark, folder, "items"), table(spark, folder, "loads"))


def p6_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Profile of every column of every load beside its base load, taken in by two batches in order of delivery."""
    return rounded(profile_items(table(spark, folder, "items"), table(spark, folder, "loads"), batches=2), 3)


def p6_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric of every column of every load against the control limits of its earlier loads."""
    profile = profile_items(table(spark, folder, "items"), table(spark, folder, "loads"))
    bases = table(spark, folder, "loads").select("load_id", "base_load_id")
    return rounded(control_limits(profile.join(bases, "load_id"), "load_id", ["base_load_id"], "delivered_at", METRICS), 3)


def _profile_sql() -> str:
    """The profile of every column of items in SQL, one branch a column; rules and placeholders are the operator's."""
    kinds = {"row_id": "n", "item_id": "n", "GLMM_score": "d", "authored_at": "t", "loaded_at": "t"}
    text = ("L1", "split", "L1_context", "L1_source_word", "en_target_word", "en_target_pos", "en_target_clue", "source")
    rule = {r.column: r for r in ITEM_RULES + TEXT_RULES}
    listed = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    branches = []
    for c in [*kinds, *text]:
        v = f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" if kinds.get(c) == "d" else c
        number = {"n": "v::DOUBLE", "d": "v", "t": "epoch_us(v) / 1e6"}.get(kinds.get(c, ""), "NULL::DOUBLE")
        r = rule.get(c)
        inside = f"x BETWEEN {r.low} AND {r.high}" if r is not None and r.low is not None else "x IS NOT NULL"
        gap = f"lower(regexp_replace(v, '^[\\s\\p{{Z}}\\x{{feff}}]+|[\\s\\p{{Z}}\\x{{feff}}]+$', '', 'g')) IN ({listed(PLACEHOLDERS)})"
        if c in kinds:
            wrong = f"count(*) FILTER (x IS NOT NULL AND NOT ({inside}))" if r is not None else "NULL::BIGINT"
        else:
            wrong = "count(*) FILTER (v IS NOT NULL AND (" + gap + " OR " + (f"v NOT IN ({listed(r.allowed)})" if r.allowed else f"NOT regexp_matches(v, '{r.pattern.replace(chr(39), chr(39) * 2)}')") + "))"
        shown = "v" if c in text else "NULL::VARCHAR"
        branches.append(
            f"SELECT load_id, '{c}' AS column_name, count(*) AS n, count(v) AS non_null, (count(*) - count(v)) / count(*) AS null_rate, count(DISTINCT v) AS distinct_values, min(x) AS low, max(x) AS high, avg(x) AS mean, stddev_pop(x) AS deviation, "
            f"avg(x) FILTER ({inside}) AS mean_in_range, {wrong} AS violations, max(length({shown}))::INT AS longest, min({shown}) AS first, max({shown}) AS last, {'count(*) FILTER (v IS NOT NULL AND ' + gap + ')' if c in text else 'NULL::BIGINT'} AS placeholders "
            f"FROM (SELECT load_id, v, {number} AS x FROM (SELECT load_id, {v} AS v FROM items WHERE load_id IS NOT NULL)) GROUP BY load_id"
        )
    return "WITH s AS (" + " UNION ALL ".join(branches) + "), p AS (SELECT s.*, l.split, l.delivered_at, l.base_load_id, b.mean_in_range AS base_mean_in_range, b.null_rate AS base_null_rate, b.n AS base_n, b.distinct_values AS base_distinct_values FROM s JOIN loads l USING (load_id) LEFT JOIN s b ON b.load_id = l.base_load_id AND b.column_name = s.column_name)"


_R3 = "round(null_rate, 3) AS null_rate, distinct_values, round(low, 3) AS low, round(high, 3) AS high, round(mean, 3) AS mean, round(deviation, 3) AS deviation, round(mean_in_range, 3) AS mean_in_range, violations, longest, first, last, placeholders, split, delivered_at, round(base_mean_in_range, 3) AS base_mean_in_range, round(base_null_rate, 3) AS base_null_rate, base_n, base_distinct_values"
_ANOMALIES = (
    ", m AS (SELECT load_id, base_load_id, delivered_at, column_name, unnest([" + ", ".join(f"'{m}'" for m in METRICS) + "]) AS metric, unnest([" + ", ".join(f"{m}::DOUBLE" for m in METRICS) + "]) AS value FROM p), "
    "w AS (SELECT *, count(value) OVER h AS past_n, avg(value) OVER h AS center, stddev_pop(value) OVER h AS spread FROM m WINDOW h AS (PARTITION BY base_load_id, column_name, metric ORDER BY delivered_at, load_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) "
    "SELECT load_id, column_name, metric, round(value, 3) AS value, past_n, round(center, 3) AS center, round(spread, 3) AS spread, CASE WHEN past_n >= 3 THEN abs(value - center) > 3.0 * greatest(spread, 1e-9 * greatest(1.0, abs(center))) END AS anomaly FROM w"
)

QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_filled": p5_filled, "p6_found": p6_found, "p6_profile": p6_profile, "p6_anomalies": p6_anomalies}

ORACLE = {
    "p6_profile": _profile_sql() + f" SELECT load_id, column_name, n, non_null, {_R3} FROM p",
    "p6_anomalies": _profile_sql() + _ANOMALIES,
    "p6_found": """
WITH v AS (SELECT load_id, CASE WHEN isnan(GLMM_score) THEN NULL ELSE GLMM_score END AS g, item_id FROM items),
s AS (SELECT load_id, count(*) AS n, count(g) AS ng, count(item_id) AS ni, count(DISTINCT g) AS dg, count(DISTINCT item_id) AS di,
      count(*) FILTER (g < -6 OR g > 6) AS bg, count(*) FILTER (item_id < 100000 OR item_id > 99999999) AS bi,
      avg(g) FILTER (g BETWEEN -6 AND 6) AS m FROM v GROUP BY load_id),
j AS (SELECT s.*, l.split, b.m AS bm FROM s JOIN loads l USING (load_id) LEFT JOIN s b ON b.load_id = l.base_load_id)
SELECT load_id, 'GLMM_score' AS column_name, 'nulls' AS issue FROM j WHERE split IN ('train','dev') AND (n - ng) / n > 0.1
UNION ALL SELECT load_id, 'GLMM_score', 'range' FROM j WHERE split IN ('train','dev') AND bg > 0
UNION ALL SELECT load_id, 'GLMM_score', 'shift' FROM j WHERE split IN ('train','dev') AND abs(m - bm) > 1.0
UNION ALL SELECT load_id, 'GLMM_score', 'distinct' FROM j WHERE split IN ('train','dev') AND dg < 0.5 * ng
UNION ALL SELECT load_id, 'item_id', 'nulls' FROM j WHERE (n - ni) / n > 0.02
UNION ALL SELECT load_id, 'item_id', 'range' FROM j WHERE bi > 0
UNION ALL SELECT load_id, 'item_id', 'distinct' FROM j WHERE di < 0.85 * ni
""",
}
