"""Rules of text columns and control limits of all metrics."""

from datetime import datetime

from glossmill.operators.profile import METRICS, TEXT_RULES, ColumnRule, control_limits, merge_states, metrics, states
from glossmill.plans import core_queries


def test_text_rules_and_unknown_violations(spark):
    df = spark.createDataFrame([(1, v, v, 7) for v in ("es", "NA", "null", "xx", " ", None, "de")], "p int, L1 string, free string, n int")
    m = {r.column_name: r for r in metrics(df, "p", ["L1", "free", "n"], TEXT_RULES).collect()}
    assert (m["L1"].violations, m["L1"].placeholders, m["L1"].first, m["L1"].last) == (4, 3, " ", "xx")
    assert (m["free"].violations, m["free"].placeholders, m["n"].violations, m["n"].placeholders) == (None, 3, None, None)
    clue = metrics(df, "p", ["free"], [ColumnRule("free", pattern="^[a-z]{2}$")]).first()
    assert clue.violations == 3
    whole = {r.column_name: r for r in merge_states(states(df, "p", ["L1", "free"], TEXT_RULES), []).collect()}
    assert (whole["L1"].broken, whole["L1"].placeholders, whole["free"].broken) == (4, 3, None)


def test_every_metric_has_limits(spark):
    rows = [(i, 1, "x", i, *([1.0] * (len(METRICS) - 1)), None) for i in range(8)] + [(8, 1, "x", 8, *([5.0] * (len(METRICS) - 1)), None)]
    df = spark.createDataFrame(rows, "load int, base int, column_name string, at int, " + ", ".join(f"{m} double" for m in METRICS))
    got = [(r.load, r.metric) for r in control_limits(df, "load", ["base"], "at", METRICS).filter("anomaly").collect()]
    assert sorted(got) == sorted((8, m) for m in METRICS[:-1])


def test_p6_anomalies_sees_more_than_null_rates(spark, tmp_path):
    schema = "row_id bigint, load_id bigint, L1 string, GLMM_score double, item_id bigint"
    rows = [(100 * k + i, k, "es" if k < 6 or i % 2 else "??", i / 10.0 + (3.0 if k == 6 else 0.0), 100_000 + i) for k in range(1, 7) for i in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/items.parquet")
    spark.createDataFrame([(k, 1, "train", datetime(2024, 1, k)) for k in range(1, 7)], "load_id bigint, base_load_id bigint, split string, delivered_at timestamp").write.parquet(f"{tmp_path}/loads.parquet")
    got = {(r.load_id, r.column_name, r.metric) for r in core_queries.p6_anomalies(spark, str(tmp_path)).filter("anomaly").collect()}
    assert {(6, "GLMM_score", "mean"), (6, "L1", "violations"), (6, "L1", "distinct_values")} <= got
    assert not {g for g in got if g[0] < 6 and g[1] != "row_id"}
