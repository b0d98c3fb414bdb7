"""Dependency fill and profiles on small tables, with the defined corner cases."""

from datetime import datetime

from glossmill.operators.fill import Target, determinant_counts, dictionaries, fill_items, fill_missing, load_languages, mine_dependencies
from glossmill.operators.profile import ColumnRule, add_batch, control_limits, merge_states, metrics, offending_loads, profile_items, read_states, states
from glossmill.plans.core_queries import rounded

ITEMS = "row_id bigint, item_id bigint, L1 string, split string, L1_source_word string, en_target_word string, en_target_pos string, en_target_clue string, GLMM_score double, source string, load_id bigint"
REFS = "ref_id bigint, field_name string, L1 string, canonical string, aliases string"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def refs(spark):
    return spark.createDataFrame([(1, "en_target_pos", None, "NOUN", "noun|Substantiv"), (2, "en_target_pos", None, "VERB", "verb|v")], REFS)


def test_fill_items(spark):
    rows = [(i, 100_000 + i // 4, "es", "train", "w", "x", "noun" if i // 4 % 2 else "VERB", "x_", 0.0, "s", 1) for i in range(40)]
    rows[1] = (1, 100_000, None, "train", "w", "x", "nan", "x_", 0.0, "s", 1)
    rows[5] = (5, 100_001, "N/A", "train", "w", "x", "Substnativ", "x_", 0.0, "s", 1)
    rows[6] = (6, 100_001, " ", "train", "w", "x", None, "x_", 0.0, "s", 1)
    rows.append((99, 555_555, "es", "train", "w", "alone", None, "x_", 0.0, "s", 1))
    got = {(r.row_id, r.field_name): (r.fill_value, r.provenance) for r in fill_items(items(spark, rows), refs(spark)).collect()}
    assert got[(1, "L1")] == ("es", "dependency:load_id") and got[(5, "L1")][0] == "es" and got[(6, "L1")][0] == "es"
    assert got[(1, "en_target_pos")] == ("VERB", "dependency:item_id") and got[(6, "en_target_pos")] == ("NOUN", "dependency:item_id")
    assert got[(99, "en_target_pos")] == (None, "none")
    assert len(got) == 6


def test_fill_empty_and_unverified(spark):
    df = spark.createDataFrame([], "k bigint, a string, v string")
    assert fill_missing(df, [Target("v", ["a"])], ["k"]).count() == 0
    mixed = spark.createDataFrame([(i, "a", "xyz"[i % 3]) for i in range(9)] + [(9, "a", None)], "k bigint, a string, v string")
    assert mine_dependencies(dictionaries(determinant_counts(mixed, [Target("v", ["a"])]))).first().confidence == 1 / 3
    row = fill_missing(mixed, [Target("v", ["a"], ["a"])], ["k"]).first()
    assert (row.fill_value, row.provenance) == ("x", "group:a")
    assert fill_missing(mixed, [Target("v", ["a"])], ["k"]).first().provenance == "none"


def test_all_verified_dependencies_serve_in_order(spark):
    # a and b are equally sure; b alone knows p4, and a is named first
    rows = [(i, f"a{i % 2}", f"b{i % 2}", "xy"[i % 2]) for i in range(12)] + [(12, "a0", "b1", None), (13, None, "b1", ""), (13, None, "b1", ""), (14, "new", "b0", "-"), (15, None, None, None)]
    df = spark.createDataFrame(rows, "k bigint, a string, b string, v string")
    got = sorted((r.k, r.fill_value, r.provenance) for r in fill_missing(df, [Target("v", ["a", "b"])], ["k"]).filter("k < 15").collect())
    assert got == [(12, "x", "dependency:a"), (13, "y", "dependency:b"), (13, "y", "dependency:b"), (14, "x", "dependency:b")]
    got = {r.k: (r.fill_value, r.provenance) for r in fill_missing(df, [Target("v", ["b", "a"])], ["k"]).collect()}
    assert got[12] == ("y", "dependency:b") and got[15] == (None, "none")


def test_item_comes_before_an_equally_sure_clue(spark):
    rows = [(i, 100_000 + i // 4, "es", "train", "w", "x", "NOUN" if i // 4 % 2 else "VERB", f"x{i // 4}_", 0.0, "s", 1) for i in range(40)]
    rows[2] = (2, 100_000, "es", "train", "w", "x", None, "x0_", 0.0, "s", 1)
    got = [(r.fill_value, r.provenance) for r in fill_items(items(spark, rows), refs(spark)).collect()]
    assert got == [("VERB", "dependency:item_id")]


def test_load_languages_takes_the_majority(spark):
    df = spark.createDataFrame([(1, "es"), (1, "ES"), (1, "de"), (2, None), (None, "de")], "load_id bigint, L1 string")
    assert [tuple(r) for r in load_languages(df).collect()] == [(1, "es")]


def test_states_merge_and_metrics(spark):
    df = spark.createDataFrame([(1, float(i), "a") for i in range(10)] + [(2, None, None), (2, float("nan"), "b"), (2, 50.0, "")], "p int, x double, s string")
    rules = [ColumnRule("x", 0, 9, exact=True)]
    whole = {r.column_name: r for r in merge_states(states(df, "p", ["x", "s"], rules), []).collect()}
    assert (whole["x"].n, whole["x"].non_null, whole["x"].high) == (13, 11, 50.0)
    m = {(r.p, r.column_name): r for r in metrics(df, "p", ["x", "s"], rules).collect()}
    assert (m[(2, "x")].violations, m[(2, "x")].distinct_values, m[(1, "x")].distinct_values) == (1, 1, 10)
    assert m[(2, "x")].null_rate == 2 / 3 and m[(2, "s")].null_rate == 1 / 3
    assert metrics(df.filter("false"), "p", ["x"], rules).count() == 0


def test_offending_loads(spark):
    good = [(i, 100_000 + i, "es", "train", "w", "x", "NOUN", "x_", i / 100.0, "s", 1) for i in range(50)]
    shifted = [(100 + i, 100_000 + i, "es", "train", "w", "x", "NOUN", "x_", 2 + i / 100.0, "s", 2) for i in range(50)]
    bad = [(200 + i, 7 if i else None, "es", "train", "w", "x", "NOUN", "x_", 9.0 if i % 2 else None, "s", 3) for i in range(49)]
    loads = spark.createDataFrame([(1, 1, "train", None), (2, 1, "train", None), (3, 1, "train", None)], "load_id bigint, base_load_id bigint, split string, delivered_at timestamp")
    got = {(r.load_id, r.column_name, r.issue) for r in offending_loads(items(spark, good + shifted + bad), loads).collect()}
    assert got == {(2, "GLMM_score", "shift"), (3, "GLMM_score", "nulls"), (3, "GLMM_score", "range"), (3, "GLMM_score", "distinct"), (3, "item_id", "nulls"), (3, "item_id", "range"), (3, "item_id", "distinct")}


def test_batches_give_the_profile_of_all(spark, tmp_path):
    rows = [(i, 100_000 + i % 90, "es", "train", "w", "x", "NOUN", "x_", (i % 50) / 10.0, "s", i % 4) for i in range(400)] + [(999, 1, "es", "train", "w", "x", "NOUN", "x_", 0.0, "s", None)]
    loads = spark.createDataFrame([(k, 0, "train", datetime(2024, 1, 1 + k)) for k in range(4)], "load_id bigint, base_load_id bigint, split string, delivered_at timestamp")
    once = profile_items(items(spark, rows), loads, path=f"{tmp_path}/a")
    twice = profile_items(items(spark, rows), loads, path=f"{tmp_path}/b", batches=3)
    assert sorted(map(str, rounded(once, 9).collect())) == sorted(map(str, rounded(twice, 9).collect())) and once.count() == 40
    add_batch(items(spark, rows), "load_id", ["GLMM_score"], (), f"{tmp_path}/c", 0)
    add_batch(items(spark, [(1, 1, "es", "train", "w", "x", "NOUN", "x_", 70.0, "s", 3)]), "load_id", ["GLMM_score"], (), f"{tmp_path}/c", 1)
    merged = {r.load_id: r for r in read_states(spark, f"{tmp_path}/c", "load_id").collect()}
    values = [(i % 50) / 10.0 for i in range(3, 400, 4)] + [70.0]
    mean = sum(values) / len(values)
    assert merged[3].n == 101 and merged[3].high == 70.0 and abs(merged[3].m2 - sum((v - mean) ** 2 for v in values)) < 1e-6


def test_distinct_counts_near_a_threshold_are_exact(spark):
    df = spark.createDataFrame([(1, float(i % 5_010)) for i in range(10_000)] + [(2, float(i)) for i in range(9_000)], "p int, x double")
    got = {r.p: r.distinct_values for r in metrics(df, "p", ["x"], [ColumnRule("x", distinct_share=0.5)]).collect()}
    assert got[1] == 5_010 and got[2] > 8_000


def test_control_limits(spark):
    df = spark.createDataFrame([(i, 1, "x", i, 0.1 if i < 8 else 0.9) for i in range(9)], "load int, base int, column_name string, at int, rate double")
    assert [r.load for r in control_limits(df, "load", ["base"], "at", "rate").filter("anomaly").collect()] == [8]
