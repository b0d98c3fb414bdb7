"""Contract of the entry module, sources, configuration, checks, folds, models and streaming."""

import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill import config
from glossmill.ml import folds, models
from glossmill.operators import checks
from glossmill.sources import files
from glossmill.streaming.features import stream_features

REPO = Path(__file__).resolve().parents[1]


def test_entry_contract():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'p2_found' in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_nothing_outside_imports_the_subpackage():
    for p in (REPO / "glossmill").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "glossmill.llm" not in p.read_text(), p


def test_tables_and_lexicons(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x, ""y"""\n2,\n')
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'x, "y"'), ("2", None)]
    with pytest.raises(checks.ConfigError):
        files.read_table(spark, "a.xls")
    (tmp_path / "e.tsv").write_text("\t".join(files.EDGE_COLUMNS) + "\nc1\tspa\tsol\teng\tsun\t\t\nbad line\n")
    good, bad = files.read_edges(spark, str(tmp_path / "e.tsv"))
    assert (good.count(), bad.count()) == (1, 1)
    (tmp_path / "l.csv").write_text("source_word;target_word;score\nSol;sun;0.5\nsun;luna;x\n")
    lex = files.read_cognate_lexicon(spark, str(tmp_path / "l.csv"))
    pairs = spark.createDataFrame([("sun", "sol"), ("a", "b")], "s string, t string")
    assert {r.s: r.lexicon_score for r in files.symmetric_scores(pairs, lex, "s", "t").collect()} == {"sun": 0.5, "a": None}
    files.write_submission(spark.createDataFrame([(1, 0.5)], "item_id int, p double"), "item_id", "p", str(tmp_path / "sub"))
    files.write_frames({"x": lex}, str(tmp_path / "out"))
    assert list(files.read_frames(spark, str(tmp_path / "out"), ["x", "y"])) == ["x"]


def test_config(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": [1, 2]}, "b": 1}))
    (tmp_path / "top.json").write_text(json.dumps({"inherits": "base.json", "a": {"y": [3]}}))
    got = config.resolve(str(tmp_path / "top.json"))
    assert (got["a"], got["b"], len(got["_lineage"])) == ({"x": 1, "y": [3]}, 1, 2)
    (tmp_path / "base.json").write_text(json.dumps({"inherits": "top.json"}))
    with pytest.raises(checks.ConfigError):
        config.resolve(str(tmp_path / "top.json"))
    config.validate(got, {"a.x": int})
    with pytest.raises(checks.ConfigError):
        config.validate(got, {"a.z": int})
    assert config.normalize(["Kendall", "rmse", "kendall_tau"]) == ["kendall_tau", "rmse"]


def test_checks(spark):
    df = spark.createDataFrame([("es", "train", 1.0), ("xx", "test", None), (None, "dev", None)], "L1 string, split string, y double")
    got = {r.check_name: r.n_bad for r in checks.violations(df, checks.item_conditions(("es",), [], "y")).collect()}
    assert got == {"l1_not_allowed": 2, "target_missing": 1, "target_not_finite": 0}
    with pytest.raises(checks.DataError):
        checks.require(checks.violations(df, {"x": F.col("y").isNull()}))
    with pytest.raises(checks.DataError):
        checks.require_columns(df, ["nope"])


def test_folds_and_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(scale=0.1, size=300)
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id int, a double, b double, y double")
    _, coef = models.ridge(df, ["a", "b"], "y", 2.0)
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + 2.0 * np.eye(2), c.T @ (y - y.mean()))
    assert [coef["a"], coef["b"]] == pytest.approx(want, abs=1e-9)
    split = folds.kfold(df, "id", 3)
    oof = folds.out_of_fold(split, 3, lambda t: models.ridge(t, ["a", "b"], "y")[0], ["id", "y"])
    assert oof.count() == 300 and folds.fold_summary(oof, "y").filter("metric = 'rmse'").first().overall < 0.2
    assert {r.n_shared for r in folds.fold_checks(split, "id", 3).collect()} == {0}
    strat = folds.stratified(df, "id", "y", 3, 2).groupBy("cv_fold").count().collect()
    assert len(strat) == 3 and all(80 <= r["count"] <= 120 for r in strat)


def test_preprocessor(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, None), (10.0, 5.0)], "a double, b double")
    p = models.Preprocessor(df, ["a", "b"])
    assert p.fill["a"] == 2.5 and p.scale[1] == 1.0
    assert p(df).agg(F.round(F.sum("a"), 9)).first()[0] == 0.0


def test_features_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("sol", "sun", "s__")], "L1_source_word string, en_target_word string, en_target_clue string").write.parquet(str(tmp_path / "in"))
    stream = stream_features(spark.readStream.schema("L1_source_word string, en_target_word string, en_target_clue string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("feats").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("feats").first().target_len == 3
