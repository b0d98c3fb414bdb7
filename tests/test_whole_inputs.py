"""Lookups, distances, predictions and clues over whole tables, against plain programs on a small fixture."""

import pytest

from glossmill.plans import reference_queries as q

ITEMS = [(1, "music", "noun", "m____"), (2, "Run ", "vv", "___"), (3, "café", None, "c_f_"), (4, "ice cream", "NOUN", "i__ c____"), (5, "运行", "VERB", "  "), (6, None, "SCONJ", None), (7, "mango", "NOUN", "M____")]
LEX = [("music", "NOUN", 5.0, 9.0), ("run", "NOUN", 4.0, 50.0), ("run", "verb", 3.0, 20.0), ("Café", "NOUN", 2.0, 1.0), ("mango", "PROPN", 1.0, 3.0), ("ice cream", "noun", 1.5, 2.0)]
PAIRS = [("música", "music"), ("音乐", "yinyue"), ("haus", "house"), ("señal", "senal")]
TEXT = "music music magic run ran cafe"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(ITEMS, "row_id bigint, en_target_word string, en_target_pos string, en_target_clue string").write.parquet(f"{d}/items.parquet")
    spark.createDataFrame(LEX, "word string, part_of_speech string, zipf double, subtl_wf double").write.parquet(f"{d}/lexicon.parquet")
    spark.createDataFrame(PAIRS, "word_1_norm string, word_2_norm string").write.parquet(f"{d}/cognet_edges.parquet")
    spark.createDataFrame([(1, TEXT)], "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    return d


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_edit_distance(spark, folder):
    assert {(r.a, r.b): r.edits for r in q.edit_distance(spark, folder).collect()} == {p: edits(*p) for p in PAIRS}


def test_lexicon_lookup(spark, folder):
    got = {r.row_id: (r.subtlex_wf, r.subtlex_zipf, r.subtlex_found, r.subtlex_pos_match) for r in q.lexicon_lookup(spark, folder).collect()}
    assert got == {1: (9.0, 5.0, 1, 1), 2: (20.0, 3.0, 1, 1), 3: (1.0, 2.0, 1, 0), 4: (2.0, 1.5, 1, 1), 5: (None, None, 0, 0), 6: (None, None, 0, 0), 7: (3.0, 1.0, 1, 0)}


def test_clue_candidates(spark, folder):
    words = {w for w, *_ in LEX}
    want = {}
    for clue in {c for *_, c in ITEMS if c is not None}:
        t = clue.strip(" ").lower()
        fit = [w for w in words if not t or len(w) == len(t) and all(x in ("_", y) for x, y in zip(t, w.lower(), strict=True))]
        if fit:
            want[clue] = (len(fit), min(fit))
    assert {r.clue: (r.n_words, r.first_word) for r in q.clue_candidates(spark, folder).collect()} == want


def test_baseline_predicted(spark, folder):
    got = {r.row_id: (r.mlm_pred_word, r.baseline_pred_len, r.baseline_pred_matches_target) for r in q.baseline_predicted(spark, folder).collect()}
    assert len(got) == len(ITEMS)
    assert got[1] == ("music", 5, 1) and got[7] == ("music", 5, 0) and got[5] == (None, 0, 0) and got[6] == (None, 0, 0)
