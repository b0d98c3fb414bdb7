"""The concept graph over whole tables, against a plain program on a small fixture."""

from collections import Counter

import pytest

from glossmill.plans import reference_queries as q

ITEMS = [  # row_id, load_id, L1, entry, context, target, and by hand: language, source forms, target form
    (1, 1, "es", "música", "", "music", "es", ["música"], "music"),
    (2, 1, "NA", "casa|hogar", "el hogar", "home", "es", ["casa", "hogar"], "home"),
    (3, 2, "de", "das Haus", "", "house", "de", ["haus"], "house"),
    (4, 2, "de", "Gebäude (nicht: Haus)", "", "building", "de", ["gebäude"], "building"),
    (5, 2, None, "Hаus, Bau", "", "home", "de", ["haus", "bau"], "home"),
    (6, 3, "cn", "图书", "", "book", "cn", ["图书"], "book"),
    (7, 3, "cn", "浅薄/图 (不是书)", "图", "picture", "cn", ["浅薄", "图"], "picture"),
    (8, 3, "", "无词", "", "nothing", "cn", ["无词"], "nothing"),
    (9, 3, "cn", "无词", "", "house", "cn", ["无词"], "house"),
    (10, 1, "es", "dar a luz", "", "give birth", "es", ["dar"], "give birth"),  # an entry's candidate is one word
    (11, 2, "de", "Haus", "", "book", "de", ["haus"], "book"),
]
EDGES = [("c1", "spa", "música", "eng", "music"), ("c2", "eng", "home", "spa", "hogar"), ("c2", "eng", "house", "deu", "Haus"), ("c2", "spa", "casa", "eng", "house"), ("c3", "deu", "Gebäude", "eng", "building"), ("c4", "zho", "图书", "eng", "book"), ("c4", "cmn", "图", "eng", "picture"), ("c5", "spa", "dar a luz", "eng", "give birth")]
CODES = {"es": {"spa"}, "de": {"deu"}, "cn": {"cmn", "zho"}}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("graph"))
    spark.createDataFrame([i[:6] for i in ITEMS], "row_id bigint, load_id bigint, L1 string, L1_source_word string, L1_context string, en_target_word string").write.parquet(f"{d}/items.parquet")
    spark.createDataFrame([(*e, None, None) for e in EDGES], "concept_id string, lang_1 string, word_1 string, lang_2 string, word_2 string, translit_1 string, translit_2 string").write.parquet(f"{d}/cognet_edges.parquet")
    return d


def plain():
    """Per row: language, source concepts, target concepts, exact edges, shared, alternatives."""
    sides = [(c, a, w.lower(), v.lower()) if b == "eng" else (c, b, v.lower(), w.lower()) for c, a, w, b, v in EDGES]
    out = {}
    for row, *_, l1, forms, target in ITEMS:
        hits = [(c, t) for c, lang, s, t in sides if lang in CODES[l1] and s in forms]
        source, aims = {c for c, _ in hits}, {c for c, _, _, t in sides if t == target}
        out[row] = (l1, source, aims, sum(t == target for _, t in hits), source & aims, sorted({t for c, _, _, t in sides if c in source and t != target}))
    return out


def test_all_items_meet_the_graph(spark, folder):
    want = plain()
    got = {r.row_id: r for r in q.concept_enrich_all(spark, folder).collect()}
    assert {k: (r.source_found, r.target_found, r.n_source, r.n_target, r.n_shared, r.best) for k, r in got.items()} == {k: (int(bool(s)), int(bool(t)), len(s), len(t), len(x), min(x, default=None)) for k, (_, s, t, _, x, _) in want.items()}
    assert {k for k, r in got.items() if r.match_type == "exact_pair"} == {k for k, v in want.items() if v[3]}
    assert {r.row_id: r.text for r in q.concept_alternatives_all(spark, folder).collect()} == {k: "|".join(v[5]) for k, v in want.items() if v[5]}


def test_details_coverage_and_unmatched_of_all_items(spark, folder):
    want = plain()
    exact = Counter(r.row_id for r in q.concept_detail(spark, folder).collect() if r.match_type == "exact_pair")
    assert exact == {k: v[3] for k, v in want.items() if v[3]}
    got = {r.l1: (r.n, r.source_rate, r.target_rate, r.n_exact, r.n_shared) for r in q.enrich_coverage_all(spark, folder).collect()}
    for l1 in CODES:
        mine = [v for v in want.values() if v[0] == l1]
        assert got[l1] == (len(mine), round(sum(bool(v[1]) for v in mine) / len(mine), 6), round(sum(bool(v[2]) for v in mine) / len(mine), 6), sum(v[3] > 0 for v in mine), sum(bool(v[4]) for v in mine))
    assert [tuple(r) for r in q.top_unmatched_all(spark, folder).collect()] == [("无词", 2), ("dar", 1)]


@pytest.mark.parametrize("name", ["enrich_coverage", "enrich_coverage_all", "concept_alternatives", "concept_alternatives_all", "concept_detail"])
def test_lists_of_a_frequent_word_do_not_travel_with_items(spark, tmp_path, name):
    n, items = 2_000, 400
    spark.range(items).selectExpr("id AS row_id", "1L AS load_id", "'es' AS L1", "'casa' AS L1_source_word", "'' AS L1_context", "if(id < 200, 'house', concat('t', id)) AS en_target_word").write.parquet(f"{tmp_path}/items.parquet")
    pair = "concept_id string, lang_1 string, word_1 string, lang_2 string, word_2 string, translit_1 string, translit_2 string"
    edges = [(f"c{i:06d}", "spa", "casa", "eng", w, None, None) for i in range(n) for w in ("house", f"w{i}")]
    spark.createDataFrame(edges, pair).coalesce(2).write.parquet(f"{tmp_path}/cognet_edges.parquet")
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = moved()
    q.QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert moved() - before < 1_200_000  # a list for every item or question is several MB
