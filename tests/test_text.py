"""Folding against Python's Unicode data, and spelling distance against a direct implementation."""

import random
import unicodedata

from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.functions.spelling import bigrams, deletions, edit_distance


def values(spark, items, column):
    rows = spark.createDataFrame(list(enumerate(items)), "i int, v string").select("i", column(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_consistent_forms(spark):
    cases = {"ｒｅｃｏｒｄ ７": "record 7", "recοrd": "record", "Жбя": "Жбя", "m​a­estro": "maestro", "a b　c": "a b c", "ﬁne ǌ": "fine nj", "⼀⻋": "一车", "“x”，y": "“x”，y", "a\tb\nc": "a\tb\nc", "": "", None: None}
    assert values(spark, list(cases), T.consistent) == list(cases.values())


def test_compose_equals_nfc(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeounAEOsz ̧́̈̃ 一") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    words = [w for w in words if not any(unicodedata.combining(a) and unicodedata.combining(b) for a, b in zip(w, w[1:]))]
    assert values(spark, words, T.compose) == [unicodedata.normalize("NFC", w) for w in words]


def test_long_text_stays_whole(spark):
    long = "é" * 50_000
    assert values(spark, [unicodedata.normalize("NFD", long)], T.consistent) == [long]


def test_missing(spark):
    got = values(spark, [None, "", " ", "nan", "NA", "N/A", "null", "None", "<NA>", "-", "x", "n.a."], T.is_missing)
    assert got == [True] * 10 + [False, False]


def osa(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i or j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edit_distance_and_deletions(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))
    pairs = [(word(), word()) for _ in range(500)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", edit_distance(F.col("a"), F.col("b")).alias("d"), F.arrays_overlap(deletions(F.col("a")), deletions(F.col("b"))).alias("meet")).collect()
    for r in rows:
        assert (r.d <= 1) == (osa(r.a, r.b) <= 1), r
        if osa(r.a, r.b) <= 1:
            assert r.meet, r


def test_bigrams_number_repeats(spark):
    assert values(spark, ["aaa", ""], bigrams) == [["^a1", "aa1", "aa2", "a$1"], ["^$1"]]
