"""Canonical mapping, look-alike classes, component splits and cross-split overlap against brute force."""

import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossmill.llm import overlap
from glossmill.llm.canonical import closest_entries
from glossmill.llm.lookalike import consistent_values
from glossmill.llm.overlap import cross_split_pairs, near_pairs, ways
from glossmill.llm.splits import PROPORTIONS, assign, components, deal, read_components, update
from glossmill.session import durable, shared_dir

REFS = "ref_id bigint, field_name string, L1 string, canonical string, aliases string"
WORD, SOURCE = "en_target_word", "L1_source_word"


def meant(spark, refs, values):
    df = spark.createDataFrame([(f, l, v) for f, l, v in values], "field_name string, l1 string, value string").distinct()
    return {(r.l1, r.value): r.ref_id for r in closest_entries(df, spark.createDataFrame(refs, REFS)).collect()}


def test_closest_entries(spark):
    refs = [(1, WORD, None, "kitchen", None), (2, WORD, None, "noisy", None), (3, WORD, None, "bridge", None), (4, SOURCE, "de", "Brücke", None), (5, SOURCE, "es", "sin", None), (6, SOURCE, "cn", "医院", None), (7, SOURCE, "es", "pedir prestado", None), (8, SOURCE, "de", "sin", None)]
    cases = {("", "kitchne"): 1, ("", "a kitchen"): 1, ("", "kit-chen"): 1, ("", "kіtсhen"): 1, ("", "KITCHN"): 1, ("", "niosy"): 2, ("", "xbridge"): 3, ("", "bridxx"): 0, ("", "???"): 0, ("", ""): 0, ("de", "Bruecke"): 4, ("de", "die Brücke"): 4, ("es", "sin"): 5, ("es", "sim"): 5, ("es", "sn"): 5, ("es", "si"): 5, ("es", "xi"): 0, ("de", "sin"): 8, ("cn", "醫院"): 6, ("cn", "医院的"): 6, ("cn", "医"): 0, ("es", "PEDIR PRESTADO."): 7, ("", "k" * 30_000): 0}
    got = meant(spark, refs, [(WORD if not l else SOURCE, l, v) for l, v in cases])
    assert got == cases
    assert meant(spark, refs, []) == {}


def test_closest_entries_finds_every_single_edit(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    names = list(dict.fromkeys(names))
    values = []
    for _ in range(300):
        w = rng.choice(names)
        i, kind = rng.randrange(len(w) - 1), rng.randrange(4)
        values.append((w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdefgh") + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :])[kind])
    got = meant(spark, [(i + 1, WORD, None, n, None) for i, n in enumerate(names)], [(WORD, "", v) for v in values])
    assert all(got[("", v)] > 0 for v in values)


def test_consistent_values(spark):
    rows = [(1, "rec\u03bfrd"), (2, "record"), (4, "U\u0308bung"), (5, "\u00dcbung"), (6, None), (7, ""), (8, "a\u00a0b"), (9, "rec\u03bfrd")]
    df = spark.createDataFrame(rows, "row_id bigint, w string")
    got = {r.row_id: (r.consistent, r.changed) for r in consistent_values(df, ["w"], ["row_id"]).collect()}
    assert got[1] == got[9] == ("record", True) and got[4] == ("\u00dcbung", True) and got[8] == ("a b", True)
    assert 2 not in got and 5 not in got and 6 not in got and 7 not in got
    assert consistent_values(df.filter("false"), ["w"], ["row_id"]).count() == 0


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(5)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), (None, "q")]
    edges += [(f"r{rng.randrange(60):02d}", f"r{rng.randrange(60):02d}") for _ in range(40)]
    parent = {}
    find = lambda a: a if parent.setdefault(a, a) == a else find(parent[a])
    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([("alone",), ("s",)], "node string")).collect()}
    assert got["alone"] == "alone" and all(got[n] == find(n) for n in got if n in parent)


def test_assign_proportions(spark):
    rng = random.Random(2)
    rows = [("huge", 9_000, None)] + [(f"h{i}", rng.randint(300, 1_500), None) for i in range(8)] + [(f"k{i}", 1 + i % 7, None) for i in range(3_000)] + [("old", 500, "test"), ("bad", 100, "quarantine")]
    got = assign(spark.createDataFrame(rows, "component string, n bigint, split string"), totals={"dev": 50}).collect()
    total, per = sum(r.n for r in got) + 50, Counter({"dev": 50})
    for r in got:
        per[r.split] += r.n
    assert len(got) == len(rows) == len({r.component for r in got})
    # the proportions are of all rows, kept and quarantined ones too: what is left is shared by what each split lacks
    lack = {s: max(0.0, p * total - {"test": 500, "dev": 50}.get(s, 0)) for s, p in PROPORTIONS.items()}
    new = total - 650
    assert all(abs(per[s] - {"test": 500, "dev": 50}.get(s, 0) - lack[s] / sum(lack.values()) * new) <= 2 for s in PROPORTIONS)
    assert next(r.split for r in got if r.component == "old") == "test"
    assert assign(spark.createDataFrame([], "component string, n bigint, split string")).count() == 0


def test_deal_equals_one_by_one():
    rng = random.Random(6)
    for _ in range(200):
        sizes = sorted({rng.randint(1, 50): rng.randint(1, 40) for _ in range(rng.randint(1, 8))}.items(), reverse=True)
        lack = {"a": rng.uniform(0, 90), "b": rng.uniform(0, 20), "c": rng.choice([0.0, -5.0, 10.0])}
        whole = sum(max(v, 0) for v in lack.values())
        owed = [0.0] * 3
        for (size, number), (s, got) in zip(sizes, deal(sizes, lack)):
            owed = [o + max(v, 0) / whole * size * number for o, v in zip(owed, lack.values())]
            assert s == size and sum(got) == number
            owed = [o - g * size for o, g in zip(owed, got)]
            assert max(owed) - min(owed[i] for i in range(3) if got[i]) <= size + 1e-6  # nobody got one that another was owed more
        assert abs(sum(owed)) < 1e-6


def test_update_keeps_and_quarantines(spark, tmp_path):
    e = lambda *x: spark.createDataFrame(list(x), "a string, b string")
    w = lambda *x: spark.createDataFrame(list(x), "node string, n bigint")
    path = str(tmp_path / "c")
    update(spark, path, 0, e(("a", "b"), ("c", "d"), (None, "a")), w(("a", 80), ("b", 1), ("c", 10), ("d", 1), ("t", 10), ("q", 3), (None, 4)))
    was = {r.node: r.split for r in read_components(spark, path, 1).collect()}
    assert was["a"] == was["b"] == "train" and was["c"] == was["d"] and set(was) == set("abcdtq")
    update(spark, path, 1, e(("b", "n"), ("d", "a")), w(("n", 5), ("a", 2)))
    second = {r.node: r for r in read_components(spark, path, 2).collect()}
    joined = "train" if was["c"] == "train" else "quarantine"
    assert {second[k].split for k in "abcdn"} == {joined} and {second[k].component for k in "abcdn"} == {"a"} and second["n"].n == 99
    assert second["t"].split == was["t"] and second["q"].split == was["q"]
    # untouched components are not written again
    assert {r.component for r in spark.read.parquet(f"{path}/states/batch=1").collect()} == {"a"}
    update(spark, path, 2, e(("t", "q"), ("q", "b")), w(("z", 1)))
    third = {r.node: r for r in read_components(spark, path, 3).collect()}
    assert {third[k].component for k in "abcdntq"} == {"a"} and third["t"].n == 112 and third["z"].split in PROPORTIONS
    assert third["t"].split == ("quarantine" if {joined, was["t"], was["q"]} != {joined} else joined)
    update(spark, path, 2, e(("t", "q"), ("q", "b")), w(("z", 1)))  # a batch that runs again replaces itself
    assert {(r.node, r.component, r.n, r.split) for r in read_components(spark, path, 3).collect()} == {(r.node, r.component, r.n, r.split) for r in third.values()}


def test_batches_find_the_components_of_all(spark, tmp_path):
    rng = random.Random(11)
    edges = [(f"n{rng.randrange(90):02d}", f"n{rng.randrange(90):02d}") for _ in range(60)]
    frame = lambda x: spark.createDataFrame(x, "a string, b string")
    weights = lambda x: spark.createDataFrame([(n, 1) for pair in x for n in pair], "node string, n bigint")
    update(spark, f"{tmp_path}/one", 0, frame(edges), weights(edges))
    for b in range(3):
        update(spark, f"{tmp_path}/three", b, frame(edges[b * 20 : b * 20 + 20]), weights(edges[b * 20 : b * 20 + 20]))
    one, three = ({r.node: (r.component, r.n) for r in read_components(spark, f"{tmp_path}/{name}", k).collect()} for name, k in (("one", 1), ("three", 3)))
    assert one == three and sum({c: n for c, n in one.values()}.values()) == 120


def numbered(words):
    seen, out = Counter(), []
    for x in words:
        seen[x] += 1
        out.append(f"{x}#{seen[x]}")
    return out


BAGS = "id string, g string, language string, tokens array<string>, is_train boolean, is_eval boolean"


@pytest.mark.parametrize("agree", [0.5, 0.7, 0.85, 1.0])
def test_near_pairs_against_brute_force(spark, agree):
    rng = random.Random(8)
    sizes = [0, 1, 2, 3, 6, 7, 20, 21, 59, 61, 99, 101, 180, 210]
    rows = []
    for i in range(160):
        base = [f"w{rng.randrange(12 if rng.random() < 0.7 else 200)}" for _ in range(rng.choice(sizes))] if i % 3 == 0 or not rows else list(rows[-1][3])
        for _ in range(rng.choice([0, 1, 2, len(base) // 8, len(base) // 3])):
            if base and rng.random() < 0.5:
                base.pop(rng.randrange(len(base)))
            elif base:
                base[rng.randrange(len(base))] = f"w{rng.randrange(12)}"
        rows.append((str(i), f"g{i % 2}" if rng.random() < 0.3 else "g0", "es", base, rng.random() < 0.7, rng.random() < 0.5))
    bags = spark.createDataFrame([(i, g, l, numbered(t), a, b) for i, g, l, t, a, b in rows], BAGS)
    got = {(r.eval_id, r.train_id) for r in near_pairs(bags.filter("size(tokens) > 0"), agree).collect()}
    want = set()
    for i, g, _, t, _, ev in rows:
        for j, h, _, u, tr, _ in rows:
            if ev and tr and g == h and t and u and sum((Counter(t) & Counter(u)).values()) >= agree * max(len(t), len(u)) - 1e-9:
                want.add((i, j))
    assert got == want and len(want) > 20


def test_near_pairs_of_other_thresholds(spark):
    long = [f"t{i}" for i in range(210)]
    df = spark.createDataFrame([("a", "g", "es", numbered(long), True, False), ("b", "g", "es", numbered(long[:150]), False, True), ("c", "h", "es", ["x#1", "y#1"], True, False), ("d", "h", "es", ["x#1", "z#1"], False, True)], BAGS)
    assert {(r.eval_id, r.train_id) for r in near_pairs(df, 0.7).collect()} == {("b", "a")}
    assert {(r.eval_id, r.train_id) for r in near_pairs(df, 0.5).collect()} == {("b", "a"), ("d", "c")}
    with pytest.raises(ValueError):
        ways(0.0)


def test_cross_split_pairs(spark):
    schema = "row_id bigint, L1 string, split string, L1_context string, L1_source_word string, en_target_word string, source string, load_id bigint, tokens string"
    text = "uno dos tres cuatro cinco seis siete ocho nueve diez"
    rows = [(1, "es", "train", text, "isla", "island", "s", 1, None), (2, None, "dev", text.upper() + "!", "isla; mesa", "the islnad", "s", 2, None), (3, "es", "dev", text[:-4], "isla", "island", "s", 2, None), (4, "es", "dev", "otro texto", "isla", "island", "s", 2, None), (5, "es", "train", text, "isla", "island", "s", 1, None), (6, "es", "dev", None, "isla", "island", "s", 2, None), (7, "es", "dev", text, "mesa", "island", "s", 2, None), (8, "es", "test", text, "isla", "qqqq", "s", 2, None)]
    refs = [(1, WORD, None, "island", None), (2, SOURCE, "es", "isla", None), (3, SOURCE, "es", "mesa", None)]
    items, names = spark.createDataFrame(rows, schema), spark.createDataFrame(refs, REFS)
    got = {(r.train_row, r.eval_row) for r in cross_split_pairs(items, names).collect()}
    assert got == {(1, 2), (1, 3), (5, 2), (5, 3)}
    assert cross_split_pairs(items.filter("false"), names).count() == 0


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}


def test_steps_leave_no_shuffles_and_few_tables(spark):
    """p1's disk: a written step takes its shuffle files with it, and the pairs leave the two tables that they read."""
    def waits_for(left):
        until = time.time() + 20  # shuffles are removed in the background
        while not left() and time.time() < until:
            time.sleep(0.2)
        return left()

    had = shuffle_files(spark)
    kept = durable(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    rows = shuffle_files(spark) - had
    assert kept.count() == 7 and waits_for(lambda: not rows & shuffle_files(spark))
    folder = shared_dir(spark).removeprefix("file://")
    items = spark.createDataFrame([(i, "es", "train" if i % 2 else "dev", f"uno dos tres cuatro {i % 5}", "isla", "island", "s", 1, None) for i in range(20)], "row_id bigint, L1 string, split string, L1_context string, L1_source_word string, en_target_word string, source string, load_id bigint, tokens string")
    names = spark.createDataFrame([(1, WORD, None, "island", None), (2, SOURCE, "es", "isla", None)], REFS)
    tables = set(os.listdir(folder))
    pairs = cross_split_pairs(items, names)
    assert len(set(os.listdir(folder)) - tables) == 2 and pairs.count() == 20


@pytest.mark.parametrize("tokens", [0, 3, 40])
def test_near_pairs_with_more_tokens_than_are_broadcast(spark, monkeypatch, tokens):
    rng = random.Random(4)
    rows = [(str(i), "g", "es", numbered([f"w{min(rng.randrange(90), rng.randrange(90))}" for _ in range(12)]), i % 2 == 0, i % 3 == 0) for i in range(60)]
    rows += [(f"c{i}", "g", "es", [*r[3][:11], "new#1"], not r[4], not r[5]) for i, r in enumerate(rows[:30])]
    monkeypatch.setattr(overlap, "BROADCAST_TOKENS", tokens)
    monkeypatch.setattr(overlap, "BROADCAST_PAIRS", 5)
    got = {(r.eval_id, r.train_id) for r in near_pairs(spark.createDataFrame(rows, BAGS), 0.85).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[5] and b[4] and len(set(a[3]) & set(b[3])) >= 0.85 * 12}
    assert got == want and len(want) > 30
