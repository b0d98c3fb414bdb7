"""Packing, leaks and sentence units: invariants, brute force and worked examples."""

import random

import pytest

from glossmill.llm.leaks import Index, fold, leaked, shingles
from glossmill.llm.packing import combine_windows, pack, pack_windows, packing_report, token_count
from glossmill.llm.sentences import ALONE, Model, best_path, fit, lattice, sentence_spans, split_sentences


def test_pack_places_everything_once(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 7, 100, 600, 1100, 2047, 2048, 2049, 5000]) for _ in range(1_500)]
    df = spark.createDataFrame([(i, "x", n) for i, n in enumerate(sizes)], "doc_id bigint, text string, n_tokens int")
    rows = pack(df).collect()
    boxes, pieces = {}, {}
    for r in rows:
        boxes.setdefault(r.container_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    assert {d: sum(p.n_tokens for p in ps) for d, ps in pieces.items()} == dict(enumerate(sizes))
    for d, ps in pieces.items():
        assert len(ps) == max(1, -(-sizes[d] // 2048)) and sorted(p.piece_no for p in ps) == list(range(len(ps)))
    for b in boxes.values():
        b.sort(key=lambda r: r.place)
        assert [r.place for r in b] == list(range(len(b)))
        at = 0
        for r in b:
            assert r.start_token == at
            at += r.n_tokens
        assert at <= 2048
    assert len(boxes) <= sum(sizes) / 2048 * 1.05 + 2
    windows, steps = {}, {}
    for r in rows:
        windows.setdefault((r.container_id, r.window), []).append(r)
        steps.setdefault(r.step, set()).add(r.container_id)
    for ws in windows.values():
        ws.sort(key=lambda r: r.start_token)
        assert sum(w.n_tokens for w in ws) <= ws[0].tier and all(x.start_token + x.n_tokens == y.start_token for x, y in zip(ws, ws[1:]))
    assert len({w for _, w in windows}) == len(windows)  # a window lies in one container
    assert max(map(len, steps.values())) - min(map(len, steps.values())) <= 1
    report = {r.tier: r for r in packing_report(pack(df)).collect()}
    assert report["all"].n_units == len(boxes) and report["all"].n_tokens == sum(sizes) and report["all"].fullest <= 2048
    assert sum(report[k].n_tokens for k in ("2048", "1024", "512") if k in report) == sum(sizes)


def test_tiers_decide_the_place():
    # longest first: 1,500 leaves a gap of 548, which takes 520 (tier 1,024) rather than a second 1,024 window
    where, tiers = pack_windows([1500, 900, 520, 500, 100, 28, 12], [2048, 1024, 512])
    assert tiers == [2048, 1024, 512]
    assert where == [0, 1, 0, 2, 1, 0, 1]
    # without tiers the 500 would join the 900 in a container of 2,048
    assert pack_windows([1500, 900, 520, 500, 100, 28, 12], [2048])[0][3] == 1
    assert combine_windows([1024, 512, 512, 2048, 10], 2048) == [1, 1, 1, 0, 2]


def test_pack_counts_missing_sizes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", None), (3, "ab cdefg, 录制", None)], "doc_id bigint, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in pack(df).collect()} == {1: 0, 2: 0, 3: 6}
    assert pack(df.filter("false")).count() == 0
    assert df.select(token_count(df.text).alias("n")).collect()[2].n == 6


def words(rng, n):
    return [f"w{rng.randrange(40)}" for _ in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    passages = [(i, "de", " ".join(words(rng, rng.randint(5, 60)))) for i in range(40)] + [(100 + i, "cn", "".join(chr(0x4E00 + rng.randrange(30)) for _ in range(rng.randint(15, 60)))) for i in range(30)] + [(900, "de", None), (901, "cn", "")]
    docs = []
    for d in range(200):
        body = words(rng, rng.randint(0, 50))
        pid, lang, text = rng.choice(passages[:70])
        if lang == "de":
            own = text.split()
            a = rng.randrange(len(own))
            body[len(body) // 2 : len(body) // 2] = own[a : a + rng.randint(8, 20)]
            docs.append((d, ", ".join(body).upper()))
        else:
            a = rng.randrange(len(text))
            docs.append((d, "x " + text[a : a + rng.randint(15, 30)] + "。"))
    docs += [(500, None), (501, "")]
    want = set()
    for d, t in docs:
        folded = fold(t or "")
        import re

        w = re.findall(r"[^\W_]+", folded)
        for p, lang, text in passages:
            pw = re.findall(r"[^\W_]+", fold(text or ""))
            unit, size = ("char", 20) if lang == "cn" else ("word", 13)
            if set(shingles(w, "".join(w), unit, size)) & set(shingles(pw, "".join(pw), unit, size)):
                want.add((d, p))
    got = leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "passage_id bigint, lang string, text string"))
    rows = [tuple(r) for r in got.collect()]
    assert want and set(rows) == want and len(rows) == len(want)


def test_search_equals_scoring_all():
    rng = random.Random(12)
    passages = [(i, "de", " ".join(words(rng, rng.randint(13, 40)))) for i in range(400)]  # lists of many blocks
    index = Index(passages, "word")
    terms = sorted(index.postings)
    assert max(len(x[3]) for x in index.postings.values()) >= 1
    skewed = Index([(i, "de", " ".join(f"w{(i + k) % 3 if rng.random() < 0.97 else rng.randrange(9)}" for k in range(20))) for i in range(500)], "word")
    assert max(len(x[3]) for x in skewed.postings.values()) > 3
    for ix, pool in ((index, terms), (skewed, sorted(skewed.postings))):
        for _ in range(150):
            asked = set(rng.sample(pool, min(len(pool), rng.randint(1, 60)))) | {"w0 w0 w0 w0 nothing"}
            scores = {}
            for t in asked & ix.postings.keys():
                for p, s in zip(*ix.postings[t][:2]):
                    scores[p] = scores.get(p, 0.0) + s
            want = {p for p, s in scores.items() if s >= ix.least[p] + 1e-6}
            got = ix.search(asked)
            assert len(got) == len(set(got)) and want <= set(got) <= {p for p, s in scores.items() if s >= ix.least[p] - 1e-6}


def test_many_blocks_in_one_pass(spark):
    rng = random.Random(13)
    passages = [(i, "de", " ".join(words(rng, 20))) for i in range(60)]
    docs = [(i, "so " + t) for i, _, t in passages]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "passage_id bigint, lang string, text string")
    assert sorted(map(tuple, leaked(*frames, block_chars=300).collect())) == sorted(map(tuple, leaked(*frames).collect()))


def test_leaks_see_through_disguise(spark):
    text = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn"
    docs = [(1, "Vorher. EINS  zwei,\ndrei vier fünf sеchs sieben acht n­eun zehn elf zwolf dreizehn!"), (2, text.rsplit(" ", 1)[0]), (3, "viel " * 20_000 + text)]
    got = leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, "de", text)], "passage_id bigint, lang string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7), (3, 7)]
    assert Index([], "word").find(["a"] * 20, "a" * 20) == []


CASES = {
    "": [],
    " \n\n ": [],
    "Word list, unit 6\n\nIt rains. It snows.": ["Word list, unit 6", "It rains.", "It snows."],
    "“Pavin measured an old map!” asked Bidon. Then he left.": ["“Pavin measured an old map!” asked Bidon.", "Then he left."],
    "Tokem said, “It is late... Go home.” After that he slept.": ["Tokem said, “It is late... Go home.”", "After that he slept."],
    "«¡Bijol traía las llaves!», añadió Sovin. —¿Y Pavin? —preguntó Suvin. Fin.": ["«¡Bijol traía las llaves!», añadió Sovin.", "—¿Y Pavin? —preguntó Suvin.", "Fin."],
    "M. P. Davin kopierte z. B. 3 Karten, usw. Mehr am 3. Mai um 9.30 Uhr.": ["M. P. Davin kopierte z. B. 3 Karten, usw.", "Mehr am 3. Mai um 9.30 Uhr."],
    "He saw Mr. Gulit, etc. and left… then slept. No. 9 stayed in list_2.csv.": ["He saw Mr. Gulit, etc. and left… then slept.", "No. 9 stayed in list_2.csv."],
    "1. 他说：“好！坏？”天黑了……但是晴。“走吧！”小玥说。平均1,900.93页。": ["1. 他说：“好！坏？”", "天黑了……但是晴。", "“走吧！”小玥说。", "平均1,900.93页。"],
    "3. “他走了！”小玥说。阿甜说：“好。”“坏？”小荷问道。": ["3. “他走了！”小玥说。", "阿甜说：“好。”", "“坏？”小荷问道。"],
    "One ends.Two starts (quite gladly!) so on\nand on. Three": ["One ends.", "Two starts (quite gladly!) so on\nand on.", "Three"],
}


@pytest.mark.parametrize("text", list(CASES))
def test_sentence_examples(text):
    spans = sentence_spans(text)
    assert [text[a:b] for a, b in spans] == CASES[text]


def unpruned(block, chinese, model):
    """Best sum over all boundaries and all spans, and the sum of given boundaries (positions)."""
    l = lattice(block, chinese, model, pruned=False)
    n = len(l.ends)

    def span(i, j):
        lone = ALONE if l.alone.get(i) == l.ends[j] and j < n - 1 else 0.0
        return model.length_score(l.ends[j] - l.starts[i], chinese) + lone + (l.gains[j] if j < n - 1 else 0.0)

    best = [0.0]
    for j in range(n):
        best.append(max(best[i] + span(i, j) for i in range(j + 1)))

    def total(ends):
        i, s = 0, 0.0
        for e in ends:
            j = l.ends.index(e)
            s, i = s + span(i, j), j + 1
        return s

    return best[n], total


def test_the_programme_equals_the_unpruned_one():
    rng = random.Random(4)
    model = Model({"b": -3.5, "ab": 0.7, "录": -1.0}, {"A": 0.4, "B": -0.9}, {False: (1.8, 0.4), True: (1.5, 0.3)})
    for k in range(600):
        block = "".join(rng.choice(["ab", "A", "B", " ", ". ", "! ", "…", "。", "，", "“", "”", "(", ")", "录", "1", ".", ": “ab.” ", "2. “录。”录。"]) for _ in range(rng.randint(1, 60)))
        if not block.strip():
            continue
        for m in (model, Model()):
            l = lattice(block, k % 2 == 0, m)
            best, total = unpruned(block, k % 2 == 0, m)
            assert abs(total([l.ends[j] for j in best_path(l, m)]) - best) < 1e-6, block


def test_length_and_words_decide_where_marks_leave_it_open():
    tail = "x" * 40
    soft = f"{tail}… {tail}"
    assert sentence_spans(soft) == [(0, len(soft))]
    text = "He paid approxim. Two coins lay there."
    assert len(sentence_spans(text)) == 2 and len(sentence_spans(text, Model({"approxim": -8.0}))) == 1
    # the same mark cuts or not by the length of what it would leave
    short, doubt = "Ab. Cd", {"ab": -3.4}
    assert len(sentence_spans(short, Model(doubt, length={False: (1.8, 0.3), True: (3.2, 0.5)}))) == 1
    assert len(sentence_spans(short, Model(doubt, length={False: (0.9, 0.3), True: (3.2, 0.5)}))) == 2
    assert len(sentence_spans("Now she slept… Cd", Model(length={False: (3.0, 0.3), True: (3.2, 0.5)}, opening={"Cd": -1.0}))) == 2


def test_fit_learns_from_certain_marks(spark):
    texts = ["The dog ran zzt. the long way home. Then the Cat slept.\n\nThe end came."] * 200 + ["小猫睡了。\n\n小狗也睡了！"] * 60
    model = fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert model.closing["zzt"] < -4 and model.closing["came"] > 0 and model.opening["The"] > 0 > model.opening["Cat"]
    assert abs(model.length[True][0] - 1.7) < 0.2
    assert fit(spark.createDataFrame([], "doc_id bigint, text string")) == Model()


def test_fit_counts_every_document(spark):
    # far more documents than a sample would hold; each mark is in one document only
    texts = spark.range(25_000).selectExpr("id AS doc_id", "concat('He took zz', translate(CAST(id AS STRING), '0123456789', 'abcdefghij'), '. Then.') AS text")
    last = spark.range(25_000).selectExpr("id + 25000 AS doc_id", "concat('It was qq', translate(CAST(id AS STRING), '0123456789', 'abcdefghij'), '.') AS text")
    closing = fit(texts.unionByName(last)).closing
    assert sum(w.startswith("qq") for w in closing) == 25_000 and "then" in closing


def test_many_marks_take_little_time():
    import time

    for text in ("x… " * 8_000, "X… " * 8_000, "“x。”" * 6_000, "a.b" * 8_000, "Ab c. " * 4_000, "z. " * 8_000):
        began = time.time()
        sentence_spans(text)
        assert time.time() - began < 2.0


def test_sentence_spans_cover_and_are_ordered(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice('ab A.!?…。，“”„«»()—\n" 录1') for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["a. " * 5_000, "(" * 3_000 + "x. Y."]
    rows = split_sentences(spark.createDataFrame([*enumerate(texts), (9_999, None)], "doc_id bigint, text string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    assert 9_999 not in by
    for d, t in enumerate(texts):
        spans = sorted(by.get(d, []))
        assert all(a < b and t[a:b] == t[a:b].strip() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        inside = "".join(t[a:b] for a, b in spans)
        assert "".join(inside.split()) == "".join(t.split())
