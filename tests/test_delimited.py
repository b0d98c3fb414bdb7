"""Packed fields against a direct state machine, and the defined corner cases."""

import random

from glossmill.operators.delimited import split_values

SEPS = ",;/|、，；／｜\t\n"
PAIRS = {'"': '"', "„": "“", "«": "»", "「": "」", "'": "'"}


def brute(field):
    """Values of a well-formed field: split at separators outside quotes and parentheses."""
    slots, cur, i = [], "", 0
    while i < len(field):
        c = field[i]
        if c in PAIRS and not cur.strip():
            end = i + 1
            while True:
                end = field.index(PAIRS[c], end)
                if PAIRS[c] == c and field[end + 1 : end + 2] == c:
                    end += 2
                    continue
                break
            slots.append(field[i + 1 : end].replace('""', '"'))
            cur, i = None, end + 1
            while i < len(field) and field[i] not in SEPS:
                i += field[i:].index(")") + 1 if field[i] == "(" else 1
            i += 1
            cur = ""
            continue
        if c == "(":
            i += field[i:].index(")") + 1
            continue
        if c in SEPS:
            slots.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    slots.append(cur)
    return [s.strip() for s in slots if s.strip()]


def run(spark, fields):
    df = spark.createDataFrame(list(enumerate(fields)), "row_id bigint, w string")
    out = {}
    for r in split_values(df, "w", ["row_id"]).collect():
        out.setdefault(r.row_id, []).append((r.value_no, r.value_text))
    return [[v for _, v in sorted(out.get(i, []))] for i in range(len(fields))]


def test_against_state_machine(spark):
    rng = random.Random(4)
    words = ["haus", "rojo", "录制", "sich erinnern", "casa", "mesa"]
    fields = list(words) * 3

    def value():
        k = rng.random()
        w = rng.choice(words)
        if k < 0.2:
            a = rng.choice(list(PAIRS))
            return f"{a}{w}, {rng.choice(words)}{PAIRS[a]}"
        return f'"{w} ""{rng.choice(words)}"""' if k < 0.25 else w

    for _ in range(150):
        n = rng.randint(1, 4)
        text = value()
        for _ in range(n - 1):
            text += rng.choice(["", " "]) + rng.choice(SEPS) + rng.choice(["", " "]) + value()
        if rng.random() < 0.3:
            text += f" (nicht: {rng.choice(words)}, {rng.choice(words)})"
        if rng.random() < 0.2:
            text += " ;"
        fields.append(text)
    got = run(spark, fields)
    for f, g in zip(fields, got):
        want = brute(f)
        assert g == (want if len(want) > 1 else []), f


def test_corner_cases(spark):
    fields = [None, "", " ; ", "a", "a;a", "a;;b", "(x, y)", "“a; b", "a" * 20_000 + ";b", "(" * 20_000 + ";b", "'" * 20_000 + ";b", "x 'y' " * 3_000 + ";b"]
    got = run(spark, fields)
    assert got[:8] == [[], [], [], [], ["a", "a"], ["a", "b"], [], ["“a", "b"]]
    assert [len(v) for v in got[8]] == [20_000, 1]
    assert all(v[-1] == "b" for v in got[8:] if v) and len(got[11]) == 2
    assert split_values(spark.createDataFrame([], "row_id bigint, w string"), "w", ["row_id"]).count() == 0


def test_repeated_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a;b", "x"), (1, "a;b", "y")], "row_id bigint, w string, parts string")
    assert split_values(df, "w", ["row_id"]).count() == 4


def test_any_number_of_quoted_values(spark):
    for n in (240, 260, 5_000):
        fields = [sep.join(f"{a}u{i}, v{b}" for i in range(n)) for a, b, sep in (('"', '"', "; "), ("“", "”", ";"), ("«", "»", ", "))]
        assert run(spark, fields) == [[f"u{i}, v" for i in range(n)]] * 3
    noted = "; ".join(f"w{i} (nicht: x, y)" for i in range(3_000))
    assert run(spark, [noted, "„x " * 10_000 + ";b"])[0] == [f"w{i}" for i in range(3_000)]
