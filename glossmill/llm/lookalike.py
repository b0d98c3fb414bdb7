"""One consistent form of text that looks the same.

Values are mapped natively (invisible characters out, wide forms, odd blanks, ligatures and radicals to
plain ones, look-alike letters inside Latin words to Latin). Mapped values that the accent-sensitive
Unicode collation holds equal form a class, composed and decomposed spellings among them; SQL groups them,
the class's canonical member is its smallest one without combining marks (composed from the smallest if
none), it is joined back to the values and decides their form. The collation also holds equal what does not
look the same (digits of other scripts, ignored marks and control characters): a member counts only for values
of the same letters and marks.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import BLANKS, INVISIBLE, compose, let, look_alike_map

#: Single letters that Unicode composes to another single one (Kelvin and Angstrom signs, compatibility ideographs), and those.
TWINS = {chr(p): unicodedata.normalize("NFC", chr(p)) for p in range(0x80, 0x2FA20) if unicodedata.category(chr(p))[0] == "L" and unicodedata.normalize("NFC", chr(p)) != chr(p) and len(unicodedata.normalize("NFC", chr(p))) == 1}

#: Only values with one of these can change: everything else is its own canonical form.
SUSPICIOUS = "[\\p{M}\\p{IsGreek}\\p{IsCyrillic}\\x{2126}\\x{212a}\\x{212b}\\x{f900}-\\x{faff}\\x{2f800}-\\x{2fa1f}\\x{ff10}-\\x{ff19}\\x{ff21}-\\x{ff3a}\\x{ff41}-\\x{ff5a}\\x{fb00}-\\x{fb06}\\x{132}\\x{133}\\x{1c4}-\\x{1cc}\\x{1f1}-\\x{1f3}\\x{2e80}-\\x{2fd5}" + "".join(f"\\x{{{ord(c):x}}}" for c in INVISIBLE + BLANKS) + "]"

#: Texts of nothing but these, most of all, can't: a quick test before the long one.
SAFE = "^[\\x00-\\x7f\\x{c0}-\\x{ff}\\x{4e00}-\\x{9fff}\\x{a1}-\\x{ac}\\x{ae}-\\x{bf}\\x{3001}-\\x{3029}\\x{ff01}-\\x{ff0f}\\x{ff1a}-\\x{ff20}\\x{2010}-\\x{2027}]*+$"

CLASSES = """
SELECT field_name, collate(mapped, 'UNICODE') AS class_key, min(struct(mapped RLIKE '\\\\p{{M}}' AS marked, mapped AS member)).member AS member, count(*) AS n
FROM {values}
GROUP BY field_name, collate(mapped, 'UNICODE')
"""

JOINED = """
SELECT v.*, c.member FROM {values} v JOIN {classes} c ON v.field_name = c.field_name AND collate(v.mapped, 'UNICODE') = c.class_key
"""


@cache
def _spelled() -> dict[str, str]:
    """Composed letter -> its fully decomposed spelling, for the alphabets, kana included."""
    spelled = {chr(p): unicodedata.normalize("NFD", chr(p)) for p in range(0xC0, 0x3100)}
    return {letter: marks for letter, marks in spelled.items() if letter != marks}


def compose_stacks(c: Column) -> Column:
    """compose(), and the first marks of stacks that have no letter of their own."""
    clusters = lambda t: F.regexp_extract_all(t, F.lit("(?s)[^\\p{M}]\\p{M}*|\\p{M}+"), F.lit(0))
    cut = lambda g, n: F.concat(compose(F.substring(g, 1, n)), F.substring(g, n + 1, 1 << 20))
    # a shorter result means that the first marks were joined; the longest join wins
    first = lambda g: F.when(F.length(cut(g, 3)) < F.length(g) - 1, cut(g, 3)).otherwise(cut(g, 2))
    one = lambda g: F.when(F.length(g) > 2, first(g)).otherwise(g)
    return let(compose(c), lambda t: F.when(t.rlike("\\p{M}{2}"), F.array_join(F.transform(clusters(t), one), "")).otherwise(t))


def letters_and_marks(c: Column) -> Column:
    """Sorted single characters of text, composed letters taken apart: equal for spellings of the same letters and marks."""
    table = F.from_json(F.lit(json.dumps(_spelled())), "map<string,string>")
    apart = lambda t: F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.array_sort(F.regexp_extract_all(F.array_join(apart(c), ""), F.lit("(?s)."), F.lit(0)))


def consistent_values(rows: DataFrame, fields: Sequence[str], keys: Sequence[str], every: bool = False) -> DataFrame:
    """Values that may be disguised with their consistent form: keys, field_name, value, consistent, changed.

    Every row and field counts for the classes. every: all values come out, those that can't be disguised as they
    are; else the suspicious ones only. NULL gives no row, an empty text is consistent; repeated rows each come out; values are never cut.
    Names of the carried keys must differ from field_name, value, mapped.
    """
    spark = rows.sparkSession
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("x")).select(*keys, "x.field_name", "x.value").filter("value IS NOT NULL")
    long = long.withColumn("suspicious", F.when(F.col("value").rlike(SAFE), False).otherwise(F.col("value").rlike(SUSPICIOUS)))
    mapped = long.withColumn("mapped", F.when(F.col("suspicious"), look_alike_map(F.translate("value", "".join(TWINS), "".join(TWINS.values())))).otherwise(F.col("value")))
    classes = spark.sql(CLASSES, values=mapped.select("field_name", "mapped"))
    joined = spark.sql(JOINED, values=mapped.filter("suspicious").drop("suspicious"), classes=classes)
    joined = joined.withColumns({"own": compose_stacks(F.col("mapped")), "form": compose_stacks(F.col("member"))})
    same = (F.col("own") == F.col("form")) | (letters_and_marks(F.col("own")) == letters_and_marks(F.col("form")))
    out = joined.withColumn("consistent", F.when(same, F.col("form")).otherwise(F.col("own")))
    out = out.select(*keys, "field_name", "value", "consistent", (F.col("consistent") != F.col("value")).alias("changed"))
    plain = long.filter("NOT suspicious").select(*keys, "field_name", "value", F.col("value").alias("consistent"), F.lit(False).alias("changed"))
    return out.unionByName(plain) if every else out
