"""Several values packed in one field: dialects chosen by description length.

A dialect is a set of separators and a set of quotes. Every field is parsed under each
dialect whose characters it holds; the parse that is cheapest to write down wins. A value
costs the code length of its frequency among plain single values (counted over all rows),
an unknown value costs its letters, and a structural character that a dialect leaves
unexplained inside a value costs much. All of it is JVM-side: regular expressions with a
pattern column, one join with the value counts and one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import let, strip
from glossmill.session import spread

# Separators by family, and opening and closing quotes by style.
SEPARATORS = {"comma": ",，", "semicolon": ";；", "slash": "/／", "bar": "|｜", "ideographic": "、､", "tab": "\t", "line": "\n\r"}
QUOTES = {
    "double": [('"', '"'), ("＂", "＂")],
    "single": [("'", "'")],
    "paired": [("“", "”"), ("„", "“"), ("„", "”"), ("«", "»"), ("»", "«"), ("「", "」"), ("『", "』"), ("‘", "’"), ("‚", "‘"), ("‹", "›"), ("《", "》")],
}
ALL_SEPARATORS = "".join(SEPARATORS.values())
_QUOTE_CHARS = "".join(sorted({c for style in QUOTES.values() for pair in style for c in pair}))
_PAREN = "[(（][^()（）]*+[)）]"
_NOTE = f"(?<![\\s\\p{{Z}}])[\\s\\p{{Z}}]*+{_PAREN}"
#: Bits for a structural character that a dialect doesn't explain, and for each letter of an unknown value.
STRAY_BITS, LETTER_BITS, NEW_VALUE_BITS = 64.0, 5.0, 12.0


def _escape(chars: str) -> str:
    return "".join("\\" + c if c in "\\^-[]|\"'/" else c for c in chars)


def _quoted(styles: list[str]) -> str:
    parts = []
    for style in styles:
        for a, b in QUOTES[style]:
            parts.append(f"{_escape(a)}(?:[^{_escape(b)}]++|{_escape(b)}{_escape(b)})*+{_escape(b)}" if a == b else f"{a}[^{a}{b}]*+{b}")
    return "(?:" + "|".join(parts) + ")"


def slot_pattern(separators: str, styles: list[str]) -> str:
    """Regular expression whose matches are the slots of a field under a dialect; empty slots give none.

    Every repetition is possessive: Java's matcher then loops, where it else takes a stack frame for each turn,
    so fields of any length and any number of quotes are matched, in linear time.
    """
    chars = _escape(separators)
    plain = f"[^{chars}{_escape(_QUOTE_CHARS)}(（]++|[^{chars}]" if chars else f"[^{_escape(_QUOTE_CHARS)}(（]++|[\\s\\S]"
    start = f"(?:(?<=^)|(?<=[\\s\\p{{Z}}{chars}]))"
    end = f"(?=[\\s\\p{{Z}}]*(?:$|[(（]{'|[' + chars + ']' if chars else ''}))"
    return "(?:" + (f"{start}{_quoted(styles)}{end}|" if styles else "") + f"{_PAREN}|{plain})++"


def _sets(kinds: dict) -> dict:
    """The named sets of a dialect's side: none, each kind, all."""
    return {"none": []} | {k: [k] for k in kinds} | {"all": list(kinds)}


def _present(field: Column, kinds: dict[str, str]) -> Column:
    """Sets worth trying: none, the kinds that occur and, where several do, all."""
    some = F.array_compact(F.array(*[F.when(field.rlike(f"[{_escape(chars)}]"), F.lit(kind)) for kind, chars in kinds.items()]))
    return let(some, lambda s: F.concat(F.array(F.lit("none")), s, F.when(F.size(s) > 1, F.array(F.lit("all"))).otherwise(F.array().cast("array<string>"))))


def _slots(field: Column, sep: Column, quote: Column) -> Column:
    """Slots under the dialect (sep, quote): one branch with a constant, once compiled pattern each."""
    out = None
    for s, families in _sets(SEPARATORS).items():
        for q, styles in _sets(QUOTES).items():
            chars = "".join(SEPARATORS[f] for f in families)
            here, found = (sep == s) & (quote == q), F.regexp_extract_all(field, F.lit(slot_pattern(chars, styles)), F.lit(0))
            out = F.when(here, found) if out is None else out.when(here, found)
    return out


def _clean(slot: Column, quote: Column) -> Column:
    """Struct of a slot: its value without notes, outer blanks and enclosing quotes, and the stray characters left in it."""
    quoted = F.lit("")
    for q, styles in _sets(QUOTES).items():
        if styles:
            quoted = F.when(quote == q, F.regexp_extract(slot, f"^[\\s\\p{{Z}}]*+({_quoted(styles)})[\\s\\p{{Z}}]*+(?:{_PAREN}[\\s\\p{{Z}}]*+)*+$", 1)).otherwise(quoted)

    def cleaned(q: Column) -> Column:
        inner = F.replace(F.replace(F.substring(q, F.lit(2), F.length(q) - 2), F.lit('""'), F.lit('"')), F.lit("''"), F.lit("'"))
        bare = strip(F.regexp_replace(slot, _NOTE, ""))
        stray = F.length(F.regexp_replace(bare, f"[^{_escape(ALL_SEPARATORS + _QUOTE_CHARS)}()（）]", ""))
        return F.when(q != "", F.struct(strip(inner).alias("value"), F.lit(0).alias("stray"))).otherwise(F.struct(bare.alias("value"), stray.alias("stray")))

    return let(quoted, cleaned)


def parse_fields(fields: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Parse every distinct field with its cheapest dialect.

    fields: a column `field` (distinct, not NULL) and `n`, how many rows hold it.
    Returns field, dialect, bits, `parts` (array of values in order, empty slots and
    parenthesised notes left out) and `has_note`. A field without any structural character is
    its own single value. Empty fields give an empty array. Long fields are parsed whole.
    """
    structural = f"[{_escape(ALL_SEPARATORS + _QUOTE_CHARS)}(（]"
    simple, packed = fields.filter(~F.col("field").rlike(structural)), spread(fields.filter(F.col("field").rlike(structural)), "field")
    own = strip(F.col("field"))
    single = simple.select("field", F.lit("none+none").alias("dialect"), F.lit(0.0).alias("bits"), F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")).alias("parts"), F.lit(False).alias("has_note"))
    if counts is None:
        counts = simple.groupBy(F.lower(own).alias("code")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    known = counts.filter(F.col("code") != "").crossJoin(F.broadcast(total)).select("code", (F.log2(F.col("total") / F.col("n")) + 1).alias("known_bits"))

    own_quotes = {q: "".join(a + b for a, b in pairs) for q, pairs in QUOTES.items()}
    # fields travel by their digest: a long one would else be repeated beside each of its own values
    packed = packed.withColumn("fid", F.md5("field"))
    tried = packed.select("fid", "field", F.explode(_present(F.col("field"), SEPARATORS)).alias("sep"), _present(F.col("field"), own_quotes).alias("quotes")).select("fid", "field", "sep", F.explode("quotes").alias("quote"))
    slots = F.filter(F.transform(_slots(F.col("field"), F.col("sep"), F.col("quote")), lambda s: _clean(s, F.col("quote"))), lambda x: (x["value"] != "") & ~x["value"].rlike(f"^[{_escape(_QUOTE_CHARS)}]+$"))
    # a dialect with more kinds of separators or quotes needs more bits to name, and for each separator
    named = lambda c: F.when(c == "all", 2.0).when(c == "none", 0.0).otherwise(1.0)
    tried = tried.select("fid", F.concat_ws("+", "sep", "quote").alias("dialect"), slots.alias("slots"), (1 + named(F.col("sep")) + named(F.col("quote"))).alias("name_bits"), F.when(F.col("sep") == "all", 3.0).otherwise(1.0).alias("sep_bits"))
    tried = tried.select("fid", "dialect", "slots", (F.col("name_bits") + F.col("sep_bits") * F.size("slots")).alias("shape_bits"))
    values = tried.select("fid", "dialect", "shape_bits", F.posexplode_outer("slots").alias("at", "slot"))
    unknown = NEW_VALUE_BITS + LETTER_BITS * F.length("slot.value")
    spelled = values.withColumn("code", F.lower("slot.value")).join(known, "code", "left")
    bits = F.coalesce(F.least(F.col("known_bits"), unknown), unknown, F.lit(0.0)) + STRAY_BITS * F.coalesce(F.col("slot.stray"), F.lit(0))
    placed = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.col("slot.value").alias("value")))))
    scored = spelled.groupBy("fid", "dialect").agg(F.round(F.sum(bits) + F.first("shape_bits"), 6).alias("bits"), placed.alias("parts"))
    best = scored.groupBy("fid").agg(F.min_by(F.struct("dialect", "bits", "parts"), F.struct("bits", "dialect")).alias("b"))
    return single.unionByName(packed.join(best, "fid").select("field", "b.dialect", "b.bits", F.col("b.parts.value").alias("parts"), F.col("field").rlike(_PAREN).alias("has_note")))


def distinct_fields(rows: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL fields with their number of rows."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("field")).agg(F.count("*").alias("n"))


def split_values(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row per value of `column` with its position from 1, for fields of two or more values.

    keys are carried along; NULL and empty fields give no row; repeated rows give their own.
    """
    several = parse_fields(distinct_fields(rows, column)).filter(F.size("parts") >= 2)
    packed = rows.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("field")).filter(F.col("field").rlike(f"[{_escape(ALL_SEPARATORS)}]"))
    out = packed.join(several.select("field", "parts"), "field").select(*keys, F.posexplode("parts").alias("at", "value_text"))
    return out.select(*keys, (F.col("at") + 1).alias("value_no"), "value_text")
