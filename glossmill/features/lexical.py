"""Surface, clue and overlap features: row-local expressions that collapse into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.similarity import shared_char_ratio
from glossmill.functions.windows import scale_by_max
from glossmill.operators.columns import replace_if_all_zero


def clean_key(c: Column) -> Column:
    """Trimmed lower-case text; NULL and texts that spell a missing value become ''."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("nan", "none", "<na>", "null"), "").otherwise(t)


def syllables(word: Column) -> Column:
    """Vowel groups over a-z letters; a silent final e (not le, ye) doesn't count; at least 1, 0 without letters."""
    w = F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), "[^a-z]", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = w.rlike("e$") & ~w.rlike("(le|ye)$") & (groups > 1)
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), groups - F.when(silent, 1).otherwise(0)))


def letter_ratio(word: Column, letters: str) -> Column:
    """Share of the given letters among a-z letters, 0 without letters."""
    return F.coalesce(F.try_divide(F.regexp_count(F.lower(word), F.lit(f"[{letters}]")), F.regexp_count(F.lower(word), F.lit("[a-z]"))), F.lit(0.0))


def lexical_columns(target: Column, source: Column, clue: Column) -> dict[str, Column]:
    """The row-local lexical columns by name."""
    t, s, c = (F.coalesce(x, F.lit("")) for x in (target, source, clue))
    tk, sk = clean_key(target), clean_key(source)
    visible = F.length(F.replace(c, F.lit("_"), F.lit("")))
    hidden = F.length(c) - visible
    first = F.lower(F.regexp_extract(c, "([A-Za-z])", 1))
    flag = lambda x: x.cast("int")
    return {
        "target_len": F.length(t), "target_syllables": syllables(t), "source_len": F.length(s), "source_syllables": syllables(s),
        "clue_len": F.length(c), "clue_visible_chars": visible, "clue_hidden_chars": hidden, "clue_reveals_first_char": flag(c.rlike("^[\\p{L}\\p{N}]")),
        "clue_matches_target_len": flag(F.length(c) == F.length(t)), "clue_ratio": F.coalesce(F.try_divide(visible, F.length(t)), F.lit(0.0)), "clue_hidden_target_len": F.greatest(F.lit(0), F.length(t) - visible),
        "target_in_source": flag((tk != "") & F.contains(sk, tk)), "source_in_target": flag((sk != "") & F.contains(tk, sk)),
        "target_prefix_in_source": flag((F.length(tk) >= 3) & F.contains(sk, F.substring(tk, 1, 3))), "target_suffix_in_source": flag((F.length(tk) >= 3) & F.contains(sk, F.right(tk, F.lit(3)))),
        "shared_char_ratio": shared_char_ratio(tk, sk), "clue_initial_match": flag((first != "") & (first == F.substring(tk, 1, 1))),
        "target_vowel_ratio": letter_ratio(tk, "aeiou"), "target_consonant_ratio": letter_ratio(tk, "b-df-hj-np-tv-z"),
    }


def lexical_group(df: DataFrame, split: str = "split", target: str = "en_target_word", source: str = "L1_source_word", clue: str = "en_target_clue", frequency: tuple[str, ...] = ("wf_zipf", "wf_value", "subtlex_zipf")) -> DataFrame:
    """All lexical features: row-local columns, frequency aliases of what is there, and lengths over the split's longest."""
    out = df.withColumns(lexical_columns(F.col(target), F.col(source), F.col(clue)))
    known = [F.col(f) for f in frequency if f in df.columns]
    out = out.withColumns({"freq_en": F.coalesce(*known, F.lit(0.0)), "freq_percentile": F.coalesce(*[F.col(c) for c in ("wf_percentile",) if c in df.columns], F.lit(0.0)), "syllables": F.col("target_syllables"), "clue_length": F.col("clue_len"), "pos_encoded": F.lit(-1)})
    out = scale_by_max(out, "source_len", [split], "source_char_len_norm")
    out = scale_by_max(out, "target_len", [split], "target_char_len_norm")
    return replace_if_all_zero(out, {"freq_en": "wf_zipf", "freq_percentile": "wf_percentile", "syllables": "target_syllables", "clue_length": "clue_len"})
