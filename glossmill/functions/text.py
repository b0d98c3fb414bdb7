"""Native text folding: columns in, columns out, no Python per row.

Spark has no NORMALIZE(); the parts of NFC/NFKC that disguised text needs are built
here from rules over Python's Unicode data on the driver and run in the JVM.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters (zero-width, joiners, soft hyphen, marks of direction).
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"

# Blanks other than the plain one.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# Cyrillic and Greek letters that look like a Latin one.
LOOK_ALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y", "к": "k", "м": "m", "т": "t", "г": "r", "п": "n", "и": "u", "в": "b", "н": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
}

# Radicals without a compatibility mapping, with the characters they look like.
RADICALS = {
    "⺁": "厂", "⺄": "乙", "⺈": "刀", "⺊": "卜", "⺌": "小", "⺍": "小", "⺕": "彐", "⺜": "日", "⺝": "月", "⺟": "母", "⺠": "民", "⺩": "王", "⺬": "示", "⺮": "竹", "⺶": "羊", "⺼": "肉",
    "⻁": "虎", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻳": "龟",
}

# Traditional characters and their simplified forms, common ones.
TRADITIONAL = dict(
    zip(
        "詩邊變參長車處詞達帶單燈點電東動對兒發飛風關館廣規國護畫環機記紙紅綠價間見節經結進軍開來藍樂類練煉鍊靈樓錄馬滿門鳥農氣橋慶區熱聲師時實識書樹雙歲題體鐵聽團圖萬為衛習線現銀鏡鍛網葉葯藥醫應運雜種總質園圓遠雲問學島廚戶條樣計話語談諾講讀陽魚黃們傘場層憶擇測獲禮筆莊許誌誠譯貴較遊遞選鄰釋鉛雖靜飢鬆鬧麗麵",
        "诗边变参长车处词达带单灯点电东动对儿发飞风关馆广规国护画环机记纸红绿价间见节经结进军开来蓝乐类练炼炼灵楼录马满门鸟农气桥庆区热声师时实识书树双岁题体铁听团图万为卫习线现银镜锻网叶药药医应运杂种总质园圆远云问学岛厨户条样计话语谈诺讲读阳鱼黄们伞场层忆择测获礼笔庄许志诚译贵较游递选邻释铅虽静饥松闹丽面",
        strict=True,
    )
)


@cache
def _one_to_one() -> tuple[str, str]:
    """Single characters that stand for another single one: wide forms, blanks, radicals."""
    pairs = {b: " " for b in BLANKS} | RADICALS
    for low, high in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0x2F00, 0x2FD5), (0x2E80, 0x2EFF)):
        for point in range(low, high + 1):
            plain = unicodedata.normalize("NFKC", chr(point))
            if len(plain) == 1 and plain != chr(point):
                pairs[chr(point)] = plain
    return "".join(pairs), "".join(pairs.values())


@cache
def _ligatures() -> dict[str, str]:
    """Presentation ligatures and digraph letters with their plain letters, by rule."""
    found = {}
    for low, high in ((0xFB00, 0xFB06), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3)):
        for point in range(low, high + 1):
            found[chr(point)] = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", chr(point)))
    return found


@cache
def _composites() -> dict[str, str]:
    """Decomposed spelling -> composed letter, for every composite in the Latin, Greek and Cyrillic blocks."""
    found = {}
    for low, high in ((0x00C0, 0x024F), (0x0370, 0x052F), (0x1E00, 0x1FFF)):
        for point in range(low, high + 1):
            letter = chr(point)
            spelled = unicodedata.normalize("NFD", letter)
            if len(spelled) > 1 and unicodedata.normalize("NFC", letter) == letter:
                found[spelled] = letter
                if len(spelled) == 3:  # partly composed spellings of letters with two marks
                    found[unicodedata.normalize("NFC", spelled[:2]) + spelled[2]] = letter
                    if unicodedata.combining(spelled[1]) != unicodedata.combining(spelled[2]):
                        found[spelled[0] + spelled[2] + spelled[1]] = letter
    return found


_CLASS_INVISIBLE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in INVISIBLE) + "]"
_CLASS_LIGATURES = "[\\x{fb00}-\\x{fb06}\\x{132}\\x{133}\\x{1c4}-\\x{1cc}\\x{1f1}-\\x{1f3}]"
_WORD = "[\\p{IsLatin}\\p{IsGreek}\\p{IsCyrillic}\\p{M}]"
_FOREIGN = "[\\p{IsGreek}\\p{IsCyrillic}]"
#: No character outside this class can be a disguise; most rows stop at this test.
PLAIN = "^[\\x00-\\x7f]*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated, and present in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drop_invisible(c: Column) -> Column:
    """Remove zero-width characters and soft hyphens."""
    return F.regexp_replace(c, _CLASS_INVISIBLE, "")


def compose(c: Column) -> Column:
    """Join letters and combining marks to composed letters; text without marks passes untouched."""
    table = F.from_json(F.lit(json.dumps(_composites())), "map<string,string>")  # folded to one literal
    cluster = lambda g: F.when(F.length(g) > 1, F.coalesce(F.try_element_at(table, g), g)).otherwise(g)
    joined = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)[^\\p{M}]\\p{M}*|\\p{M}+"), F.lit(0)), cluster), "")
    return let(c, lambda t: F.when(t.rlike("\\p{M}"), joined(t)).otherwise(t))


def plain_letters(c: Column) -> Column:
    """Wide forms, ligatures, odd blanks and radicals to their plain characters."""
    source, target = _one_to_one()

    def spelled(out: Column) -> Column:
        for ligature, letters in _ligatures().items():
            out = F.replace(out, F.lit(ligature), F.lit(letters))
        return out

    return let(F.translate(c, source, target), lambda t: F.when(t.rlike(_CLASS_LIGATURES), spelled(t)).otherwise(t))


def latin_in_latin_words(c: Column) -> Column:
    """Look-alike letters to Latin ones inside words that also hold a Latin letter.

    Words written wholly in another alphabet stay.
    """
    source, target = "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values())
    parts = lambda t: F.regexp_extract_all(t, F.lit(f"(?s){_WORD}+|[^\\p{{IsLatin}}\\p{{IsGreek}}\\p{{IsCyrillic}}\\p{{M}}]+"), F.lit(0))
    one = lambda w: F.when(w.rlike(_FOREIGN) & w.rlike("\\p{IsLatin}"), F.translate(w, source, target)).otherwise(w)
    return let(c, lambda t: F.when(t.rlike(_FOREIGN) & t.rlike("\\p{IsLatin}"), F.array_join(F.transform(parts(t), one), "")).otherwise(t))


def look_alike_map(c: Column) -> Column:
    """Everything but composition: invisible characters, plain letters, look-alikes."""
    return let(c, lambda t: F.when(t.rlike(PLAIN), t).otherwise(latin_in_latin_words(plain_letters(drop_invisible(t)))))


def consistent(c: Column) -> Column:
    """One consistent form of visually identical text; NULL stays NULL."""
    return let(c, lambda t: F.when(t.rlike(PLAIN), t).otherwise(compose(look_alike_map(t))))


def fold_case(c: Column) -> Column:
    """Consistent text in lower case, sharp s as ss."""
    return F.replace(F.lower(consistent(c)), F.lit("ß"), F.lit("ss"))


def simplify_han(c: Column) -> Column:
    """Traditional characters to simplified ones."""
    return F.translate(c, "".join(TRADITIONAL), "".join(TRADITIONAL.values()))


def all_latin(c: Column) -> Column:
    """Look-alike letters to Latin ones everywhere, for keys whose language is known to be Latin."""
    return F.translate(c, "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values()))


def bare_letters(c: Column) -> Column:
    """Letters only: case, blanks, digits, marks and punctuation do not count."""
    return F.regexp_replace(fold_case(all_latin(consistent(c))), "[^\\p{L}]+", "")


#: What stands for a missing value, in lower case.
PLACEHOLDERS = ("", "nan", "na", "n/a", "null", "none", "<na>", "-", "–", "—")


def is_missing(c: Column) -> Column:
    """NULL, blank, or a placeholder for nothing."""
    return c.isNull() | F.lower(strip(c)).isin(*PLACEHOLDERS)


def strip(c: Column) -> Column:
    """Remove outer blanks of any kind, line breaks and tabs."""
    return F.regexp_replace(c, "^[\\s\\p{Z}\\x{feff}]++|(?<![\\s\\p{Z}\\x{feff}])[\\s\\p{Z}\\x{feff}]++$", "")


def occurrences(tokens: Column) -> Column:
    """Bag to set: the k-th occurrence of a token becomes `token` + U+0001 + k.

    Sorting brings equal tokens together, so one pass over positions is enough.
    """
    return let(F.array_sort(tokens), lambda ordered: F.transform(ordered, lambda t, i: F.concat(t, F.lit("\x01"), (i + 2 - F.array_position(ordered, t)).cast("string"))))
