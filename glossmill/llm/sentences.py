"""Sentence units across languages and scripts by a semi-Markov dynamic programme over whole spans.

A document is cut at blank lines; within a block every end mark outside matched quotations and parentheses is a
candidate boundary (a span must not cut a quotation). A span between two candidates is scored as a whole:

* length: how far the logarithm of its characters is from that of sentences of its script,
* opening: case, digit or mark it opens with, and how surely its first word opens sentences,
* closing: its mark and the word before it, as listed and as counted in the corpus,
* quotations: a span that is nothing but a quotation waits for its speaker in Chinese.

The best sum over all segmentations is found exactly. Boundaries that cost more than any length can repay are
left out beforehand; beyond the length where the length score is constant only the best earlier boundaries count.
Both are proven, so the programme is linear in the text. Word and length scores are fitted on marks whose label
is certain (see fit()).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import widen

# Abbreviations that end no sentence, in lower case without their last full stop.
ABBREVIATIONS = frozenset(
    "approx aprox art. bsp bzw ca cap cf ch d dr dra ed ee eds ej etw evtl e.g ff fig figs geb gest ggf h hr hrsg i.e inkl jh jhd kap lic mr mrs ms mt nr nro núm núms mio mrd op p pág págs pp prof profa resp sog sr sra sres srta srto st str tel u.a u.s uu ud uds usa v.a vgl vol vols vs z z.b zz d.h p.ej ej a.m p.m jr sen gov rev hon inc ltd corp dept est min. max. bd abb anm aufl allg bes".split()
)
# Abbreviations that end a unit unless a lower-case word or a comma follows.
OPEN_ENDED = frozenset(("etc", "usw"))
# Words that are abbreviations only before a number.
BEFORE_NUMBER = frozenset(("no", "nos", "sec", "tab", "art"))
_BLANK_LINE = re.compile(r"(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+")
_END = re.compile(r"[.!?…。！？｡؟।]+")
_RUN = re.compile(r"[\w.]+")
_NUMERIC = re.compile(r"[\d.]*")
_WORD = re.compile(r"\w+")
_LINE_NUMBER = re.compile(r"\d+[.)]\s*")
_HAN = re.compile(r"[㐀-鿿⺀-⿟]")
_PAIRS = {"(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "《": "》", "【": "】"}
_CLOSE = {v: k for k, v in _PAIRS.items()}
STRONG, SOFT, NEVER, ALONE, TINY, EACH = 4.0, 3.0, -9.0, -12.0, -3.0, -0.5
# A listed mark before a capital outweighs what two spans can lose by their lengths, 2 * LENGTH; learned words leave it open.
#: The length score is -CURVE z², at least -LENGTH; word scores lie within these bounds.
CURVE, LENGTH, CLOSING, OPENING = 0.1, 1.0, (-8.0, 1.0), (-1.0, 1.0)


@dataclass(frozen=True)
class Model:
    """Fitted scores: words before a full stop, first words, and (mean, deviation) of log lengths by script."""

    closing: Mapping[str, float] = field(default_factory=dict)
    opening: Mapping[str, float] = field(default_factory=dict)
    length: Mapping[bool, tuple[float, float]] = field(default_factory=lambda: {False: (4.3, 0.5), True: (3.2, 0.5)})

    def saturated(self, chinese: bool) -> int:
        """Characters from which on the length score of a long span is -LENGTH."""
        mean, deviation = self.length[chinese]
        return math.ceil(math.exp(min(mean + deviation * math.sqrt(LENGTH / CURVE), 20.0)))

    def length_score(self, n: int, chinese: bool) -> float:
        """Score of a span of n characters."""
        mean, deviation = self.length[chinese]
        z = (math.log(max(n, 1)) - mean) / deviation
        return max(-LENGTH, -CURVE * z * z) + (TINY if n < 2 else 0.0)


def quotations(text: str) -> list[tuple[int, int]]:
    """Matched quotations and parentheses as (opening, closing) positions; unmatched marks are text.

    Marks of either direction („…“, “…”, «…», »…«) take their role from what is open; a dash that begins speech
    is closed by a dash before a lower-case word.
    """
    stack: list[tuple[str, int]] = []
    found = []

    def close(kinds: str, at: int) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in kinds:
                found.append((stack[k][1], at))
                del stack[k:]
                return True
        return False

    for m in re.finditer(r'["“”„«»()（）\[\]「」『』《》【】—‚‘’]', text):
        c, at = m.group(), m.start()
        if c in _PAIRS or c == "„":
            stack.append((c, at))
        elif c in _CLOSE:
            close(_CLOSE[c], at)
        elif c == '"':
            if not close('"', at):
                stack.append((c, at))
        elif c == "“":
            if not close("„", at):
                stack.append((c, at))
        elif c == "”":
            close("“„", at)
        elif c == "«":
            if not close("»", at):
                stack.append((c, at))
        elif c == "»":
            if not close("«", at):
                stack.append((c, at))
        elif c == "—":
            after, before = text[at + 1 : at + 2], text[at - 1 : at]
            if after.islower():
                close("—", at)
            elif after and not after.isspace() and (not before or before.isspace()):
                stack[:] = [x for x in stack if x[0] != "—"]
                stack.append((c, at))
    return found


def _closing(text: str, run: int, numeric: int, first: int, last: int, chinese: bool, model: Model) -> float:
    """How well a span closes with the end marks text[first:last]; text[run:first] is the word run before them, numbers up to `numeric`."""
    marks = text[first:last]
    if marks[0] == "…" or marks.startswith(".."):
        return NEVER if chinese and not set(marks) & set("。！？!?") else SOFT
    if marks != ".":
        return STRONG
    if text[last : last + 1].isalnum() and (text[last].islower() or text[last].isdigit()):
        return NEVER  # inside a number, a file name or an abbreviation
    if run >= first:
        return STRONG
    dot = text.rfind(".", run, first)
    part = text[dot + 1 : first].casefold() if dot >= 0 else text[run:first].casefold()
    token = text[run:first].casefold() if first - run <= 12 else part
    if token in OPEN_ENDED:
        return SOFT
    if token in BEFORE_NUMBER and text[last : last + 20].lstrip()[:1].isdigit():
        return NEVER
    if first <= numeric or token in ABBREVIATIONS or part in ABBREVIATIONS or len(part) == 1 and not _HAN.match(part):
        return NEVER
    return STRONG + model.closing.get(part, 0.0)


def _opening(text: str, at: int, model: Model) -> float:
    """How well a span opens at its first character."""
    c = text[at]
    if c in ",;:，；：、)）]」』》】%":
        return NEVER
    if c == "—":
        return NEVER if text[at + 1 : at + 2].islower() or text[at + 1 : at + 2].isspace() else 1.0
    if c.islower():
        return -6.0
    word = _WORD.match(text, at)
    return 1.0 + (model.opening.get(word.group(), 0.0) if word else 0.0)


@dataclass
class Lattice:
    """Candidate boundaries of a block: where spans end and start, what each boundary scores, and lone quotations."""

    ends: list[int]
    starts: list[int]
    gains: list[float]
    alone: dict[int, int]
    chinese: bool


def lattice(block: str, chinese: bool, model: Model, pruned: bool = True) -> Lattice:
    """Candidates of a block. The last end is the block's; starts[0] is its first character, gains[k] that of ends[k] and starts[k + 1].

    pruned: leave out boundaries that no segmentation can profit from: joining two spans costs the length score of
    the whole at most, so a boundary of -LENGTH or less is never better than none.
    """
    pairs = quotations(block)
    opens, closes = dict(pairs), {b for _, b in pairs}
    began, ended = sorted(opens), sorted(closes)
    first = len(block) - len(block.lstrip())
    out = Lattice([], [first], [], {}, chinese)
    runs, run = _RUN.finditer(block), None
    start, stop, numeric = 0, 0, 0
    for m in _END.finditer(block):
        at = m.end()
        while at < len(block) and (at in closes or block[at] in "’'" and not block[at + 1 : at + 2].isalnum()) and block[at] != "—":
            at += 1
        nxt = at
        while nxt < len(block) and block[nxt].isspace():
            nxt += 1
        if nxt >= len(block) or bisect_left(began, at) > bisect_left(ended, at):  # the block's end, or inside a quotation
            continue
        while stop < m.start() and (run := next(runs, None)) is not None:  # the word run that ends at, or reaches over, the mark
            start, stop = run.span()
            numeric = start + len(_NUMERIC.match(run.group()).group())
        gain = EACH + _closing(block, start if start < m.start() <= stop else m.start(), numeric, m.start(), m.end(), chinese, model) + _opening(block, nxt, model)
        if not pruned or gain > -LENGTH:
            out.ends.append(at)
            out.gains.append(gain)
            out.starts.append(nxt)
    out.ends.append(len(block.rstrip()))
    if chinese and pairs:
        for k, s in enumerate(out.starts):
            numbered = _LINE_NUMBER.match(block, s)
            close = opens.get(numbered.end() if numbered else s)
            if close is not None:
                out.alone[k] = close + 1
    return out


def best_path(l: Lattice, model: Model) -> list[int]:
    """Boundaries (indexes of ends) of the best segmentation, exact; ties go to the longer last span.

    Spans of a saturated length all score alike, so of the candidates that far back only the two best count: the
    second where the best one's span would be a lone quotation. A candidate that another leads by more than all that
    a span can lose is passed at once.
    """
    n, limit, lead, top = len(l.ends), model.saturated(l.chinese), LENGTH - ALONE - TINY + 1e-9, 0.0
    score, back = [0.0] * (n + 1), [0] * (n + 1)  # of the best segmentation up to the start of span k
    far, passed = [], 0
    for j, end in enumerate(l.ends):
        top = max(top, score[j])
        while passed < j and score[passed] + lead < top:
            passed += 1
        reach = bisect_right(l.starts, end - limit, passed, j + 1)
        for i in range(passed, max(passed, reach)):
            far = sorted([*far, (-score[i], i)])[:2]
        passed = max(passed, reach)
        last = j == n - 1
        best, where = -math.inf, 0
        for value, i in [(-v - LENGTH, i) for v, i in far] + [(score[i] + model.length_score(end - l.starts[i], l.chinese), i) for i in range(passed, j + 1)]:
            if l.alone.get(i) == end and not last:
                value += ALONE
            if value > best + 1e-12 or value > best - 1e-12 and i < where:
                best, where = value, i
        score[j + 1] = best + (0.0 if last else l.gains[j])
        back[j + 1] = where
    path, j = [], n
    while j > 0:
        path.append(j - 1)
        j = back[j]
    return path[::-1]


def _block(text: str, start: int, end: int, chinese: bool, model: Model) -> list[tuple[int, int]]:
    """Spans of one block text[start:end] without blank lines."""
    block = text[start:end]
    if not block.strip():
        return []
    l = lattice(block, chinese, model)
    spans, at = [], l.starts[0]
    for j in best_path(l, model):
        spans.append((start + at, start + l.ends[j]))
        at = l.starts[j + 1] if j + 1 < len(l.starts) else len(block)
    return spans


def fit(documents: DataFrame) -> Model:
    """Scores of closing words, opening words and lengths from marks whose label is certain, in all documents.

    A full stop before a blank line or the text's end closes a sentence, one before a lower-case word or a comma
    doesn't; a block's first word opens one, a capital after a lower-case word doesn't; a block with one mark, at its
    end, is one sentence. Scores are log odds against those of all words, drawn to 0 by ten words' worth of doubt.
    Counts are made in the cluster; the driver sees one row per distinct word of such a place.
    """
    texts = documents.select("text").filter("text <> ''")
    found = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    word = lambda kind: lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word"), F.lit(None).cast("double").alias("v"))
    closed = F.transform(F.transform(found("([\\p{L}\\p{M}]++)\\.[\"”»’)]*+(?:\\s*+\\z|[^\\S\\n]*+\\n\\s*?\\n)", 1), F.lower), word("end"))
    unclosed = F.transform(F.transform(found("([\\p{L}\\p{M}]++)\\.(?:,|\\s++[\\p{Ll},])", 1), F.lower), word("non"))
    opened = F.transform(found("(?:\\A|\\n\\s*?\\n)\\s*+(\\p{Lu}[\\p{L}\\p{M}]*+)", 1), word("open"))
    inner = F.transform(found("[\\p{Ll}\\p{M},] (\\p{Lu}[\\p{L}\\p{M}]*+)", 1), word("inner"))
    single = F.filter(F.transform(F.split("text", "\\n\\s*?\\n"), lambda b: F.trim(b)), lambda b: b.rlike("^[^.!?…。！？]++[.!?…。！？]++[\"”»]?$"))
    sizes = F.transform(single, lambda b: F.struct(F.when(b.rlike("\\p{IsHan}"), "chinese").otherwise("other").alias("kind"), F.lit("").alias("word"), F.ln(F.length(b)).alias("v")))
    rows = texts.select(F.explode(F.concat(closed, unclosed, opened, inner, sizes)).alias("x")).groupBy("x.kind", "x.word").agg(F.count("*").alias("n"), F.avg("x.v").alias("mean"), F.stddev_pop("x.v").alias("deviation")).collect()
    counts: dict[str, dict[str, int]] = {k: {} for k in ("end", "non", "open", "inner")}
    length = dict(Model().length)
    for r in rows:
        if r.kind in counts:
            counts[r.kind][r.word] = r.n
        elif r.n >= 50 and r.deviation:
            length[r.kind == "chinese"] = (r.mean, max(r.deviation, 0.2))

    def odds(yes: dict[str, int], no: dict[str, int], bounds: tuple[float, float], doubt: float = 10.0) -> dict[str, float]:
        p = (sum(yes.values()) + 1) / (sum(yes.values()) + sum(no.values()) + 2)
        score = lambda w: math.log((yes.get(w, 0) + doubt * p) / (no.get(w, 0) + doubt * (1 - p))) - math.log(p / (1 - p))
        return {w: min(max(score(w), bounds[0]), bounds[1]) for w in yes.keys() | no.keys()}

    return Model(odds(counts["end"], counts["non"], CLOSING), odds(counts["open"], counts["inner"], OPENING), length)


def sentence_spans(text: str, model: Model = Model()) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) code point positions, without outer blanks."""
    if not text:
        return []
    han = len(_HAN.findall(text))
    chinese = 3 * han > sum(map(str.isalpha, text)) - han
    spans, at = [], 0
    for m in _BLANK_LINE.finditer(text):
        spans += _block(text, at, m.start(), chinese, model)
        at = m.end()
    return spans + _block(text, at, len(text), chinese, model)


def split_sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Every sentence of every document: doc_id, start_char, end_char.

    documents: doc_id, text. model: the fitted scores (of fit(documents) if None). NULL and empty texts give no row;
    copies each give theirs. Texts are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents) if model is None else model)  # words next to certain marks

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            found = [(d, a, b) for d, t in zip(batch["doc_id"], batch["text"]) for a, b in sentence_spans(t, known)]
            yield pd.DataFrame(found, columns=["doc_id", "start_char", "end_char"]).astype({"doc_id": "int64", "start_char": "int32", "end_char": "int32"})

    docs = widen(documents.select("doc_id", "text").filter("text <> ''"), "doc_id")
    return docs.mapInPandas(scan, "doc_id bigint, start_char int, end_char int")
