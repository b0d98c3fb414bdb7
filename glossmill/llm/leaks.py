"""Evaluation passages inside training text: a BM25 index of the passages, queried by every document.

Terms are shingles of successive tokens (words, or characters in Chinese). A document that holds a run of
successive tokens of a passage shares every shingle of the run, so its score is at least the weakest run's;
that is each passage's threshold, and block-max WAND retrieves all passages at or above theirs. Retrieved
pairs are verified exactly. A leak consists of words of the passages, so only stretches of such words, as long
as a run at least, are looked up. Passages are few against the corpus but not bounded by anything: they are
indexed in blocks of bounded size, in parallel, and several blocks are queried in one pass over the corpus.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import INVISIBLE, LOOK_ALIKES, RADICALS
from glossmill.session import durable, widen

#: Successive tokens that make a leak, and tokens of a shingle, by unit.
RUN = {"word": 13, "char": 20}
SHINGLE = {"word": 5, "char": 8}
K1, B = 1.2, 0.75
#: Characters of passages in a block, on average (its index takes about ten times that), and blocks of a pass over the corpus.
BLOCK_CHARS, BLOCKS_A_PASS = 1_000_000, 8
POSTING_BLOCK = 32

_MAP = {ord(c): None for c in INVISIBLE} | {ord(a): b for a, b in (LOOK_ALIKES | RADICALS).items()}
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[㐀-鿿]")


def fold(text: str) -> str:
    """Text without case, accents, invisible characters and look-alikes."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_MAP))
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    return text.casefold()


def shingles(words: list[str], chars: str, unit: str, size: int) -> list[str]:
    """Shingles of `size` successive tokens, in order."""
    if unit == "char":
        return [chars[i : i + size] for i in range(len(chars) - size + 1)]
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def stretches(tokens: list[str] | str, known: set[str], least: int) -> Iterator[list[str] | str]:
    """Maximal stretches of known tokens, of `least` tokens or more."""
    start = None
    for i, token in enumerate(tokens):
        if token in known:
            if start is None:
                start = i
        elif start is not None:
            if i - start >= least:
                yield tokens[start:i]
            start = None
    if start is not None and len(tokens) - start >= least:
        yield tokens[start:]


class Index:
    """BM25 impacts of passages' shingles with block maxima, per unit."""

    def __init__(self, passages: list[tuple[int, str, str]], unit: str):
        self.unit, self.ids, self.runs, self.least, self.known = unit, [], [], [], set()
        terms: list[list[str]] = []
        for key, lang, text in passages:
            if ("char" if lang == "cn" else "word") != unit or not text:
                continue
            words = _WORD.findall(fold(text))
            run = set(shingles(words, "".join(words), unit, RUN[unit]))
            if run:
                self.ids.append(key)
                self.runs.append(run)
                self.known.update("".join(words) if unit == "char" else words)
                terms.append(shingles(words, "".join(words), unit, SHINGLE[unit]))
        #: Whether a run of the index may lie in text without Chinese characters.
        self.latin = unit == "word" or any(not _HAN.search(r) for run in self.runs for r in run)
        n, mean = len(terms), sum(map(len, terms)) / max(1, len(terms))
        found: dict[str, dict[int, int]] = {}
        for p, own in enumerate(terms):
            for t in own:
                slot = found.setdefault(t, {})
                slot[p] = slot.get(p, 0) + 1
        self.postings: dict[str, tuple[list[int], list[float], list[float], list[int], float]] = {}
        for t, slot in found.items():
            idf = math.log(1 + (n - len(slot) + 0.5) / (len(slot) + 0.5))
            where = sorted(slot)
            score = [idf * slot[p] * (K1 + 1) / (slot[p] + K1 * (1 - B + B * len(terms[p]) / mean)) for p in where]
            tops = [max(score[i : i + POSTING_BLOCK]) for i in range(0, len(score), POSTING_BLOCK)]
            ends = [where[min(i + POSTING_BLOCK, len(where)) - 1] for i in range(0, len(where), POSTING_BLOCK)]
            self.postings[t] = (where, score, tops, ends, max(tops))
        span = RUN[unit] - SHINGLE[unit] + 1
        for p, own in enumerate(terms):
            each = [self.score(t, p) for t in own]
            weakest = math.inf
            for i in range(len(own) - span + 1):
                window = dict(zip(own[i : i + span], each[i : i + span]))
                weakest = min(weakest, sum(window.values()))
            self.least.append(weakest - 1e-9)
        self.floor = min(self.least, default=math.inf)

    def score(self, term: str, p: int) -> float:
        where, score = self.postings[term][:2]
        return score[bisect_left(where, p)]

    def search(self, terms: set[str]) -> list[int]:
        """All passages whose score reaches their threshold, by block-max WAND.

        Lists stand in the order of their current passage. The pivot is the first passage that the lists' maxima let
        reach the floor; if the maxima of the blocks it lies in don't, the lists go past the nearest end of those
        blocks, or to the next list's passage; else it is scored once all lists before it have caught up.
        """
        lists = [self.postings[t] for t in terms if t in self.postings]
        if sum(x[4] for x in lists) < self.floor:
            return []
        at, hits = [0] * len(lists), []
        live = sorted((x[0][0], i) for i, x in enumerate(lists))

        def move(count: int, to: int) -> None:
            """Bring the first `count` lists to their first passage from `to` on."""
            moved = live[:count]
            del live[:count]
            for _, i in moved:
                at[i] = bisect_left(lists[i][0], to, at[i])
                if at[i] < len(lists[i][0]):
                    insort(live, (lists[i][0][at[i]], i))

        while True:
            total, pivot = 0.0, -1
            for k, (_, i) in enumerate(live):
                total += lists[i][4]
                if total >= self.floor:
                    pivot = k
                    break
            if pivot < 0:
                return hits
            p = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == p:
                pivot += 1
            bound, skip = 0.0, live[pivot + 1][0] if pivot + 1 < len(live) else 1 << 60
            for _, i in live[: pivot + 1]:
                tops, ends = lists[i][2], lists[i][3]
                block = bisect_left(ends, p, at[i] // POSTING_BLOCK)
                if block < len(ends):  # a list that ends before the pivot adds nothing to it
                    bound += tops[block]
                    skip = min(skip, ends[block] + 1)
            if bound < self.floor:
                move(pivot + 1, max(skip, p + 1))
            elif live[0][0] == p:
                if sum(lists[i][1][at[i]] for _, i in live[: pivot + 1]) >= self.least[p]:
                    hits.append(p)
                move(pivot + 1, p + 1)
            else:
                move(pivot + 1, p)

    def find(self, words: list[str], chars: str) -> list[int]:
        """Ids of the passages of which the document holds a whole run."""
        size, unit = RUN[self.unit], self.unit
        if not self.ids or not self.latin and not _HAN.search(chars):
            return []
        parts = list(stretches(chars if unit == "char" else words, self.known, size))
        if not parts:
            return []
        cut = lambda n: {s for part in parts for s in shingles(part, part, unit, n)}
        near = self.search(cut(SHINGLE[unit]))
        if not near:
            return []
        runs = cut(size)
        return [self.ids[p] for p in near if not runs.isdisjoint(self.runs[p])]


def build_indexes(passages: DataFrame, blocks: int) -> DataFrame:
    """Pickled indexes of the passages' blocks, one task each: block, data."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["passage_id"].tolist(), pdf["lang"].tolist(), pdf["text"].tolist()))
        return pd.DataFrame({"block": [key[0]], "data": [pickle.dumps([Index(rows, unit) for unit in RUN])]})

    numbered = passages.select("passage_id", "lang", "text").filter("text <> ''").withColumn("block", F.pmod(F.xxhash64("passage_id", "text"), F.lit(blocks)).cast("int"))
    return numbered.groupBy("block").applyInPandas(one, "block int, data binary")


def leaked(documents: DataFrame, passages: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents with the passages they hold: doc_id, passage_id.

    documents: doc_id, text; passages: passage_id, lang, text. Texts are read whole. NULL, empty and short
    texts hold nothing; copies of a document or passage each come out; passages shorter than a run can't leak.
    Blocks of a pass, bounded in number and size, go to the workers together; only more passages make more passes.
    """
    spark = documents.sparkSession
    docs = widen(documents.select("doc_id", "text").filter("text <> ''"), "doc_id")
    chars = passages.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = chars // block_chars + 1
    built = durable(build_indexes(passages, blocks))
    out = None
    for first in range(0, blocks, BLOCKS_A_PASS):
        rows = built.filter(F.col("block").between(first, first + BLOCKS_A_PASS - 1)).collect()  # bounded by BLOCKS_A_PASS and block_chars
        shared = spark.sparkContext.broadcast([index for r in rows for index in pickle.loads(r.data)])

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            indexes = [x for x in shared.value if x.ids]
            for batch in batches:
                found = []
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    words = _WORD.findall(fold(text))
                    chars = "".join(words)
                    found += [(doc, p) for index in indexes for p in index.find(words, chars)]
                yield pd.DataFrame(found, columns=["doc_id", "passage_id"]).astype("int64")

        one = docs.mapInPandas(scan, "doc_id bigint, passage_id bigint")
        out = one if out is None else out.unionByName(one)
    return out
