"""Filling fixed-capacity containers with documents: hierarchical multi-length packing.

1. Route: a document goes to the tier of the shortest context window (512, 1,024 or 2,048 tokens) that holds it.
   Only a document over the capacity is cut, into pieces of the capacity and a rest.
2. Pack: tiers are packed from the longest down, best fit in falling order of size. A document first fills a gap in
   a window of a longer tier, the tightest that takes it; else it joins or opens a window of its own tier.
3. Combine: windows, which stay whole, are put into containers of the capacity, best fit in falling order.
4. Balance: containers of each tier are dealt to step groups of equal size, there and back in order of their work.

The corpus is packed in many independent groups of bounded size, chosen by hash; each wastes at most its last
containers.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import durable

CAPACITY = 2048
#: Context windows, as shares of the capacity: 2,048, 1,024 and 512 tokens.
TIERS = (1, 2, 4)
#: Tokens and documents of a packing group, on average; what one task holds.
GROUP_TOKENS, GROUP_DOCS = 1 << 20, 20_000
STEP = 8


def token_count(text: Column) -> Column:
    """Tokens of a text: 1 per Chinese character or punctuation mark, ceil(length / 4) per other run of word characters."""
    runs = F.regexp_extract_all(text, F.lit("(?U)[\\w&&[^\\p{IsHan}]]+"), F.lit(0))
    single = F.regexp_count(text, F.lit("(?U)\\p{IsHan}|[^\\w\\s]"))
    return (F.aggregate(runs, F.lit(0), lambda n, r: n + F.ceil(F.length(r) / 4).cast("int")) + single).cast("int")


def tokenizer_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens by a public tokenizer's file (`tokenizers` JSON), in Arrow batches."""

    def scan(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(e.ids) for e in t.encode_batch(b["text"].fillna("").tolist(), add_special_tokens=False)]})

    return documents.select("doc_id", "text").mapInPandas(scan, "doc_id bigint, n_tokens int")


class _Bins:
    """Bins with their free room in order, for best fit in O(log n)."""

    def __init__(self):
        self.room: list[tuple[int, int]] = []

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest bin with room for `size`, taken out: (free, bin)."""
        at = bisect_left(self.room, (size, -1))
        return self.room.pop(at) if at < len(self.room) else None

    def put(self, free: int, number: int) -> None:
        if free > 0:
            insort(self.room, (free, number))


def pack_windows(sizes: list[int], tiers: list[int]) -> tuple[list[int], list[int]]:
    """Window of each size (sizes fall), and the tier (its length) of each window.

    Gaps of longer tiers are filled before a window of the own tier is joined or opened.
    """
    gaps, tier_of, where = _Bins(), [], []
    at = 0
    for k, tier in enumerate(tiers):
        own, shorter = _Bins(), tiers[k + 1] if k + 1 < len(tiers) else -1
        while at < len(sizes) and sizes[at] > shorter:
            found, home = gaps.take(sizes[at]), gaps
            if found is None:
                found, home = own.take(sizes[at]), own
            if found is None:
                found = (tier, len(tier_of))
                tier_of.append(tier)
            where.append(found[1])
            home.put(found[0] - sizes[at], found[1])
            at += 1
        for free, number in own.room:  # what this tier leaves is a gap for the shorter ones
            gaps.put(free, number)
    return where, tier_of


def combine_windows(used: list[int], capacity: int) -> list[int]:
    """Container of each window, by their used lengths."""
    bins, where, opened = _Bins(), [0] * len(used), 0
    for w in sorted(range(len(used)), key=lambda w: (-used[w], w)):
        found = bins.take(used[w])
        if found is None:
            found = (capacity, opened)
            opened += 1
        where[w] = found[1]
        bins.put(found[0] - used[w], found[1])
    return where


def pack_group(items: pd.DataFrame, capacity: int, step: int) -> pd.DataFrame:
    """Containers, windows, places and step groups of one group's pieces (doc_id, piece_no, size), deterministic in its rows' keys."""
    items = items.sort_values(["size", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
    tiers = [capacity // n for n in TIERS]
    where, tier_of = pack_windows(items["size"].tolist(), tiers)
    out = items.assign(window=where, tier=[tier_of[w] for w in where])
    used = out.groupby("window")["size"].sum().reindex(range(len(tier_of)), fill_value=0).tolist()
    boxes = combine_windows(used, capacity)
    out = out.assign(box=[boxes[w] for w in where]).sort_values(["box", "tier", "window", "size", "doc_id", "piece_no"], ascending=[True, False, True, False, True, True], kind="stable")
    sizes = out["size"].astype("int64")
    out = out.assign(place=out.groupby("box").cumcount(), start_token=sizes.groupby(out["box"]).cumsum() - sizes)
    # a window's work grows with the square of its length; each tier's containers are dealt there and back over the steps
    per = out.assign(w=sizes).groupby(["box", "window"])["w"].sum().pow(2).groupby("box").sum()
    order = pd.DataFrame({"work": per, "tier": out.groupby("box")["tier"].max()}).sort_values(["tier", "work"], kind="stable").index
    steps = max(1, math.ceil(len(order) / step))
    lane = {b: i % steps if (i // steps) % 2 == 0 else steps - 1 - i % steps for i, b in enumerate(order)}
    return out.assign(step=out["box"].map(lane))


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, step: int = STEP) -> DataFrame:
    """Container and place of every document: doc_id, piece_no, container_id, place, start_token, n_tokens, window, tier, step.

    documents: doc_id (unique), text, n_tokens (used where stated, counted where NULL; a `tokenizer` file counts
    all). place and start_token are 0-based within the container, window numbers the windows of a packing group and
    tier is the window's length. A document over the capacity gives several pieces, all but the last a whole
    container; others give piece 0. Empty and NULL texts have size 0 and still get a place. Nothing is dropped.
    """
    if tokenizer:
        sized = documents.select("doc_id").join(tokenizer_counts(documents, tokenizer), "doc_id").select("doc_id", F.col("n_tokens").alias("size"))
    else:
        sized = documents.select("doc_id", F.coalesce("n_tokens", token_count(F.col("text")), F.lit(0)).alias("size"))
    sized = durable(sized.withColumn("size", F.greatest("size", F.lit(0))))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    groups = max(1, math.ceil(total.t / GROUP_TOKENS), math.ceil(total.n / GROUP_DOCS))
    whole = F.greatest(F.ceil(F.col("size") / capacity).cast("int"), F.lit(1))
    pieces = sized.select("doc_id", F.col("size").alias("all"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece_no")).withColumn("size", F.least(F.lit(capacity), F.col("all") - F.col("piece_no") * capacity).cast("int"))
    dealt = pieces.select("doc_id", "piece_no", "size", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)).cast("int").alias("g"))

    def one(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        out, name = pack_group(items, capacity, step), f"g{key[0]}-"
        return pd.DataFrame({"doc_id": out["doc_id"], "piece_no": out["piece_no"], "container_id": name + out["box"].astype(str), "place": out["place"], "start_token": out["start_token"], "n_tokens": out["size"], "window": name + out["window"].astype(str), "tier": out["tier"], "step": name + out["step"].astype(str)})

    return dealt.groupBy("g").applyInPandas(one, "doc_id bigint, piece_no int, container_id string, place int, start_token int, n_tokens int, window string, tier int, step string")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per tier, and over all containers (tier 'all'): tier, n_units (windows, or containers), n_tokens, unused_share, n_steps, fullest.

    unused_share of a tier is that of its windows, that of 'all' is that of the containers.
    """
    windows = packed.groupBy("tier", "window").agg(F.sum("n_tokens").alias("t"))
    by_tier = windows.groupBy("tier").agg(F.count("*").alias("n_units"), F.sum("t").alias("n_tokens"), (1 - F.sum("t") / (F.count("*") * F.col("tier"))).alias("unused_share"), F.lit(None).cast("bigint").alias("n_steps"), F.max("t").alias("fullest"))
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.first("step").alias("step"))
    whole = boxes.agg(F.lit("all").alias("tier"), F.count("*").alias("n_units"), F.sum("t").alias("n_tokens"), (1 - F.try_divide(F.sum("t"), F.count("*") * capacity)).alias("unused_share"), F.countDistinct("step").alias("n_steps"), F.max("t").alias("fullest"))
    return by_tier.withColumn("tier", F.col("tier").cast("string")).unionByName(whole)
