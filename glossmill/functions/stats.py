"""Metrics and rank statistics as aggregate columns or plans; Arrow only where Spark has no aggregate."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.ranges import value_ranks
from glossmill.functions.windows import average_ranks
from glossmill.operators.checks import DataError
from glossmill.session import durable


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation, NULL where either side is constant (corr() itself fails there)."""
    both = lambda c, d: F.when(F.isnotnull(d), c)
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(both(x, y)) * F.stddev_pop(both(y, x)), F.lit(0.0)))


def error_metrics(gold: str, pred: str) -> list[Column]:
    """Columns of one metrics row: sizes, central values, errors, calibration line and shares within tolerance."""
    e = F.col(pred) - F.col(gold)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return [
        F.count("*").alias("n"), F.avg(gold).alias("mean_gold"), F.median(gold).alias("median_gold"), F.avg(pred).alias("mean_pred"), F.median(pred).alias("median_pred"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.median(F.abs(e)).alias("medae"), F.avg(e).alias("bias"), F.median(e).alias("median_error"),
        share(e > 0).alias("prop_over"), share(e < 0).alias("prop_under"), F.regr_slope(pred, gold).alias("slope"), F.regr_intercept(pred, gold).alias("intercept"), pearson(gold, pred).alias("pearson"),
        share(F.abs(e) <= 0.5).alias("within_05"), share(F.abs(e) <= 1.0).alias("within_10"),
    ]


def _tied_pairs(values: np.ndarray) -> int:
    n = np.unique(values, return_counts=True)[1].astype(np.int64)
    return int((n * (n - 1) // 2).sum())


def inversions(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j], by merging in O(n log n)."""
    n = len(values)
    if n < 2:
        return 0
    run = np.unique(values, return_inverse=True)[1].astype(np.int64)
    swaps, width = 0, 1
    while width < n:
        block = np.arange(n) // (2 * width)
        left = (np.arange(n) % (2 * width)) < width
        span = int(run.max()) + 1
        keyed = run + block * span
        lefts = np.sort(keyed[left])
        rights = keyed[~left]
        end = np.searchsorted(lefts, (rights // span + 1) * span, "left")
        swaps += int((end - np.searchsorted(lefts, rights, "right")).sum())
        run = np.sort(keyed) - block * span
        width *= 2
    return swaps


def discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs in which x and y strictly differ the other way round."""
    return inversions(y[np.lexsort((y, x))])


def tau_and_p(n: int, tx: float, ty: float, both: float, swaps: float, sums: tuple[float, ...]) -> tuple[float, float]:
    """Tau-b and its normal two-sided p from numbers of tied pairs, discordant pairs, and the tie sums
    (c(c-1)(2c+5), c(c-1), c(c-1)(c-2) over x's ties, then y's)."""
    total = n * (n - 1) // 2
    if n < 2 or total in (tx, ty):
        return math.nan, math.nan
    diff = total - tx - ty + both - 2 * swaps
    tau = diff / math.sqrt((total - tx) * (total - ty))
    x5, x1, x2, y5, y1, y2 = map(float, sums)
    var = (n * (n - 1) * (2 * n + 5) - x5 - y5) / 18 + x1 * y1 / (2 * n * (n - 1)) + (x2 * y2 / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0)
    return tau, math.erfc(abs(diff) / math.sqrt(2 * var)) if var > 0 else math.nan


def kendall_arrays(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Tau-b and its p of two arrays; pairs with a missing side don't count."""
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    if len(x) < 2:
        return math.nan, math.nan
    both = _tied_pairs(np.unique(np.stack([x, y]), axis=1, return_inverse=True)[1].ravel())
    sums = []
    for v in (x, y):
        c = np.unique(v, return_counts=True)[1].astype(float)
        sums += [(c * (c - 1) * (2 * c + 5)).sum(), (c * (c - 1)).sum(), (c * (c - 1) * (c - 2)).sum()]
    return tau_and_p(len(x), _tied_pairs(x), _tied_pairs(y), both, discordant(x, y), tuple(sums))


#: Rows of a group up to which its tau is counted in one task, and blocks of a larger one by either side.
TASK_ROWS, TASK_BLOCKS = 1_000_000, 1_000


def kendall(df: DataFrame, x: str, y: str, groups: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Kendall tau-b and p per group, exact: groups, n, tau, p.

    Rows with a missing side don't count; tau is NULL where a side is constant or fewer than two rows are left. Groups
    of up to `task_rows` rows are counted in a task each, larger ones by blocks of their ranks (see _blocked_kendall()).
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tau, p = kendall_arrays(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))
        none = lambda v: None if math.isnan(v) else v
        return pd.DataFrame([[*key, len(pdf), none(tau), none(p)]], columns=[*groups, "n", "tau", "p"])

    kept = df.select(*groups, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    types = ", ".join(f"{g} {t}" for g, t in kept.dtypes if g in groups)
    large = durable(kept.groupBy(*groups).agg(F.count("*").alias("n")).filter(F.col("n") > task_rows))
    if large.isEmpty():
        return kept.groupBy(*groups).applyInPandas(one, f"{types}, n bigint, tau double, p double")
    key = [kept[g].eqNullSafe(large[g]) for g in groups]
    small = kept.join(large, key, "left_anti").groupBy(*groups).applyInPandas(one, f"{types}, n bigint, tau double, p double")
    return small.unionByName(_blocked_kendall(kept.join(large, key, "left_semi"), groups, types, task_rows))


def _blocked_kendall(df: DataFrame, groups: Sequence[str], types: str, task_rows: int) -> DataFrame:
    """Tau of groups of any size (no NULL among the groups' values).

    Rows are dealt to blocks by their ranks on either side; equal values share a block. A discordant pair lies in two
    blocks on both sides (then the blocks' counts tell), or in one block of x (counted there), or in one of y but two of
    x (counted there without the pairs that share both). Ties are aggregates.
    """
    groups = list(groups)
    size = lambda total: F.greatest(F.lit(task_rows), F.ceil(total / TASK_BLOCKS))
    side = lambda c: value_ranks(df, c, groups).select(*groups, c, F.floor(F.col("before") / size(F.col("total"))).cast("int").alias(f"b{c}"))
    rows = durable(df.join(side("x"), [*groups, "x"]).join(side("y"), [*groups, "y"]).select(*groups, "x", "y", "bx", "by"))
    named = [*groups, "swaps"]
    schema = f"{types}, swaps bigint"

    def in_x(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key[:-1], discordant(pdf["x"].to_numpy(), pdf["y"].to_numpy())]], columns=named)

    def in_y(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        inner = sum(discordant(p["x"].to_numpy(), p["y"].to_numpy()) for _, p in pdf.groupby("bx"))
        return pd.DataFrame([[*key[:-1], discordant(pdf["x"].to_numpy(), pdf["y"].to_numpy()) - inner]], columns=named)

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf["bx"].max()) + 2, int(pdf["by"].max()) + 2), dtype=object if pdf["c"].sum() > 2**31 else np.int64)
        grid[pdf["bx"], pdf["by"] + 1] = pdf["c"]
        below = np.cumsum(grid, axis=1)  # of a block of x: rows in lower blocks of y, at the index of a block
        later = np.cumsum(below[::-1], axis=0)[::-1]  # of all blocks of x from this one on
        return pd.DataFrame([[*key, int(sum(int(c) * int(later[bx + 1, by]) for bx, by, c in zip(pdf["bx"], pdf["by"], pdf["c"])))]], columns=named)

    cells = rows.groupBy(*groups, "bx", "by").agg(F.count("*").alias("c"))
    parts = rows.groupBy(*groups, "bx").applyInPandas(in_x, schema).unionByName(rows.groupBy(*groups, "by").applyInPandas(in_y, schema)).unionByName(cells.groupBy(*groups).applyInPandas(across, schema))
    out = parts.groupBy(*groups).agg(F.sum("swaps").alias("swaps"))
    c = F.col("c").cast("double")
    for name, by in (("x", ["x"]), ("y", ["y"]), ("b", ["x", "y"])):
        ties = rows.groupBy(*groups, *by).agg(F.count("*").alias("c")).groupBy(*groups)
        sums = [F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("t"), F.sum(c * (c - 1) * (2 * c + 5)).alias("s5"), F.sum(c * (c - 1)).alias("s1"), F.sum(c * (c - 1) * (c - 2)).alias("s2")]
        out = out.join(ties.agg(F.struct(*sums).alias(name)), groups)

    def finish(batches):
        for pdf in batches:
            found = [tau_and_p(int(n), tx, ty, tb, s, tuple(ss)) for n, tx, ty, tb, s, *ss in pdf[["n", "tx", "ty", "tb", "swaps", "x5", "x1", "x2", "y5", "y1", "y2"]].itertuples(index=False)]
            yield pdf[[*groups, "n"]].assign(tau=[None if math.isnan(v) else v for v, _ in found], p=[None if math.isnan(v) else v for _, v in found])

    flat = out.select(*groups, "x.n", F.col("x.t").alias("tx"), F.col("y.t").alias("ty"), F.col("b.t").alias("tb"), "swaps", *[F.col(f"{s}.s{k}").alias(f"{s}{k}") for s in "xy" for k in (5, 1, 2)])
    return flat.mapInPandas(finish, f"{types}, n bigint, tau double, p double")  # a row for each large group


def with_tau(metrics: DataFrame, df: DataFrame, gold: str, pred: str, groups: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Metrics rows with tau and tau_p of gold and prediction, NULL for groups of fewer than `least` rows."""
    own = df if groups else df.withColumn("_all", F.lit(1))
    tau = kendall(own, gold, pred, groups or ["_all"]).select(*groups, F.when(F.col("n") >= least, F.col("tau")).alias("tau"), F.when(F.col("n") >= least, F.col("p")).alias("tau_p"))
    return metrics.join(tau, list(groups), "left") if groups else metrics.crossJoin(F.broadcast(tau))  # one row


def normal_sf2(z: Column) -> Column:
    """Two-sided normal tail probability by the Abramowitz-Stegun 7.1.26 formula (error under 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def mann_whitney(long: DataFrame, value: str, side: str, groups: Sequence[str], first: str, second: str) -> DataFrame:
    """Per group: sizes, means, medians, U of `first`, two-sided p (normal, ties and continuity corrected), Cliff's delta."""
    two = long.filter(F.col(side).isin(first, second) & F.col(value).isNotNull())
    ranked = average_ranks(two, value, list(groups), "_r")
    ties = two.groupBy(*groups, value).agg(F.count("*").alias("t")).groupBy(*groups).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    a, b = F.col(side) == first, F.col(side) == second
    s = ranked.groupBy(*groups).agg(
        F.count_if(a).alias("n1"), F.count_if(b).alias("n2"), F.avg(F.when(a, F.col(value))).alias("mean1"), F.avg(F.when(b, F.col(value))).alias("mean2"),
        F.median(F.when(a, F.col(value))).alias("median1"), F.median(F.when(b, F.col(value))).alias("median2"), F.sum(F.when(a, F.col("_r"))).alias("r1"),
    )
    s = s.join(ties, list(groups)).filter("n1 > 0 AND n2 > 0").withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2.0) - 0.5, F.lit(0.0)), F.sqrt(F.nullif(var, F.lit(0.0))))
    return s.withColumn("p", normal_sf2(z)).withColumn("delta", 2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1).drop("ties", "r1")


def wilcoxon(df: DataFrame, diff: str, groups: Sequence[str]) -> DataFrame:
    """Signed-rank sums per group (zero differences dropped): n, w_plus, w_minus, two-sided normal p."""
    kept = df.filter(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("_a", F.abs(diff))
    ranked = average_ranks(kept, "_a", list(groups), "_r")
    ties = kept.groupBy(*groups, "_a").agg(F.count("*").alias("t")).groupBy(*groups).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    s = ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(diff) < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"))
    s = s.join(ties, list(groups))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    return s.withColumn("p", normal_sf2(F.try_divide(F.col("w_plus") - n * (n + 1) / 4.0, F.sqrt(F.nullif(var, F.lit(0.0)))))).drop("ties")


def bootstrap(df: DataFrame, key: str, metrics: dict[str, Column], resamples: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile intervals of metrics by a Poisson bootstrap in one pass: metric, low, high.

    Every row gets a Poisson(1) weight per resample from a hash of its key, so resamples are the same under any
    partitioning and nothing is drawn on the driver. Metrics are aggregates over the column `w`.
    """
    drawn = _draw(df, key, resamples, seed)
    per = drawn.groupBy("b").agg(*[m.alias(name) for name, m in metrics.items()])
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return per.unpivot(["b"], list(metrics), "metric", "v").groupBy("metric").agg(F.percentile("v", F.lit(lo)).alias("low"), F.percentile("v", F.lit(hi)).alias("high"))


def _draw(df: DataFrame, key: str, resamples: int, seed: int) -> DataFrame:
    """Rows with a Poisson(1) weight `w` for every resample `b`, zeros left out; weights come from a hash of the key."""
    u = F.pmod(F.xxhash64(F.col(key), F.col("b"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    cdf, weight, p = 0.0, F.lit(0), math.exp(-1)
    for k in range(8):
        cdf += p
        weight = weight + F.when(u >= cdf, 1).otherwise(0)
        p /= k + 1
    return df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight).filter("w > 0")


def bootstrap_difference(df: DataFrame, key: str, value: str, groups: Sequence[str], side: str | None = None, first: str = "", second: str = "", resamples: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval per group of a mean, or of the difference of two sides' means (first - second): groups, ci_low, ci_high.

    NULL values don't count; resamples in which a side is empty give nothing.
    """
    drawn = _draw(df.filter(F.col(value).isNotNull()), key, resamples, seed)
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col(value) * F.col("w"))), F.sum(F.when(c, F.col("w"))))
    stat = mean(F.lit(True)) if side is None else mean(F.col(side) == first) - mean(F.col(side) == second)
    per = drawn.groupBy(*groups, "b").agg(stat.alias("v"))
    # `resamples` values a group, whatever the rows
    return per.groupBy(*groups).agg(F.percentile("v", F.lit((1 - level) / 2)).alias("ci_low"), F.percentile("v", F.lit((1 + level) / 2)).alias("ci_high"))


#: Metrics by name: aggregates of gold and prediction. Rank metrics need ranks and are added by evaluate().
METRICS: dict[str, Callable[[str, str], Column]] = {
    "rmse": lambda g, p: F.sqrt(F.avg(F.pow(F.col(p) - F.col(g), 2))),
    "mae": lambda g, p: F.avg(F.abs(F.col(p) - F.col(g))),
    "pearson": pearson,
}
RANK_METRICS = ("spearman", "kendall_tau")


def register_metric(name: str, metric: Callable[[str, str], Column]) -> None:
    """Add a metric; a known name raises."""
    if name in METRICS or name in RANK_METRICS:
        raise DataError("metric exists", name=name)
    METRICS[name] = metric


def evaluate(df: DataFrame, gold: str, pred: str, names: Sequence[str] = ("rmse", "mae", "pearson", "spearman", "kendall_tau"), strict: bool = True) -> dict[str, float | None]:
    """Metrics of a prediction by name. strict: no rows, a missing or infinite value, or a constant side under a correlation raises; else such rows don't count and the correlation is None."""
    unknown = [n for n in names if n not in METRICS and n not in RANK_METRICS]
    if unknown:
        raise DataError("unknown metrics", names=unknown, known=sorted((*METRICS, *RANK_METRICS)))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    own = df.select(F.col(gold).cast("double").alias("_g"), F.col(pred).cast("double").alias("_p"))
    seen = own.agg(F.count("*").alias("n"), F.count_if(bad("_g") | bad("_p")).alias("bad"), F.coalesce(F.stddev_pop("_g"), F.lit(0.0)).alias("sg"), F.coalesce(F.stddev_pop("_p"), F.lit(0.0)).alias("sp")).first()
    if strict and (not seen.n or seen.bad):
        raise DataError("metrics need finite values", rows=seen.n, bad=seen.bad)
    if strict and not (seen.sg and seen.sp) and any(n not in ("rmse", "mae") for n in names if n in ("pearson", *RANK_METRICS)):
        raise DataError("a correlation needs values that differ", gold=gold, prediction=pred)
    own = own.filter(~bad("_g") & ~bad("_p"))
    plain = [n for n in names if n in METRICS]
    out: dict[str, float | None] = {}
    if plain:
        row = own.agg(*[METRICS[n]("_g", "_p").alias(n) for n in plain]).first()
        out |= {n: row[n] for n in plain}
    if "spearman" in names:
        ranked = average_ranks(average_ranks(own, "_g", [], "_a"), "_p", [], "_b")
        out["spearman"] = ranked.agg(pearson("_a", "_b").alias("r")).first().r
    if "kendall_tau" in names:
        found = kendall(own.withColumn("_all", F.lit(1)), "_g", "_p", ["_all"]).first()
        out["kendall_tau"] = found.tau if found else None
    return {n: out[n] for n in names}
