"""Splits that keep related records together, kept up incrementally.

Records hang together through nodes (spellings, entities). The component table is a folder of three tables that
batches only append to, a subfolder each: nodes (node, component it came into), moves (component, the one it was
merged into) and states (component, its rows, split, conflict; the latest counts). Moves are followed by pointer
jumping. A batch looks up its own nodes, contracts its edges to components, merges those by minimum labels with
pointer jumping, and writes what it changed: a component that had one split keeps it, one that merges several is
quarantined, and new ones fill the splits that lack rows most. Components that no record of the batch reaches are
neither read as nodes nor written.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.session import durable

PROPORTIONS = {"train": 0.8, "dev": 0.1, "test": 0.1}


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: node, component (its smallest node).

    edges: a, b; nodes: node (isolated ones too). Every round hooks each root to the smallest neighbouring
    label and then jumps pointers twice, so chains shrink geometrically; tables are written between rounds.
    Self-loops and repeats are harmless; raises if `rounds` don't suffice.
    """
    both = durable(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(nodes.select("node").unionByName(both.select(F.col("a").alias("node"))).filter("node IS NOT NULL").distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        hooks = seen.filter("lb < la").groupBy(F.col("la").alias("label")).agg(F.min("lb").alias("to"))
        roots = labels.select("label").distinct().join(hooks, "label", "left").select("label", F.coalesce("to", "label").alias("to"))
        for _ in range(2):  # pointer jumping over roots
            nxt = roots.select(F.col("label").alias("to"), F.col("to").alias("up"))
            roots = roots.join(nxt, "to").select("label", F.col("up").alias("to"))
        moved = durable(labels.join(roots, "label").select("node", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("moved")))
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components still change after {rounds} rounds")


def deal(sizes: list[tuple[int, int]], lack: dict[str, float]) -> list[tuple[int, list[int]]]:
    """How many components of each size each split gets: (size, numbers in the order of `lack`).

    sizes: (size, number of components), falling. Every split earns rows in proportion to what it lacks as components
    go by, and each component goes to the split that is owed most, so splits stay in proportion at every size and
    the last, small ones even out what large ones left. Components of a size are dealt at once, by levels.
    """
    whole = sum(max(v, 0.0) for v in lack.values())
    share = [max(v, 0.0) / whole if whole else 1 / len(lack) for v in lack.values()]
    owed, out = [0.0] * len(share), []
    for size, number in sizes:
        owed = [o + s * size * number for o, s in zip(owed, share)]
        got = [0] * len(share)
        if size > 0:
            # the level to which `number` components lower the highest debts, then what is left one by one
            ranked, left = sorted(owed, reverse=True), size * number
            level = ranked[0]
            for k in range(1, len(ranked) + 1):
                level = (sum(ranked[:k]) - left) / k
                if k == len(ranked) or level >= ranked[k]:
                    break
            got = [max(0, math.floor((o - level) / size)) for o in owed]
        for _ in range(number - sum(got)):
            k = max(range(len(share)), key=lambda i: (owed[i] - got[i] * size, share[i], -i))
            got[k] += 1
        owed = [o - g * size for o, g in zip(owed, got)]
        out.append((size, got))
    return out


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with their position from 0 in a total order, by ranges: no window holds more than a range. A written table."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return durable(local.join(F.broadcast(before.select("_range", "_before")), "_range").withColumn("position", F.col("_before") + F.col("_at")).drop("_range", "_before", "_at"))  # a row for each range


def assign(sizes: DataFrame, proportions: dict[str, float] = PROPORTIONS, totals: dict[str, int] | None = None, salt: int = 17) -> DataFrame:
    """Splits of components: component, n, split (kept if given).

    sizes: component, n (rows), split (NULL for new ones; any other string than a split's name counts for none).
    totals: rows each split holds already, beside `sizes`. New components are dealt by size (see deal()), those of a
    size in the order of a hash. The driver sees one row per distinct size, at most sqrt(2 * rows) of them.
    """
    sizes = durable(sizes)
    spark = sizes.sparkSession
    held = {r.split: r.n for r in sizes.filter("split IS NOT NULL").groupBy("split").agg(F.sum("n").alias("n")).collect()}  # a row per split
    held = {s: held.get(s, 0) + (totals or {}).get(s, 0) for s in {*held, *(totals or {})}}
    counts = [(r.n, r.k) for r in sizes.filter("split IS NULL").groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()]
    everything = sum(held.values()) + sum(n * k for n, k in counts)
    dealt = deal(counts, {s: p * everything - held.get(s, 0) for s, p in proportions.items()})
    cuts, at = [], 0
    for size, got in dealt:
        for split, g in zip(proportions, got):
            if g:
                cuts.append((size, at, at + g, split))
            at += g
    table = spark.createDataFrame(cuts, "n bigint, low bigint, high bigint, new_split string")  # a few rows per distinct size
    order = numbered(sizes.filter("split IS NULL").select("component", "n").withColumns({"_neg": -F.col("n"), "_hash": F.xxhash64("component", F.lit(salt))}), "_neg", "_hash", "component")
    new = order.join(table, "n").filter("position >= low AND position < high").select("component", "n", F.col("new_split").alias("split"))
    return sizes.filter("split IS NOT NULL").select("component", "n", "split").unionByName(new)


def _stored(spark: SparkSession, path: str, name: str, schema: str, batch: int) -> DataFrame:
    """Rows that the batches before `batch` appended to a table of the component table."""
    if batch == 0:
        return spark.createDataFrame([], schema + ", batch int")
    folders = [f"{path}/{name}/batch={b}" for b in range(batch)]
    return spark.read.option("basePath", f"{path}/{name}").schema(schema + ", batch int").parquet(*folders)


NODES, MOVES, STATES = "node string, component string", "component string, into string", "component string, n bigint, split string, conflict boolean"


def resolved_moves(spark: SparkSession, path: str, batch: int, rounds: int = 60) -> DataFrame:
    """component -> the component it is in now, for all that were merged into another: chains halve in each round."""
    moves = durable(_stored(spark, path, "moves", MOVES, batch).select("component", "into"))
    for _ in range(rounds):
        nxt = moves.select(F.col("component").alias("into"), F.col("into").alias("up"))
        jumped = durable(moves.join(nxt, "into", "left").select("component", F.coalesce("up", "into").alias("into"), F.col("up").isNotNull().alias("moved")))
        moves = jumped.select("component", "into")
        if jumped.filter("moved").isEmpty():
            return moves
    raise RuntimeError(f"merges still chain after {rounds} rounds")


def _now(df: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """Replace components by those they are in now."""
    return df.join(moves.select(F.col("component").alias(column), "into"), column, "left").withColumn(column, F.coalesce("into", column)).drop("into")


def states(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """Current components after that many batches: component, n, split, conflict."""
    latest = _stored(spark, path, "states", STATES, batches).groupBy("component").agg(F.max_by(F.struct("n", "split", "conflict"), "batch").alias("s")).select("component", "s.*")
    return latest.join(_stored(spark, path, "moves", MOVES, batches).select("component").distinct(), "component", "left_anti")


def read_components(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """The component table after that many batches: node, component, n (rows of the component), split, conflict."""
    nodes = _now(_stored(spark, path, "nodes", NODES, batches).select("node", "component"), resolved_moves(spark, path, batches), "component")
    return nodes.join(states(spark, path, batches), "component").select("node", "component", "n", "split", "conflict")


def update(spark: SparkSession, path: str, batch: int, edges: DataFrame, weights: DataFrame, proportions: dict[str, float] = PROPORTIONS) -> None:
    """Append batch number `batch` (0, 1, ...) to the component table at `path`; a batch that runs again replaces itself.

    edges: a, b. weights: node, n (rows of the batch at each node). NULL nodes are ignored. Components are named by
    the smallest of the names merged. split is 'quarantine' where components of different splits merge, and stays so.
    """
    edges = durable(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    weights = durable(weights.filter("node IS NOT NULL").groupBy("node").agg(F.sum("n").cast("bigint").alias("n")))
    own = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).unionByName(weights.select("node")).distinct()
    known = _stored(spark, path, "nodes", NODES, batch).select("node", "component").join(own, "node", "left_semi")
    placed = durable(own.join(_now(known, resolved_moves(spark, path, batch), "component"), "node", "left").select("node", F.coalesce("component", "node").alias("root"), F.col("component").isNotNull().alias("old")))
    root = placed.select("node", "root")
    lifted = edges.join(root.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(root.withColumnsRenamed({"node": "b", "root": "rb"}), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct()
    found = durable(components(lifted, placed.select(F.col("root").alias("node")).distinct()).withColumnRenamed("node", "root"))

    write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    write(placed.filter("NOT old").join(found, "root").select("node", "component"), "nodes")
    write(placed.filter("old").select("root").distinct().join(found, "root").filter("root <> component").select(F.col("root").alias("component"), F.col("component").alias("into")), "moves")
    before = durable(states(spark, path, batch)) if batch else spark.createDataFrame([], STATES)
    had = found.join(before.withColumnRenamed("component", "root"), "root").groupBy("component").agg(F.sum("n").alias("old_n"), F.collect_set("split").alias("had"))  # a name per split at most
    fresh = weights.join(placed, "node").join(found, "root").groupBy("component").agg(F.sum("n").alias("new_n"))
    n = F.coalesce("old_n", F.lit(0)) + F.coalesce("new_n", F.lit(0))
    kept = F.when(F.size("had") > 1, F.lit("quarantine")).otherwise(F.get("had", F.lit(0)))
    merged = durable(found.select("component").distinct().join(had, "component", "left").join(fresh, "component", "left").select("component", n.alias("n"), kept.alias("split")))
    touched = before.join(found.select(F.col("root").alias("component")), "component", "left_semi")
    rest = before.join(touched.select("component"), "component", "left_anti").groupBy("split").agg(F.sum("n").alias("n"))
    totals = {r.split: r.n for r in rest.collect()}  # a row per split
    write(assign(merged, proportions, totals).select("component", "n", "split", (F.col("split") == "quarantine").alias("conflict")), "states")
