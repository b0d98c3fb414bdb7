"""Session factory and the few settings the engine relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Setting by which a write removes its shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "glossmill", master: str | None = None, conf: Mapping[str, str] | None = None) -> SparkSession:
    """Return the active session or build one; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset, on a local master, is a temporary folder made and set.
    A cluster session without the setting is an error: a machine-local folder would
    lose the data with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="glossmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to a table in the shared folder and read them back.

    An executor that is lost later costs nothing, the plan behind the rows runs once (a
    checkpoint() would run its last stage twice), and later reads prune columns. Laziness
    ends here; use it where a result is read more than once or a loop would grow the plan.
    The write's shuffle files are removed as it ends: else they stay until the driver happens
    to collect its garbage, and a query of many steps holds them all on disk.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "table")
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if was is None else spark.conf.set(SHUFFLE_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """durable() of the frame that make() returns; the tables that make() wrote on its way are removed then."""
    first = len(_written)
    out = durable(make())
    kept = _written.pop()
    clean(spark, first)
    _written.append(kept)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that is written and read again; clean() removes it."""
    path = os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")
    if not _written:
        atexit.register(_clean_at_exit)
    _written.append(path)
    return path


#: Paths that this process has written in the shared folder.
_written: list[str] = []


def clean(spark: SparkSession, first: int = 0) -> int:
    """Remove the written tables of this process, from the `first` on, from the shared folder; frames that read them are void then.

    Call it once the results of the queries are stored. It also runs when Python ends while the session lives.
    """
    hadoop, conf, gone = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while len(_written) > first:
        path = hadoop.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def _clean_at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            clean(spark)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


#: Rows of a table that is broadcast, at most.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame) -> DataFrame:
    """A written table of short rows, to be broadcast in a join if its rows are counted to be BROADCAST_ROWS at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition rows that are few bytes but much work, so adaptive coalescing doesn't leave them to one core."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan over all cores only where it has fewer partitions than that; large inputs keep their splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(3 * cores, *keys)
