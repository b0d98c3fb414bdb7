"""Row-local features on streams, and the incremental profile as a foreachBatch sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.features.lexical import lexical_columns
from glossmill.operators.profile import add_batch


def stream_features(items: DataFrame) -> DataFrame:
    """Lexical features of a streaming (or static) item table; no state, any output mode."""
    return items.withColumns(lexical_columns(F.col("en_target_word"), F.col("L1_source_word"), F.col("en_target_clue")))


def profile_batches(items: DataFrame, path: str, partition: str, columns: list[str], checkpoint: str):
    """Append every micro-batch's mergeable profile states to a table; a batch that runs again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        add_batch(batch, partition, columns, (), path, number)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
