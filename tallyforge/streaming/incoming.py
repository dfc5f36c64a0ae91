"""Incoming items as a stream.

Naming, labelling (``codec.join_class_dim``) and prediction (``score.predict``) are row-local, keep no state and
take a stream as it is. Ranks, exact medians and metrics need a whole batch; ``triage_batches`` runs them per
micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def triage_batches(items: DataFrame, triage: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Write ``triage(micro-batch)`` for every micro-batch, one folder per batch id (replays overwrite it)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        triage(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
