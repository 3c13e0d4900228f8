"""Structured Streaming: reference records that arrive are matched against a standing pool index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking as B


def stream_candidates(arriving: DataFrame, index: B.Index, path: str, checkpoint: str, order: str = "fair") -> StreamingQuery:
    """Writes each micro-batch's candidates under ``path/batch=N``. A batch that is run again overwrites its own folder, so
    every record's candidates are there once. ``arriving``: a stream of normalized records."""

    def work(batch: DataFrame, number: int) -> None:
        found = B.top_k(B.union(batch, index, order), index.knobs.top_k)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
