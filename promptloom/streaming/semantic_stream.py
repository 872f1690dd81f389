"""Semantic operators on streams: the batch operators applied to each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptloom.functions.backends import Backend
from promptloom.operators.semantic import sem_map


def sem_stream(stream: DataFrame, template: str, out: str, backend: Backend, sink: Callable[[DataFrame, int], None], checkpoint: str, keep: str | None = None, dedup: bool = True, **trigger) -> StreamingQuery:
    """Each micro-batch with its replies goes to ``sink(rows, batch_id)``, only rows with the
    reply ``keep`` if that is given. Equal prompts of a micro-batch are asked once; a
    micro-batch that is run again has the same id, so a sink can make it idempotent."""

    def run(batch: DataFrame, batch_id: int) -> None:
        replied = sem_map(batch, template, out, backend, dedup=dedup)
        sink(replied.filter(F.col(out) == keep) if keep is not None else replied, batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_replies(stream: DataFrame, ts: str, reply: str, width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """How often each reply occurs per event-time window; rows later than ``lateness`` are dropped."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width), reply).count()
