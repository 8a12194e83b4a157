"""Re-query on change: a stream of changed rows keeps a query's snapshot, and a subscriber hears of new content only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.store import dump_digest


class ReactiveQuery:
    """Runs `query()` after each micro-batch and calls `emit(snapshot, digest)` when the content changed. A failed run
    keeps the last snapshot and its error; micro-batches are serial, so runs never overlap."""

    def __init__(self, query: Callable[[], DataFrame], emit: Callable[[DataFrame, str], None]):
        self.query, self.emit, self.digest, self.error = query, emit, None, None

    def refresh(self) -> bool:
        try:
            snapshot = self.query()
            digest = dump_digest(snapshot).first()["digest"]
        except Exception as error:  # the stream outlives a failed re-query
            self.error = error
            return False
        self.error = None
        if digest == self.digest:
            return False
        self.digest = digest
        self.emit(snapshot, digest)
        return True

    def follow(self, changes: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        writer = changes.writeStream.foreachBatch(lambda _, __: self.refresh() and None).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "150 milliseconds"})).start()
