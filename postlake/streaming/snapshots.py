"""Listing snapshots as a stream: every micro-batch is one merge, committed as one version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postlake.operators.merge import merge
from postlake.streaming.versions import VersionedTable


def merge_batch(table: VersionedTable, batch: DataFrame, number: int, now: str, complete: bool | str = True, writer: str = "snapshots", before_publish=None) -> int:
    """Merge a batch into the table (dealt by source_id), once: a batch that comes again leaves the table as it is.

    Only the buckets of sources that the batch lists are read and written.
    """
    return table.update(batch, lambda state, incoming: merge(state, incoming, now, complete).drop("event"), writer, number, before_publish)


def merge_stream(snapshots: DataFrame, table: VersionedTable, checkpoint: str, now: str, complete: bool | str = False, writer: str = "snapshots") -> StreamingQuery:
    """Start a query that merges each micro-batch of snapshots into the table.

    With the name of a boolean column as complete a source closes what it no longer lists only if all its rows in the batch say so, as
    a listing may be split over batches; without it nothing is closed.
    """
    def one(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            merge_batch(table, held, number, now, complete, writer)
        finally:
            held.unpersist()

    return snapshots.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
