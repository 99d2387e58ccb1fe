"""Incremental ingest: link rows that arrive as a stream go into a versioned snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from provgraph.operators.tracked import least_upsert
from provgraph.store import SnapshotStore


LINK_KEY = ["link_type", "from_id", "to_id"]


def upsert_links(stream: DataFrame, store: SnapshotStore, checkpoint: str, table: str = "links") -> StreamingQuery:
    """Start a query that upserts each micro-batch into `table`: the least confidence of all
    arrivals, the newest provenance, identity and verification of the oldest. `stream` has link_type,
    from_id, to_id, confidence and evidence columns, not `seq`; the batch number orders arrivals.
    The table is kept in buckets of the key: a batch reads and writes the buckets it touches. The
    upsert is idempotent, so a batch that is repeated after a failure changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        store.upsert(table, batch.withColumn("seq", F.lit(number).cast("long")), LINK_KEY, least_upsert)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def confidence_by_window(stream: DataFrame, at: str, window: str, late: str) -> DataFrame:
    """Links per event-time window and type with their least confidence; rows later than `late`
    behind the newest are dropped by the watermark."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, window), "link_type")
        .agg(F.count(F.lit(1)).alias("n_links"), F.min("confidence").alias("least_confidence"))
        .select(F.col("window.start").alias("start"), "link_type", "n_links", "least_confidence")
    )
