"""Documents that arrive as a stream, merged into the index batch by batch; and windowed counts of events. An extension of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.snapshot import SnapshotStore


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """(start, by, n, total) of tumbling windows; works on a stream (rows later than `late` are dropped once their window is closed) and on a table."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def merge_stream(arrivals: DataFrame, store: SnapshotStore, table: str, key: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Writes a stream of rows into a table of the index: each batch is one new snapshot in which its rows replace those of the same key, so a batch that is run again changes nothing.

    Of several rows of a key in a batch the one of the greatest `order` counts, and of equal ones (or without it) the one of the greatest hash. Only
    buckets that the batch has rows of are written.
    """

    def merge(batch: DataFrame, _: int) -> None:
        last = F.struct(*([F.col(order)] if order else []), F.xxhash64(F.struct(*batch.columns)))
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), last).alias("row")).select("row.*")
        with store.writing():
            store.merge(table, newest, key)

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
