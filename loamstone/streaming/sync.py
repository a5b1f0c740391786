"""Streams into collections: micro-batches as deltas, and sessions with an idle limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamstone.collection import Collection
from loamstone.operators.delta import last_per_key


def stream_into(collection: Collection, stream: DataFrame, checkpoint: str, ordinal: str, source_id: str | None = None, once: bool = True) -> StreamingQuery:
    """Puts a stream of documents (doc_id, text, metadata, created_at and ``ordinal``) into a collection.

    Of one document in a micro-batch the row with the highest ordinal counts. A batch that is run again
    after a failure writes the same documents in place, so none is doubled."""

    def put(batch: DataFrame, _: int) -> None:
        last = last_per_key(batch, "doc_id", ordinal)
        if not last.isEmpty():
            collection.index_table(last.select("doc_id", "text", "metadata", "created_at"), source_id)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def search_sessions(hits: DataFrame, ttl: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(session_id, began, ended, hits, documents) for a stream or table of hits (session_id, doc_id, at): a
    session ends once it was idle for ``ttl``; the same id later is another session. Documents are counted
    approximately, so that the state of a session stays small."""
    windows = hits.withWatermark("at", late).groupBy(F.session_window("at", ttl).alias("w"), "session_id").agg(F.count(F.lit(1)).alias("hits"), F.approx_count_distinct("doc_id").alias("documents"))
    return windows.select("session_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "hits", "documents")


def event_windows(stream: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of ``value`` in tumbling windows by event type; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
