"""The query log as a stream: append, metrics by backend, re-indexing of documents as they come; and windows over events.

The windows over ``events`` are an extension: the log itself is append-only JSON lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "ts timestamp, source string, backend string, question string, top_score double, top_logit double, control_modules array<string>, cm_ambiguous boolean, doc_filenames array<string>, refused boolean, grounded boolean, unverified array<string>, claims_checked int, n int"


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RECORD).json(path)


def metrics(log: DataFrame) -> DataFrame:
    """By backend, never across: queries, refusals, ungrounded answers, mean best logit. The same for a table and a stream."""
    return log.groupBy("backend").agg(
        F.count("*").alias("queries"),
        F.count_if("refused").alias("refused"),
        F.count_if(~F.coalesce("grounded", F.lit(True))).alias("ungrounded"),
        F.round(F.avg("top_logit"), 4).alias("mean_logit"),
    )


def reindex_stream(fresh: DataFrame, path: str, checkpoint: str):
    """Chunks of documents that arrive replace the partitions of those documents, batch by batch."""
    from foliograph.operators.catalog import overwrite_documents

    return fresh.writeStream.foreachBatch(lambda batch, _: overwrite_documents(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling windows by event type with a watermark; works on a table and on a stream."""
    # A watermark needs an instant; times without a zone are taken in that of the session.
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    # A watermark needs an instant; times without a zone are taken in that of the session.
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
