"""Documents, chunk rows and chat states as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.catalog import KnowledgeBase
from corpusloom.functions.times import instant


def read_tables(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def load_documents(stream: DataFrame, kb: KnowledgeBase, checkpoint: str) -> StreamingQuery:
    """Adds every batch of (doc_id, text, …) rows to a knowledge base; a repeated batch adds nothing, since stored ids are skipped."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, _: kb.add_documents(rows)).start()


def latest_states(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """The latest state of each exchange: one row per (thread_id, message_id), kept until `late` after it."""
    timed = stream.where("thread_id is not null and message_id is not null").withWatermark("received_at", late)
    columns = [c for c in stream.columns if c not in ("thread_id", "message_id", "received_at")]
    return timed.groupBy("thread_id", "message_id").agg(F.max(F.struct("received_at", *columns)).alias("s")).select("thread_id", "message_id", "s.*")


def exchange_rates(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, exchanges): user inputs per window of their own time; rows later than `late` are dropped."""
    timed = stream.withColumn("said_at", instant(F.col("user_input_timestamp"))).where("said_at is not null").withWatermark("said_at", late)
    return timed.groupBy(F.window("said_at", width)).agg(F.count(F.lit(1)).alias("exchanges"))
