"""Queries that load files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.ordering import latest
from corpusloom.session import scratch, table
from corpusloom.sources import files
from corpusloom.streaming import ingest


def _lines(spark, d, *columns: str):
    """The lines of the corpus, to be written as text."""
    rows = table(spark, d, "documents").where(F.col("text").isNotNull())
    return rows.select(*columns, F.explode(F.split("text", "\n", -1)).alias("value"))


def _parts(texts):
    """The lines of files that end with a line break."""
    return texts.select("*", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)).alias("line"))


def src_03(spark, d):
    """The corpus as plain text files of bounded size, read by the text source: how often each line stands in it."""
    folder = scratch(spark, "text")
    _lines(spark, d).write.option("maxRecordsPerFile", 20_000).text(folder)
    return _parts(files.read_texts(spark, folder)).groupBy("line").agg(F.count(F.lit(1)).alias("times"))


def src_04(spark, d):
    """A tree of text files, a folder for each source, read by the directory source: lines and characters of each source."""
    folder = scratch(spark, "files")
    _lines(spark, d, "source").where("source is not null").write.option("maxRecordsPerFile", 20_000).partitionBy("source").text(folder)
    found = files.read_directory(spark, folder).where("error is null")
    source = F.regexp_extract("doc_id", "^source=([^_]+)_", 1)
    return _parts(found.select(source.alias("source"), "text")).groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).cast("bigint").alias("characters"))


def _run(stream, spark):
    """All updates that a stream gives until its present input is read, as files of the shared directory."""
    folder = scratch(spark, "stream")

    def keep(rows, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _states(spark, d):
    kind = ", ".join(f"{n} {t}" for n, t in table(spark, d, "interactions").dtypes)
    return ingest.read_tables(spark, f"{d}/interactions.parque[t]", kind)  # a pattern takes a file as well as a folder


def str_01(spark, d):
    """The chat states as a stream of files: the latest state of each exchange."""
    found = _run(ingest.latest_states(_states(spark, d), "3650 days"), spark)
    return latest(found, ["thread_id", "message_id"], ["received_at"], ["received_at", "model_response_status"]).select("thread_id", "message_id", "model_response_status", F.unix_micros("received_at").alias("received_us"))


def str_02(spark, d):
    """User inputs per day of their own time, as a stream with a watermark; the last update of a window is its count."""
    found = _run(ingest.exchange_rates(_states(spark, d), "1 day", "3650 days"), spark)
    return found.groupBy(F.unix_seconds("window.start").alias("day")).agg(F.max("exchanges").alias("exchanges"))


QUERIES = {"src_03_text_files": src_03, "src_04_directory": src_04, "str_01_latest_states": str_01, "str_02_exchange_rates": str_02}
SQL = {
    "src_03_text_files": "select line, count(*) as times from (select unnest(string_split(text, chr(10))) as line from documents where text is not null) group by 1",
    "src_04_directory": "select source, count(*) as lines, cast(sum(length(line)) as bigint) as characters from (select source, unnest(string_split(text, chr(10))) as line from documents where text is not null and source is not null) group by 1",
    "str_01_latest_states": "select thread_id, message_id, nullif(arg_max(coalesce(model_response_status, '<null>'), received_at), '<null>') as model_response_status, epoch_us(max(received_at)) as received_us from interactions where thread_id is not null and message_id is not null group by 1, 2",
    "str_02_exchange_rates": """with s as (select trim(user_input_timestamp) as s from interactions),
t as (select case
    when regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?') then try_cast(replace(s, ' ', 'T') || 'Z' as timestamptz)
    when regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})') then try_cast(replace(s, ' ', 'T') as timestamptz)
    when regexp_full_match(s, '\\d{1,11}') then to_timestamp(try_cast(s as bigint)) end as t from s)
select cast(floor(epoch(t)) as bigint) // 86400 * 86400 as day, count(*) as exchanges from t where t is not null group by 1""",
}
