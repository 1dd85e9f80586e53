"""Streaming: the scoring plans over streams of files, and windows with late data.

The plans hold no state, so one statement serves tables and streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import ORACLE, SPARK
from ..operators.urls import url_basic_scores
from ..plans.catalogue import query
from ..runtime import place


def score_url_stream(urls: DataFrame) -> DataFrame:
    """Scores of a stream (or table) with the columns of the URL corpus."""
    return urls.sparkSession.sql(url_basic_scores(SPARK), url_corpus=urls)


def late_window_counts(events: DataFrame, delay: str = "3 days", width: str = "7 days", time: str = "received_at", seen: str = "source") -> DataFrame:
    """Messages in tumbling windows by source; later than ``delay`` behind the
    newest, a message no longer counts.  Null times are left out."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .where(F.col(time).isNotNull())
        .withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("w"), F.coalesce(F.col(seen), F.lit("none")).alias("source"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "source", "n")
    )


def run_available(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there and read its output back.

    Append mode: a window comes out once the watermark has passed it, and its state is dropped.
    """
    spark = stream.sparkSession
    base = place(spark, "stream")
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream over a table: a folder of files or one file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder:
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


_SAME = url_basic_scores(ORACLE).replace("{url_corpus}", "url_corpus")


@query("stream_url_scores", _SAME)
def stream_url_scores(spark, d):
    """The URL scores by a stream: the same rows as the table query gives."""
    return run_available(score_url_stream(read_stream(spark, f"{d}/url_corpus.parquet")))


@query("stream_window_counts", """with t as (select time_bucket(interval '7 days', received_at, timestamp '1970-01-01') as window_start, coalesce(source, 'none') as source from emails where received_at is not null)
  select window_start, source, count(*) as n from t where window_start + interval '7 days' <= (select max(received_at) - interval '3 days' from emails) group by 1, 2""")
def stream_window_counts(spark, d):
    """Counts of the windows that the watermark has closed: those that end three days or
    more before the newest message."""
    return run_available(late_window_counts(read_stream(spark, f"{d}/emails.parquet")))
