"""Streaming ingest of an append-only log: what was taken is not taken again.

The reference's nearest counterpart is a log with resume; here it is a stream that drops repeats by id
within a watermark, aggregates event-time windows, commits each batch once and starts where it ended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.registry import CORE
from tallymill.session import shared_folder


def ingest(spark: SparkSession, source: str, glob: str, target: str, checkpoint: str, late: str = "10 days", window: str = "1 day") -> None:
    """Take all new files once: (start, event_type, n, total) by window, repeats of event_id dropped.

    Run again with the same checkpoint it takes only files that came since. Rows later than ``late``
    are dropped by the watermark; rows without a time or id are left out.
    """
    schema = spark.read.option("pathGlobFilter", glob).parquet(source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null and event_id is not null").withWatermark("ts", late).dropDuplicates(["event_id", "ts"])
    agg = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    flat = agg.select(F.col("w.start").alias("start"), "event_type", "n", "total")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")  # a batch that is run again replaces itself

    q = flat.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def result(spark: SparkSession, target: str) -> DataFrame:
    """The last value of each window and type over all batches."""
    t = spark.read.parquet(target)
    return t.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("start", "event_type", "r.n", "r.total")


@CORE.query("stream_windows", sql="select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 6) as total from (select distinct event_id, ts, event_type, value from events where ts is not null) group by all")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and totals by type, taken from the log as a stream."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ingest(spark, sf_dir, "events.parquet", f"{base}/out", f"{base}/state")
    r = result(spark, f"{base}/out")
    return r.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))
