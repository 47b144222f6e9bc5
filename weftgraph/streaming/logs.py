"""Structured Streaming over the hook log.  Event time, watermarks and windows are additions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Log files of a folder as they arrive; malformed lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions by gap; rows later than the watermark are left out."""
    own = stream.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum("saved").alias("saved")).select("session", F.col("w.start").alias("first_ts"), "n", "saved")


def replay_guard(stream: DataFrame, late: str = "24 hours") -> DataFrame:
    """Envelopes without the ids seen within the replay window."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["message_id"])


def drained(stream: DataFrame, path: str, empty_batches: bool = True) -> DataFrame:
    """All that a stream has by now, written below path and read again.  The checkpoint stays there too: a later call
    with the same path takes up where this one ended.  empty_batches: whether the watermark of the last rows still fires
    timers; a stream with state that expires by the clock would go on for ever with them."""
    spark, name = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(empty_batches).lower())
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def packets(results: DataFrame, path: str) -> DataFrame:
    """Results of a stream in the order of their arrival, each with its micro-batch; nothing is ranked, cut or left out."""
    spark = results.sparkSession
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/rows/arrival={n}")
    results.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")
