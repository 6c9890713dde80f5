"""A drift monitor over event streams: windowed class counts, effective sample size and a binned AUC.

All its state is sums that merge (an exact AUC's is not), so late rows and restarts are the engine's business."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ratio


def event_stream(spark: SparkSession, path: str, name: str = "events") -> DataFrame:
    """The event files as a stream; time stamps without a zone become instants, as watermarks need."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_sums(events: DataFrame, positive: str = "purchase", length: str = "1 hour", late: str = "2 hours", bins: int = 10, span: float = 100.0) -> DataFrame:
    """(start, bin, n, positives, w, ww) by window and score bin. Streams and tables alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    score = F.least(F.greatest(F.floor(F.col("value") / span * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    weight = F.lit(1.0) + F.coalesce(F.col("value"), F.lit(0.0)) / span
    y = (F.col("event_type") == positive).cast("long")
    out = events.groupBy(F.window("ts", length).alias("window"), F.coalesce(score, F.lit(0)).alias("bin"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.sum(weight).alias("w"), F.sum(weight * weight).alias("ww")).select(F.col("window.start").alias("start"), "bin", "n", "positives", "w", "ww")


def window_report(sums: DataFrame) -> DataFrame:
    """(start, n, positives, ess_fraction, auc) from window_sums: a window's bins are few, whatever its rows."""
    from pyspark.sql import Window

    below = Window.partitionBy("start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    neg = F.col("n") - F.col("positives")
    some = sums.withColumn("_below", F.coalesce(F.sum(neg).over(below), F.lit(0)))
    total_neg = F.sum(F.col("n") - F.col("positives"))
    return some.groupBy("start").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), (ratio(F.pow(F.sum("w"), F.lit(2.0)), F.sum("ww")) / F.sum("n")).alias("ess_fraction"), ratio(F.sum(F.col("positives") * (F.col("_below") + neg / 2)).cast("double"), F.sum("positives") * total_neg).alias("auc"))


def run_to_table(events: DataFrame, path: str, checkpoint: str, **options) -> DataFrame:
    """Run the monitor over what is there and return its sums. Windows that the watermark has closed are appended to Parquet
    at path, and their state goes; those that late rows may still reach wait in the checkpoint for the next run, and
    are read from there as they stand."""
    sums = window_sums(events, **options)
    query = sums.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = events.sparkSession
    closed = spark.read.schema(sums.schema).parquet(path)
    held = spark.read.format("statestore").load(checkpoint)
    key = F.col("key").cast("struct<window:struct<start:timestamp,end:timestamp>,bin:int>")
    value = F.col("value").cast("struct<n:long,positives:long,w:double,ww:double>")
    return closed.unionByName(held.select(key.alias("k"), value.alias("v")).select("k.window.start", "k.bin", "v.*"))
