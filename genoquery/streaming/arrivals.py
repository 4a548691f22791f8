"""Files and events as they arrive.

The same plans run over a stream: parsed genotype rows of new files, and counts in
event-time windows with a watermark for late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoquery.session import shared_dir


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Events per window and type; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def first_deliveries(rows: DataFrame, key: str = "record_id", at: str = "ingested_at", late: str = "7 days") -> DataFrame:
    """Rows without those delivered again within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that has arrived and gives what it wrote, from the shared folder."""
    base = f"{shared_dir(stream.sparkSession)}/{name}-{id(stream)}"
    out = f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same number again replaces its own rows

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(write).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/batch=*")


def lookup_arrivals(spark: SparkSession, folder: str, each: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Applies a batch plan to the lines of each group of newly arrived text files."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("line_no"), F.col("value").alias("line"))
    base = f"{shared_dir(spark)}/{name}"

    def run(batch: DataFrame, number: int) -> None:
        each(batch.withColumn("line_no", F.monotonically_increasing_id())).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    lines.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(run).start().awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*").drop("batch")
