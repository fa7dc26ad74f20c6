"""Readings of video frames: an extension for frames that arrive as files, with the same column functions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rimlight.functions import text as t

READINGS = "camera string, ts timestamp, text string, conf double"


def readings(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of JSON lines (camera, ts, text, conf)."""
    return spark.readStream.schema(READINGS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def parsed(rows: DataFrame) -> DataFrame:
    """Readings with their size, those without one left out."""
    return rows.withColumn("p", t.parse_size(F.col("text"))).where("p.found").select("camera", "ts", F.col("p.normalized").alias("size"), F.least(F.lit(1.0), 0.55 * F.col("conf") + 0.45 * F.col("p.quality")).alias("score"))


def votes(rows: DataFrame, window: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Per camera, window and size how many frames read it and how well; frames later than `late` are dropped."""
    grouped = parsed(rows).withWatermark("ts", late).groupBy("camera", F.window("ts", window), "size")
    return grouped.agg(F.count("*").alias("frames"), F.avg("score").alias("score")).select("camera", F.col("window.start").alias("start"), "size", "frames", "score")


def winners(batch: DataFrame) -> DataFrame:
    """The size with most frames per camera and window, then the best score, then the smallest text."""
    return batch.groupBy("camera", "start").agg(F.min_by(F.struct("size", "frames", "score"), F.struct(-F.col("frames"), -F.col("score"), "size")).alias("w")).select("camera", "start", "w.*")


def run(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each closed window's winner once: the batch number names the folder, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        winners(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return votes(rows).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
