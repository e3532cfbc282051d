"""Scars that arrive as files, assessed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scarpline.operators.scars import assess

SCHEMA = "scar_id string, seen_at timestamp, area_m2 double, upstream_area_km2 double, local_relief_m double"


def landing(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The stream of scars from JSON files put into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def assessed(stream: DataFrame) -> DataFrame:
    """Each scar assessed; no state is kept."""
    return assess(stream)


def verdicts_by_hour(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, verdict, scars), final once the watermark has passed; a re-delivered scar counts once while the watermark holds it, scars later than late are left out."""
    d = assess(stream).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["scar_id"])
    return d.groupBy(F.window("seen_at", "1 hour").alias("w"), "verdict").agg(F.count(F.lit(1)).alias("scars")).select(F.col("w.start").alias("hour"), "verdict", "scars")


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to a parquet folder; once works off what is there and ends."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
