"""Panels from streams: the cells of a panel as events arrive, late ones up to a watermark.

The batch panels' rule that nothing counts before it is public is a watermark here: a cell is final, and is
handed on once, when the watermark has passed its day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files in `folder`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def streaming_cells(events: DataFrame, time: str, asset: str, value: str, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """d, asset, px (the mean of `value`), volume (its count) of a stream; in append mode each cell comes once, when it is final."""
    timed = events.select(F.col(time).cast("timestamp").alias("t"), F.col(asset).alias("asset"), F.col(value).alias("v")).where("v IS NOT NULL")
    cells = timed.withWatermark("t", lateness).groupBy(F.window("t", width), "asset").agg(F.avg("v").alias("px"), F.count("*").cast("double").alias("volume"))
    return cells.select(F.to_date("window.start").alias("d"), "asset", "px", "volume")


def written_once(cells: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends final cells to parquet below `folder`; its state and progress are in `checkpoint`, in shared storage."""
    return cells.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
