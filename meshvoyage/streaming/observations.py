"""Environmental observations per cell and time window, batch or streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(observations: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(cell, start, end, n, mean) of observations (cell, ts, value) in tumbling windows.

    ``late`` is the watermark of a stream: how long after it a window stays open.
    """
    rows = observations.withWatermark("ts", late) if late else observations
    groups = rows.groupBy("cell", F.window("ts", width).alias("w"))
    return groups.agg(F.count("value").alias("n"), F.avg("value").alias("mean")).select("cell", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def keep_current(observations: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, width: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Hands each batch of changed window means to ``apply``, such as a renewal of the affected cells' costs."""
    return windowed(observations, width, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(apply).start()


def updated_cells(cells: DataFrame, means: DataFrame, field: str) -> DataFrame:
    """``cells`` with ``field`` from the latest window mean of each cell, where there is one."""
    latest = means.groupBy("cell").agg(F.max_by("mean", "end").alias("_new"))
    return cells.join(latest, F.col("id") == F.col("cell"), "left").withColumn(field, F.coalesce("_new", field)).drop("cell", "_new")
