"""Cell statistics of points that keep arriving.

Count, sum, least and largest merge, so each batch's partial aggregates are added
to those kept; means follow from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Grid, noise_mask
from ..operators.raster import with_cell


def running_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Streaming aggregate of a stream of points: cell, n, low, high, total, mean so far."""
    kept = with_cell(points.where(~noise_mask()), grid)
    found = kept.groupBy("cell").agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"), F.sum("z").alias("total"))
    return found.withColumn("mean", F.col("total") / F.col("n"))


def start(points: DataFrame, grid: Grid, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the running cells in a table in memory, all of what has arrived so far."""
    return running_cells(points, grid).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
