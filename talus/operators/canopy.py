"""Surface model and canopy heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CanopyParams, Grid, vegetation_mask
from .raster import around, dense, mean_around, median_around, occupied


def surface_model(points: DataFrame, dem: DataFrame, grid: Grid) -> DataFrame:
    """``dem`` (cell, row, col, dem, ...) with ``dsm``.

    The highest return that may be vegetation; where there is none, the mean of
    the occupied cells around, else the ground; never below the ground.
    """
    top = occupied(points.where(vegetation_mask()), grid, top=F.max("z"))
    both = around(dem.join(top, "cell", "left"), "top", into="_nb")
    filled = F.coalesce(F.col("top"), mean_around("_nb"), F.col("dem"))
    return both.withColumn("dsm", F.greatest(filled, F.col("dem"))).drop("_nb", "top")


def cleaned_height(params: CanopyParams, chm: str = "_chm", nb: str = "_nb") -> Column:
    """Canopy height without spikes and pits, by the median around, which is taken before either is removed."""
    most = F.lit(params.max_height_m)

    def clean(v: Column) -> Column:
        spike = F.when(v["h"] > most, F.least(v["m"], most)).otherwise(v["h"])
        return F.when(v["m"] - spike > params.pit_fill_m, v["m"]).otherwise(spike) if params.pit_fill_m > 0 else spike

    # Bound to a name, the median is sorted out once and not wherever it is used.
    return F.transform(F.array(F.struct(F.col(chm).alias("h"), median_around(nb).alias("m"))), clean)[0]


def canopy_height_model(cells: DataFrame, params: CanopyParams = CanopyParams()) -> DataFrame:
    """Adds ``chm`` to a table with dsm and dem."""
    raw = cells.withColumn("_chm", F.greatest(F.col("dsm") - F.col("dem"), F.lit(0.0)))
    return around(raw, "_chm", into="_nb").withColumn("chm", cleaned_height(params)).drop("_chm", "_nb")


def top_heights(points: DataFrame, grid: Grid) -> DataFrame:
    """The dense raster of highest returns that may be vegetation: cell, row, col, v."""
    return dense(occupied(points.where(vegetation_mask()), grid, v=F.max("z")), grid)
