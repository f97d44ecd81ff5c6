"""Cells: binning, the dense domain, neighbourhoods, morphology and sampling.

A raster is a table keyed by (row, col), a row for every cell; null is no data.
Layers of one grid stay columns of one table, so that no join combines them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..model import Grid

STATISTICS = ("min", "max", "mean", "count")
AROUND = ("nw", "n", "ne", "w", "c", "e", "sw", "s", "se")


def domain(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every cell of a grid: cell, row, col."""
    cells = spark.range(grid.n_cells).withColumnRenamed("id", "cell")
    return cells.select("cell", F.floor(F.col("cell") / grid.width).cast("int").alias("row"), (F.col("cell") % grid.width).cast("int").alias("col"))


def with_cell(points: DataFrame, grid: Grid) -> DataFrame:
    """Points inside the grid with their cell."""
    return points.withColumn("cell", grid.flat_index()).where("cell IS NOT NULL")


def statistic(stat: str, value: str = "z") -> Column:
    """One of ``STATISTICS`` as an aggregate."""
    if stat not in STATISTICS:
        raise ConfigError(f"unknown statistic {stat!r}; choose from {', '.join(STATISTICS)}")
    return {"min": F.min, "max": F.max, "mean": F.avg, "count": F.count}[stat](value)


def occupied(points: DataFrame, grid: Grid, **layers: Column) -> DataFrame:
    """Aggregates of the cells that have points: partial sums before the one shuffle."""
    return with_cell(points, grid).groupBy("cell").agg(*(c.alias(n) for n, c in layers.items()))


def cell_statistic(points: DataFrame, grid: Grid, stat: str, value: str = "z") -> DataFrame:
    """A dense raster (cell, row, col, v): null where a cell has no points, but 0 for counts."""
    found = occupied(points, grid, v=statistic(stat, value))
    out = domain(points.sparkSession, grid).join(found, "cell", "left")
    return out.withColumn("v", F.coalesce("v", F.lit(0))) if stat == "count" else out


def dense(found: DataFrame, grid: Grid) -> DataFrame:
    """``found`` (cell and layers) with the cells it lacks, their layers null."""
    return domain(found.sparkSession, grid).join(found, "cell", "left")


def around(cells: DataFrame, value: str = "v", replicate: bool = True, into: str = "nb", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a struct of the nine values around each cell of a dense raster.

    Beyond the edge a value is the nearest cell's own, or null without
    ``replicate``.  A row pass then a column pass: two shuffles and no join.
    ``by`` names columns that keep rasters in one table apart.
    """

    def beside(name: str, step: Column, own: Column) -> Column:
        # A struct is null only beyond the edge, its value also where there is no data.
        return (F.coalesce(step, own) if replicate else step)[name].alias(name)

    along = Window.partitionBy(*by, "row").orderBy("col")
    own = F.struct(F.col(value).alias("x"))
    west, east = F.lag(own).over(along), F.lead(own).over(along)
    line = F.struct(beside("x", west, own).alias("w"), F.col(value).alias("c"), beside("x", east, own).alias("e"))
    down = Window.partitionBy(*by, "col").orderBy("row")
    north, south = F.lag("_line").over(down), F.lead("_line").over(down)
    rows = cells.withColumn("_line", line).withColumn("_north", F.coalesce(north, F.col("_line")) if replicate else north).withColumn("_south", F.coalesce(south, F.col("_line")) if replicate else south)
    parts = {"nw": "_north.w", "n": "_north.c", "ne": "_north.e", "w": "_line.w", "c": "_line.c", "e": "_line.e", "sw": "_south.w", "s": "_south.c", "se": "_south.e"}
    return rows.withColumn(into, F.struct(*(F.col(p).alias(k) for k, p in parts.items()))).drop("_line", "_north", "_south")


def mean_around(nb: str = "nb") -> Column:
    """Mean of the values there are among the nine; null if there is none."""
    values = [F.col(f"{nb}.{k}") for k in AROUND]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.try_divide(total, n)


def median_around(nb: str = "nb") -> Column:
    """The fifth of the nine values."""
    return F.element_at(F.array_sort(F.array(*(F.col(f"{nb}.{k}") for k in AROUND))), 5)


def box(cells: DataFrame, half: int, least: bool, value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """Least or largest value of the square of 2 half + 1 cells, clipped at the edge: a row pass, then a column pass."""
    take = F.min if least else F.max
    along = Window.partitionBy(*by, "row").orderBy("col").rangeBetween(-half, half)
    down = Window.partitionBy(*by, "col").orderBy("row").rangeBetween(-half, half)
    return cells.withColumn(value, take(value).over(along)).withColumn(value, take(value).over(down))


def opening(cells: DataFrame, window: int, value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """Grey opening by a square window of odd size: erosion, then dilation."""
    return box(box(cells, window // 2, True, value, by), window // 2, False, value, by)


def sample(points: DataFrame, cells: DataFrame, grid: Grid, value: str = "v", into: str = "sampled") -> DataFrame:
    """Adds the bilinear value of a dense raster at each point, clamped to the outer cell centers.

    Each cell first gets its east, south and south-east neighbours, so a point
    needs one join, on the cell north-west of it.
    """
    corners = around(cells.select("cell", "row", "col", value), value).select(F.col("cell").alias("_cell"), F.col("nb.c").alias("_c"), F.col("nb.e").alias("_e"), F.col("nb.s").alias("_s"), F.col("nb.se").alias("_se"))
    u = (F.col("x") - F.lit(grid.x0)) / F.lit(grid.res) - F.lit(0.5)
    v = (F.lit(grid.y1) - F.col("y")) / F.lit(grid.res) - F.lit(0.5)
    held = points.withColumn("_u", F.least(F.greatest(u, F.lit(0.0)), F.lit(float(grid.width - 1)))).withColumn("_v", F.least(F.greatest(v, F.lit(0.0)), F.lit(float(grid.height - 1))))
    held = held.withColumn("_cell", F.floor("_v") * F.lit(grid.width) + F.floor("_u")).withColumn("_fx", F.col("_u") - F.floor("_u")).withColumn("_fy", F.col("_v") - F.floor("_v"))
    fx, fy = F.col("_fx"), F.col("_fy")
    top, bottom = F.col("_c") * (1 - fx) + F.col("_e") * fx, F.col("_s") * (1 - fx) + F.col("_se") * fx
    out = held.join(corners, "_cell", "left").withColumn(into, top * (1 - fy) + bottom * fy)
    return out.drop("_u", "_v", "_cell", "_fx", "_fy", "_c", "_e", "_s", "_se")


def block_max(cells: DataFrame, factor: int, value: str = "v") -> DataFrame:
    """Largest value of each block of factor x factor cells: row, col, v of the coarser raster."""
    return cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.max(value).alias(value))


def reduced(cells: DataFrame, grid: Grid, most: int, **layers: Column) -> tuple[DataFrame, Grid]:
    """Aggregates by blocks of cells, as many as bring the raster to at most ``most`` a side, and their grid."""
    factor = max(1, math.ceil(max(grid.shape) / most))
    height, width = (math.ceil(n / factor) for n in grid.shape)
    coarse = Grid(grid.x0, grid.y1, grid.res * factor, width, height, grid.crs, grid.meters_per_unit)
    found = cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(*(c.alias(n) for n, c in layers.items()))
    return found.withColumn("cell", F.col("row").cast("long") * width + F.col("col")), coarse
