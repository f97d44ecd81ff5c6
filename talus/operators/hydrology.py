"""Flow: directions, accumulation, streams and their orders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, numbered
from ..model import Grid, HydrologyParams
from .fill import fill_depressions
from .graph import accumulate, ranks, roots
from .raster import around

OUTLET = 0
#: Codes clockwise from east: (code, neighbour, row step, column step).  Fixed values.
DIRECTIONS = ((1, "e", 0, 1), (2, "se", 1, 1), (4, "s", 1, 0), (8, "sw", 1, -1), (16, "w", 0, -1), (32, "nw", -1, -1), (64, "n", -1, 0), (128, "ne", -1, 1))


def flow_direction(cells: DataFrame, grid: Grid, value: str = "filled", into: str = "direction", edge_outlets: bool = True, res_m: float | None = None) -> DataFrame:
    """Adds the D8 code of each cell; the border drains outward with ``edge_outlets``."""
    meters = grid.res_m if res_m is None else res_m
    near = around(cells, value, replicate=False, into="_nb")
    falls = F.array(*((F.col("_nb.c") - F.col(f"_nb.{name}")) / F.lit(meters * (math.sqrt(2.0) if dr and dc else 1.0)) for _, name, dr, dc in DIRECTIONS))
    # The codes are powers of two in the order of the falls; the first of equal ones counts.
    code = F.transform(F.array(falls), lambda d: F.when(F.array_max(d) > 0, F.pow(F.lit(2), F.array_position(d, F.array_max(d)) - 1)).otherwise(F.lit(OUTLET)))[0]
    if edge_outlets:
        border = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == grid.height - 1) | (F.col("col") == grid.width - 1)
        code = F.when(border, F.lit(OUTLET)).otherwise(code)
    return near.withColumn(into, code.cast("smallint")).drop("_nb")


def downstream(grid: Grid, direction: str = "direction") -> Column:
    """The cell that a cell drains to; null at an outlet."""
    found = F.lit(None).cast("long")
    for code, _, dr, dc in DIRECTIONS:
        found = F.when(F.col(direction) == code, F.col("cell") + F.lit(dr * grid.width + dc)).otherwise(found)
    return found


def flow_accumulation(cells: DataFrame, weight: Column | None = None, small: int | None = None) -> DataFrame:
    """(cell, acc) from (cell, downstream): the number, or summed weight, of cells that drain through each, itself included."""
    nodes = cells.select(F.col("cell").alias("node"), F.col("downstream").alias("next"), (F.lit(1).cast("long") if weight is None else weight).alias("weight"))
    return accumulate(nodes, small=small).withColumnRenamed("node", "cell")


def streams(cells: DataFrame, threshold_cells: float) -> DataFrame:
    """Cells whose accumulation reaches the threshold, with the number of stream cells that drain into each.

    cells: cell, downstream, acc.  Result: cell, downstream, acc, inflow.
    """
    kept = cells.where(F.col("acc") >= threshold_cells).select("cell", "downstream", "acc")
    inflow = kept.where("downstream IS NOT NULL").groupBy("downstream").agg(F.count("*").alias("inflow")).withColumnRenamed("downstream", "cell")
    return kept.join(inflow, "cell", "left").withColumn("inflow", F.coalesce("inflow", F.lit(0)))


def _starts(stream: DataFrame, small: int | None) -> DataFrame:
    """(cell, start) of stream cells: the head or junction that each one's reach starts at."""
    above = stream.where("downstream IS NOT NULL").select(F.col("downstream").alias("cell"), F.col("cell").alias("up"))
    nodes = stream.where("inflow = 1").join(above, "cell").select(F.col("cell").alias("node"), F.col("up").alias("next"))
    heads = stream.where("inflow != 1").select(F.col("cell").alias("node"), F.lit(None).cast("long").alias("next"))
    return roots(nodes.unionByName(heads), small).select(F.col("node").alias("cell"), F.col("root").alias("start"))


def _paths(stream: DataFrame, start: DataFrame, small: int | None) -> DataFrame:
    """start, path, into (the junction that follows), acc and strahler_order of every reach, single cells too."""
    found = cut(
        stream.join(start, "cell")
        .groupBy("start")
        .agg(F.array_sort(F.collect_list(F.struct("acc", "cell"))).alias("path"), F.max_by("downstream", F.struct("acc", "cell")).alias("into"), F.max("acc").alias("acc"))
    )
    orders = ranks(found.select(F.col("start").alias("node"), F.col("into").alias("next")), small)
    return found.join(orders.select(F.col("node").alias("start"), F.col("rank").alias("strahler_order")), "start")


def reaches(stream: DataFrame, grid: Grid, small: int | None = None) -> DataFrame:
    """Reaches between heads, junctions and outlets.

    stream: cell, downstream, acc, inflow.  A reach starts where no or several
    stream cells drain in, and runs to and with the next junction; a single cell
    is none.  Result: reach_id (from 1, by start), start, cells, strahler_order,
    length_m, contributing_area_ha (at the last cell before the junction).
    """
    stream = cut(stream)
    cells = F.concat(F.transform("path", lambda p: p["cell"]), F.when(F.col("into").isNotNull(), F.array("into")).otherwise(F.array().cast("array<bigint>")))
    whole = _paths(stream, _starts(stream, small), small).withColumn("cells", cells).where(F.size("cells") >= 2)
    numbers = numbered(whole.select("start"), ["start"], "reach_id")  # the starts alone are put in order
    return whole.join(numbers, "start").select(
        F.col("reach_id").cast("int").alias("reach_id"),
        "start",
        "cells",
        "strahler_order",
        path_length("cells", grid).alias("length_m"),
        (F.col("acc") * F.lit(grid.cell_area_m2 / 10_000.0)).alias("contributing_area_ha"),
    )


def strahler_orders(stream: DataFrame, small: int | None = None) -> DataFrame:
    """(cell, strahler_order) of stream cells."""
    stream = cut(stream)
    start = cut(_starts(stream, small))
    return start.join(_paths(stream, start, small).select("start", "strahler_order"), "start").select("cell", "strahler_order")


def path_length(cells: str, grid: Grid) -> Column:
    """Meters along the centers of an array of cells that touch each other."""
    width, side, diagonal = grid.width, grid.res_m, grid.res_m * math.sqrt(2.0)
    return F.expr(
        f"aggregate(transform(slice({cells}, 2, size({cells}) - 1), (x, i) -> if(x div {width} != {cells}[i] div {width} AND x % {width} != {cells}[i] % {width}, double('{diagonal!r}'), double('{side!r}'))), double(0), (a, x) -> a + x)"
    )


def reach_line(cells: str, grid: Grid) -> Column:
    """The centers of an array of cells as an array of (x, y)."""
    return F.transform(cells, lambda c: F.struct(grid.center_x(c % grid.width).alias("x"), grid.center_y(F.floor(c / grid.width)).alias("y")))


def simplify_staircase(line: str) -> Column:
    """A line's ends and the vertices where the signs of its steps change."""
    turn = " OR ".join(f"sign({line}[i].{a} - {line}[i - 1].{a}) != sign({line}[i + 1].{a} - {line}[i].{a})" for a in "xy")
    return F.expr(f"filter({line}, (p, i) -> i = 0 OR i = size({line}) - 1 OR {turn})")


def threshold_cells(params: HydrologyParams, grid: Grid) -> float:
    return params.channel_threshold_ha * 10_000.0 / grid.cell_area_m2


def route_water(cells: DataFrame, grid: Grid, params: HydrologyParams = HydrologyParams(), value: str = "dem") -> tuple[DataFrame, DataFrame]:
    """``cells`` with filled, sink_depth, direction, downstream, acc, is_channel and stream_order (0 off the channels); and the reaches."""
    filled = fill_depressions(cells, grid, value)
    directed = flow_direction(filled, grid).withColumn("downstream", downstream(grid))
    directed = cut(directed.withColumn("sink_depth", F.greatest(F.col("filled") - F.col(value), F.lit(0.0))))
    whole = cut(directed.join(flow_accumulation(directed), "cell"))
    limit = threshold_cells(params, grid)
    stream = cut(streams(whole, limit))
    ordered = whole.join(strahler_orders(stream).withColumnRenamed("strahler_order", "stream_order"), "cell", "left")
    named = ordered.withColumns({"is_channel": F.col("acc") >= limit, "stream_order": F.coalesce("stream_order", F.lit(0))})
    return named, reaches(stream, grid)
