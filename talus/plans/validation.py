"""Checks of products against a scene whose truth is known."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance_to_line
from ..model import SQUARE_METERS_PER_ACRE
from ..operators import classes, raster
from ..sources.synth import ORIGIN, Scene
from .pipeline import Products


@dataclass(frozen=True)
class Tolerances:
    """Inclusive limits of the checks."""

    ground_recall: float = 0.97
    ground_commission: float = 0.01
    dem_rmse: float = 0.10
    dem_rmse_under_crowns: float = 0.20
    crown_top_error: float = 0.5
    area_error: float = 0.15
    woody_area_error: float = 0.10
    channel_coverage: float = 0.95
    channel_offset_median: float = 2.0
    channel_offset_p95: float = 5.0
    outlet_share: float = 0.5


@dataclass(frozen=True)
class Check:
    key: str
    name: str
    value: float
    limit: float
    passed: bool
    unit: str
    comparison: str


def _check(key: str, name: str, value: float | None, limit: float, unit: str = "", at_least: bool = False) -> Check:
    value = float("nan") if value is None else float(value)
    return Check(key, name, value, limit, value >= limit if at_least else value <= limit, unit, ">=" if at_least else "<=")


def rmse(error: Column) -> Column:
    """Aggregate: the root of the mean square."""
    return F.sqrt(F.avg(error * error))


def middle_and_tail(offset: str = "offset") -> tuple[Column, Column]:
    """Aggregates: the median and the 95th percentile of what is not null."""
    return F.median(offset), F.percentile(offset, 0.95)


def ground_figures(products: Products, scene: Scene) -> DataFrame:
    """Share of true ground found, and of raised returns taken for ground."""
    joined = products.points.select("point_id", "is_ground").join(scene.truth_points, "point_id")
    raised = (F.col("above") > 0.5) & (F.col("classification") == 1)
    label = F.col("is_ground").cast("double")
    return joined.agg(F.avg(F.when(F.col("true_ground"), label)).alias("recall"), F.coalesce(F.avg(F.when(raised, label)), F.lit(0.0)).alias("commission"))


def dem_figures(products: Products, scene: Scene) -> DataFrame:
    """Error of the bare earth everywhere, and under crowns of over 2 m."""
    error = F.col("dem") - F.col("true_dem")
    return products.cells.select("cell", "dem").join(scene.truth_cells, "cell").agg(rmse(error).alias("all"), F.coalesce(rmse(F.when(F.col("true_chm") > 2, error)), F.lit(0.0)).alias("under"))


def crown_error(products: Products, scene: Scene) -> DataFrame:
    """Median of how far the highest canopy around small trees and trees is from the true one, in a window of half a crown's radius."""
    grid = products.grid
    half = F.greatest(F.lit(1), F.floor(F.col("radius") * 0.5 / grid.res).cast("int"))
    at = scene.plants.where("kind IN ('Small tree', 'Tree')").select(grid.row("y").alias("r"), grid.col("x").alias("c"), half.alias("half"), F.monotonically_increasing_id().alias("plant"))
    steps = F.sequence(-F.col("half"), F.col("half"))
    window = at.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).select("plant", (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col"))
    both = products.cells.select("cell", "row", "col", "chm").join(scene.truth_cells.select("cell", "true_chm"), "cell")
    tops = window.join(both, ["row", "col"]).groupBy("plant").agg(F.abs(F.max("chm") - F.max("true_chm")).alias("error"))
    return tops.agg(F.median("error").alias("error"))


def area_errors(products: Products, scene: Scene) -> DataFrame:
    """Relative error of each woody class's area, and of all of them (name null)."""
    acre = products.grid.cell_area_m2 / SQUARE_METERS_PER_ACRE
    truth = scene.truth_cells.withColumn("code", classes.classify(products.classes, "true_chm")).groupBy("code").agg((F.count("*") * acre).alias("true_acres"))
    both = products.class_areas.where("woody").join(truth, "code", "left").fillna(0.0, ["true_acres"])
    error = F.try_divide(F.abs(F.sum("area_acres") - F.sum("true_acres")), F.sum("true_acres"))
    return both.rollup("name").agg(error.alias("error"))


def channel_offsets(products: Products, scene: Scene, search_m: float = 30.0) -> DataFrame:
    """For each column from 40 to 95 % of the width: distance of the nearest drainage cell to the true channel, null if none is near."""
    grid = products.grid
    first, last = int(0.40 * grid.width), int(0.95 * grid.width)
    spark = products.cells.sparkSession
    # The line has a fixed number of vertices, whatever the grid's size.
    line = [{"x": float(x + ORIGIN[0]), "y": float(y + ORIGIN[1])} for x, y in scene.terrain.line]
    middle = [(c, float(scene.terrain.channel_y((c + 0.5) * grid.res_m) + ORIGIN[1])) for c in range(first, last)]
    columns = spark.createDataFrame(middle, "col int, line_y double")
    away = F.abs(grid.center_y() - F.col("line_y"))
    near = products.cells.where("is_channel").join(columns, "col").where(away <= search_m)
    best = near.groupBy("col").agg(F.min_by("row", F.struct(away, "row")).alias("row"))
    placed = best.withColumn("x", grid.center_x()).withColumn("y", grid.center_y()).withColumn("line", F.from_json(F.lit(_json(line)), "array<struct<x:double,y:double>>"))
    return columns.join(placed.withColumn("offset", distance_to_line("line", "x", "y")).select("col", "offset"), "col", "left")


def _json(line: list[dict[str, float]]) -> str:
    import json

    return json.dumps(line)


def outlet_share(products: Products) -> DataFrame:
    """Share of all cells that drain through the largest outlet of the east edge."""
    grid = products.grid
    return products.cells.where(F.col("col") == grid.width - 1).agg((F.max("acc") / F.lit(float(grid.n_cells))).alias("share"))


def validate(products: Products, scene: Scene, tol: Tolerances = Tolerances()) -> list[Check]:
    """The checks, in a fixed order."""
    recall, commission = ground_figures(products, scene).first()
    whole, under = dem_figures(products, scene).first()
    crown = crown_error(products, scene).first()[0]
    areas = {r["name"]: r["error"] for r in area_errors(products, scene).collect()}
    middle, tail = middle_and_tail()
    offsets = channel_offsets(products, scene).agg(F.avg(F.col("offset").isNotNull().cast("double")).alias("n"), middle.alias("m"), tail.alias("p")).first()
    return [
        _check("ground_recall", "Ground returns found", recall, tol.ground_recall, at_least=True),
        _check("ground_commission", "Raised returns taken for ground", commission, tol.ground_commission),
        _check("dem_rmse", "Bare-earth RMSE", whole, tol.dem_rmse, "m"),
        _check("dem_rmse_under_crowns", "Bare-earth RMSE under crowns", under, tol.dem_rmse_under_crowns, "m"),
        _check("crown_top_error", "Median crown top error", crown, tol.crown_top_error, "m"),
        *(_check(f"area_error_{c.key}", f"{c.name} area error", areas.get(c.name), tol.area_error) for c in products.classes if c.woody),
        _check("woody_area_error", "Woody area error", areas.get(None), tol.woody_area_error),
        _check("channel_coverage", "Channel found", offsets["n"], tol.channel_coverage, at_least=True),
        _check("channel_offset_median", "Median channel offset", offsets["m"], tol.channel_offset_median, "m"),
        _check("channel_offset_p95", "95th percentile channel offset", offsets["p"], tol.channel_offset_p95, "m"),
        _check("outlet_share", "Area through the outlet", outlet_share(products).first()[0], tol.outlet_share, at_least=True),
    ]


def check_table(checks: list[Check], like: DataFrame) -> DataFrame:
    rows = [(c.key, c.name, c.value, c.limit, c.passed, c.unit, c.comparison) for c in checks]
    return like.sparkSession.createDataFrame(rows, "key string, name string, value double, limit double, passed boolean, unit string, comparison string")


def block_truth(fine: DataFrame, factor: int) -> DataFrame:
    """Truth at a product's resolution from a finer one."""
    return raster.block_max(fine, factor, "true_chm")
