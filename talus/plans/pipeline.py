"""The product pipeline: points to ground, canopy, water, classes, zones and statistics."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputDataError
from ..lineage import cut
from ..model import SQUARE_METERS_PER_ACRE, Grid, PipelineParams, PointCloud, VegClass, build_classes, noise_mask
from ..operators import canopy, classes, ground, hydrology, raster, terrain, zones


@dataclass(frozen=True)
class Products:
    """All layers in one table of cells, and the small tables made of them."""

    grid: Grid
    params: PipelineParams
    classes: tuple[VegClass, ...]
    points: DataFrame  # with is_ground
    cells: DataFrame  # cell, row, col, dem, dsm, chm, slope, aspect, hillshade, filled, ..., code, zone_id
    reaches: DataFrame
    class_areas: DataFrame
    zones: list[zones.Zone]
    zone_summary: DataFrame | None
    stats: DataFrame
    ground_method: str
    void_fraction: float


def grid_for(cloud: PointCloud, resolution_m: float) -> Grid:
    """The grid of a cloud's extent, or of its bounds where it has none."""
    west, south, east, north = cloud.extent or cloud.bounds()
    return Grid.from_bounds(west, south, east, north, resolution_m / cloud.meters_per_unit, cloud.crs, cloud.meters_per_unit)


def site_stats(points: DataFrame, cells: DataFrame, reaches: DataFrame, areas: DataFrame, grid: Grid, params: PipelineParams, method: str, void_fraction: float) -> DataFrame:
    """One row of scalars: an aggregate of points, one of cells, and two of small tables."""
    acre = F.lit(grid.cell_area_m2 / SQUARE_METERS_PER_ACRE)
    of_points = points.agg(F.count("*").alias("points_total"), F.count_if(noise_mask()).alias("points_noise"), F.count_if("is_ground").alias("points_ground"))
    sink = F.col("sink_depth") > params.hydrology.sink_report_depth_m
    of_cells = cells.agg(
        F.min("dem").alias("elevation_min_m"),
        F.max("dem").alias("elevation_max_m"),
        (F.max("dem") - F.min("dem")).alias("relief_m"),
        F.avg("slope").alias("slope_mean_deg"),
        terrain.slope_shares().alias("slope_share_percent"),
        F.max("chm").alias("canopy_max_m"),
        F.max("stream_order").cast("int").alias("max_strahler_order"),
        (F.max("acc") * F.lit(grid.cell_area_m2 / 10_000)).alias("largest_contributing_area_ha"),
        (F.count_if(sink) * acre).alias("sink_acres"),
        F.max("sink_depth").alias("max_sink_depth_m"),
    )
    of_reaches = reaches.agg(F.coalesce(F.sum("length_m"), F.lit(0.0)).alias("channel_length_m"), F.count("*").alias("channel_reaches"))
    of_classes = areas.agg(
        classes.role_acres("woody").alias("woody_acres"),
        F.coalesce(F.sum(F.when(F.col("woody"), F.col("percent"))), F.lit(0.0)).alias("woody_percent"),
        F.array_sort(F.collect_list(F.when(F.col("treatment"), F.struct("code", "name")))).alias("_treatment"),
        classes.role_acres("treatment").alias("treatment_acres"),
    )
    joined = of_points.withColumn("_k", F.lit(1))
    for other in (of_cells, of_reaches, of_classes):
        joined = joined.join(other.withColumn("_k", F.lit(1)), "_k")
    area = grid.n_cells * grid.cell_area_m2
    return joined.withColumn("treatment_classes", F.transform("_treatment", lambda c: c["name"])).drop("_k", "_treatment").select(
        "*",
        F.lit(method).alias("ground_method"),
        ((F.col("points_total") - F.col("points_noise")) / F.lit(area)).alias("point_density_per_m2"),
        (F.col("points_ground") / F.lit(area)).alias("ground_density_per_m2"),
        F.lit(100.0 * void_fraction).alias("dem_interpolated_percent"),
        F.lit(area / SQUARE_METERS_PER_ACRE).alias("area_acres"),
        F.lit(area / 10_000.0).alias("area_hectares"),
        F.lit(grid.res_m).alias("resolution_m"),
        F.lit(params.hydrology.channel_threshold_ha).alias("channel_threshold_ha"),
    )


def run_pipeline(cloud: PointCloud, params: PipelineParams = PipelineParams(), zone_collection: dict[str, Any] | None = None, grid: Grid | None = None) -> Products:
    """All products of a cloud.

    The ground comes first, since everything else stands on it; slope, canopy and
    water then share one table, which is cut from its lineage after each stage
    that several others read.
    """
    if not cloud.crs:
        raise InputDataError("the points have no coordinate system")
    if cloud.points.where(~noise_mask()).isEmpty():
        raise InputDataError("no point is left without noise")
    grid = grid or grid_for(cloud, params.resolution_m)
    labeled, method = ground.classify_ground(cloud, params.ground, params.resolution_m)
    points = cut(labeled)
    bare, void_fraction = ground.bare_earth_model(points, grid)
    dem = cut(bare)
    found = build_classes(params.vegetation)
    tops = canopy.canopy_height_model(canopy.surface_model(points, dem, grid), params.canopy)
    slopes = terrain.with_gradient(tops, grid.res_m, "dem")
    slopes = slopes.withColumns({"slope": terrain.slope_degrees(), "aspect": terrain.aspect_degrees(), "hillshade": terrain.hillshade(params.hillshade), "code": classes.classify(found)})
    wet, reaches = hydrology.route_water(dem, grid, params.hydrology)
    cells = cut(slopes).join(wet.drop("row", "col", "dem"), "cell")
    listed = zones.zones_from_geojson(zone_collection, grid) if zone_collection else []
    summary = None
    if listed:
        table = zones.zone_table(dem.sparkSession, listed)
        cells = cut(zones.rasterize_zones(cells, table, grid))
        summary = zones.summarize_zones(cells, table, found, grid)
    else:
        cells = cut(cells.withColumn("zone_id", F.lit(None).cast("int")))
    reaches = cut(reaches)
    areas = classes.class_areas(cells, found, grid.cell_area_m2)
    stats = site_stats(points, cells, reaches, areas, grid, params, method, void_fraction)
    return Products(grid, params, found, points, cells, reaches, areas, listed, summary, stats, method, void_fraction)


def raster_layers(products: Products) -> dict[str, tuple[F.Column, str, float | None]]:
    """Exported layers: the column, its type and its value for no data.  Fixed by what readers of the files expect."""
    layers: dict[str, tuple[F.Column, str, float | None]] = {name: (F.col(c).cast("float"), "float32", -9999.0) for name, c in (("dem", "dem"), ("dsm", "dsm"), ("chm", "chm"), ("slope", "slope"), ("aspect", "aspect"), ("sink_depth", "sink_depth"))}
    layers["hillshade"] = ((F.bround(F.col("hillshade") * 254) + 1).cast("smallint"), "uint8", 0.0)
    layers["flow_direction"] = (F.col("direction"), "uint8", 255.0)
    layers["flow_accumulation"] = (F.col("acc").cast("float"), "float32", -9999.0)
    layers["stream_order"] = (F.least(F.col("stream_order"), F.lit(255)).cast("smallint"), "uint8", 0.0)
    layers["veg_class"] = (F.col("code"), "uint8", 0.0)
    if products.zones:
        if max(z.zone_id for z in products.zones) > 32767:
            raise InputDataError("too many zones for a 16-bit raster")
        layers["zones"] = (F.coalesce("zone_id", F.lit(0)).cast("smallint"), "int16", 0.0)
    return layers


def write_cells(products: Products, path: str, tile: int = 512) -> None:
    """The layers as Parquet, partitioned by tile: the form that scales."""
    columns = [c.alias(name) for name, (c, _, _) in raster_layers(products).items()]
    side = F.lit(tile)
    named = products.cells.select("row", "col", *columns, F.floor(F.col("row") / side).alias("tile_row"), F.floor(F.col("col") / side).alias("tile_col"))
    named.repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(path)
