"""Whole runs: the self-checking demonstration, and real tiles."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import SparkSession

from ..config import Config
from ..model import HydrologyParams, PipelineParams
from ..operators.zones import read_feature_collection
from ..sinks import kmz, maps, report, vectors
from ..sources.las import read_las
from ..sources.synth import SceneParams, make_scene
from ..sources.tiff import write_raster
from .pipeline import Products, raster_layers, run_pipeline, write_cells
from .validation import Check, Tolerances, validate

CHANNEL_SHARE = 0.03


@dataclass(frozen=True)
class DemoResult:
    products: Products
    checks: list[Check]
    out: Path

    @property
    def passed(self) -> bool:
        return all(c.passed for c in self.checks)


def write_outputs(products: Products, out: str | Path, meta: report.RunMetadata, checks: list[Check] | None = None, rasters: bool = True) -> Path:
    """Cells and reaches as Parquet, and for one site's reader GeoTIFF, GeoJSON, maps, KMZ and reports."""
    folder = Path(out)
    for name in ("vectors", "rasters"):
        (folder / name).mkdir(parents=True, exist_ok=True)
    write_cells(products, str(folder / "cells"))
    vectors.drainage_table(products.reaches, products.grid).write.mode("overwrite").parquet(str(folder / "reaches"))
    drainage = vectors.drainage_features(products.reaches, products.grid)
    vectors.write_geojson(folder / "vectors/drainage_lines.geojson", drainage)
    zones = vectors.zone_features(products.zones, products.zone_summary, products.classes, products.grid) if products.zone_summary is not None else []
    if zones:
        vectors.write_geojson(folder / "vectors/zones_summary.geojson", zones)
    if rasters:
        for name, (column, dtype, nodata) in raster_layers(products).items():
            write_raster(products.cells, column, products.grid, folder / f"rasters/{name}.tif", dtype, nodata, name)
    maps.write_maps(folder / "maps", products, meta.title, meta.source)
    kmz.write_kmz(folder / "site.kmz", products, meta.title, meta.source, drainage, zones)
    summary = report.build_summary(products, meta, drainage, checks)
    report.write_summary_json(folder / "summary.json", summary)
    report.write_markdown(folder / "report.md", summary)
    report.write_html(folder / "report.html", summary)
    return folder


def run_demo(spark: SparkSession, out: str | Path, seed: int = 7, size_m: float = 400.0, params: PipelineParams = PipelineParams(), tol: Tolerances = Tolerances(), rasters: bool = True) -> DemoResult:
    """A synthetic scene through the pipeline, held against its truth; zones go by way of their file."""
    folder = Path(out)
    (folder / "vectors").mkdir(parents=True, exist_ok=True)
    scene = make_scene(spark, seed, SceneParams(size_m=size_m, resolution_m=params.resolution_m))
    path = folder / "vectors/zones_input.geojson"
    vectors.write_geojson(path, scene.zones["features"])
    hydrology = HydrologyParams(CHANNEL_SHARE * size_m**2 / 10_000, params.hydrology.sink_report_depth_m)
    products = run_pipeline(scene.cloud, replace(params, hydrology=hydrology), read_feature_collection(str(path)), scene.grid)
    checks = validate(products, scene, tol)
    write_outputs(products, folder, report.RunMetadata("Synthetic site", f"seed {seed}, {size_m:g} m"), checks, rasters)
    return DemoResult(products, checks, folder)


def run_on_tiles(spark: SparkSession, tiles: list[str], out: str | Path, config: Config, zones: str | None = None, crs: str | None = None, z_units: str = "auto", ground_method: str | None = None, crop: bool = True, rasters: bool = True) -> Products:
    """Point tiles through the pipeline, cropped to the settings' region."""
    params = config.pipeline if ground_method is None else replace(config.pipeline, ground=replace(config.pipeline.ground, method=ground_method))
    region = config.region if crop else None
    cloud = read_las(spark, tiles, region.bbox_wgs84 if region else None, crs, z_units)
    products = run_pipeline(cloud, params, read_feature_collection(zones) if zones else None)
    meta = report.RunMetadata(region.name if region else "Site", f"{len(tiles)} tiles", region.land_status if region else "", region.notes if region else "")
    write_outputs(products, out, meta, rasters=rasters)
    return products
