"""Polygon zones over cells and their summaries."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputDataError
from ..functions.crs import epsg, project_xy
from ..functions.geometry import contains
from ..model import SQUARE_METERS_PER_ACRE, Grid, VegClass

Ring = list[tuple[float, float]]


@dataclass(frozen=True)
class Zone:
    """A zone's polygons, each a list of closed rings in the grid's coordinates."""

    zone_id: int
    name: str
    polygons: tuple[tuple[tuple[tuple[float, float], ...], ...], ...]


def zones_from_geojson(collection: dict[str, Any], grid: Grid, name_field: str = "name") -> list[Zone]:
    """The polygons of a feature collection, converted to the grid's system; ids number the kept features.

    Coordinates are longitude and latitude unless the collection has the old
    ``crs`` member.  Other geometries are passed over; none left is an error.
    """
    if not grid.crs:
        raise InputDataError("zones need a grid whose coordinate system is known")
    named = str(((collection.get("crs") or {}).get("properties") or {}).get("name") or "EPSG:4326")
    source = 4326 if re.search(r"CRS:?84\b", named) else epsg(re.sub(r"^urn:ogc:def:crs:([A-Za-z]+):[^:]*:", r"\1:", named.strip(), flags=re.IGNORECASE))
    if source is None:
        raise InputDataError(f"the zones' coordinate system {named!r} can't be read")
    geographic = source in (4326, 4979)

    def place(xy: list[float]) -> tuple[float, float]:
        if geographic:
            return project_xy(xy[0], xy[1], grid.crs or "")
        if source != epsg(grid.crs):
            raise InputDataError(f"zones are in EPSG:{source}, the grid in {grid.crs}")
        return float(xy[0]), float(xy[1])

    found: list[Zone] = []
    for feature in collection.get("features") or []:
        geometry = feature.get("geometry") or {}
        if geometry.get("type") not in ("Polygon", "MultiPolygon"):
            continue
        many = geometry["coordinates"] if geometry["type"] == "MultiPolygon" else [geometry["coordinates"]]
        rings = tuple(tuple(tuple(place(xy) for xy in ring) for ring in polygon) for polygon in many)
        number = len(found) + 1
        found.append(Zone(number, str((feature.get("properties") or {}).get(name_field) or "").strip() or f"Zone {number}", rings))
    if not found:
        raise InputDataError("no polygon is among the features")
    return found


def read_feature_collection(path: str) -> dict[str, Any]:
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except OSError as e:
        raise InputDataError(f"can't read {path}: {e}") from e
    except ValueError as e:
        raise InputDataError(f"{path} isn't JSON: {e}") from e
    if not isinstance(found, dict) or found.get("type") != "FeatureCollection":
        raise InputDataError(f"{path} isn't a feature collection")
    return found


def read_zones(path: str, grid: Grid, name_field: str = "name") -> list[Zone]:
    return zones_from_geojson(read_feature_collection(path), grid, name_field)


def zone_table(spark: SparkSession, zones: list[Zone]) -> DataFrame:
    """zone_id, name, polygons and their bounds."""
    rows = []
    for z in zones:
        xs, ys = zip(*(p for polygon in z.polygons for ring in polygon for p in ring), strict=True)
        rows.append((z.zone_id, z.name, [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in z.polygons], min(xs), min(ys), max(xs), max(ys)))
    return spark.createDataFrame(rows, "zone_id int, name string, polygons array<array<array<struct<x:double,y:double>>>>, west double, south double, east double, north double")


def rasterize_zones(cells: DataFrame, zones: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``zone_id`` of the zone that a cell's center is in, the later one where zones overlap; null outside.

    zones: zone_id, polygons, west, south, east, north.  A zone is dealt to the
    blocks of cells that its box meets, so that the join is on the block.
    """
    side = 64
    blocked = cells.withColumn("_x", grid.center_x()).withColumn("_y", grid.center_y()).withColumn("_br", F.floor(F.col("row") / side)).withColumn("_bc", F.floor(F.col("col") / side))
    rows, cols = (grid.height - 1) // side, (grid.width - 1) // side

    def block(value: F.Column, most: int) -> F.Column:
        return F.least(F.greatest(F.floor(value / side), F.lit(0)), F.lit(most))

    spread = zones.withColumn("_br", F.explode(F.sequence(block(grid.row(F.col("north")), rows), block(grid.row(F.col("south")), rows)))).withColumn(
        "_bc", F.explode(F.sequence(block(grid.col(F.col("west")), cols), block(grid.col(F.col("east")), cols)))
    )
    near = blocked.select("cell", "_x", "_y", "_br", "_bc").join(spread, ["_br", "_bc"]).where("_x >= west AND _x <= east AND _y >= south AND _y <= north")
    inside = near.where(contains("polygons", "_x", "_y")).groupBy("cell").agg(F.max("zone_id").alias("zone_id"))
    return cells.join(inside, "cell", "left")


def summarize_zones(cells: DataFrame, zones: DataFrame, classes: tuple[VegClass, ...], grid: Grid) -> DataFrame:
    """A row for each zone, also for those without cells.

    cells: zone_id, code, slope.  Acres count all cells of a zone, class areas
    those with data; the slope of an empty zone is null.
    """
    acre = F.lit(grid.cell_area_m2 / SQUARE_METERS_PER_ACRE)
    counts = [F.count_if(F.col("code") == c.code).alias(f"n_{c.code}") for c in classes]
    found = cells.where("zone_id IS NOT NULL").groupBy("zone_id").agg(F.count("*").alias("cells"), F.avg("slope").alias("mean_slope_deg"), *counts)
    rows = zones.select("zone_id", "name").join(found, "zone_id", "left").fillna(0, ["cells", *(f"n_{c.code}" for c in classes)])

    def acres(of: list[VegClass]) -> F.Column:
        return sum((F.col(f"n_{c.code}") for c in of), F.lit(0)) * acre

    return rows.select(
        "zone_id",
        "name",
        "cells",
        (F.col("cells") * acre).alias("total_acres"),
        acres([c for c in classes if c.woody]).alias("woody_acres"),
        acres([c for c in classes if c.treatment]).alias("treatment_acres"),
        "mean_slope_deg",
        *((F.col(f"n_{c.code}") * acre).alias(f"{c.key}_acres") for c in classes),
    )


def zone_totals(cells: DataFrame) -> DataFrame:
    """Cells by zone with a grand total (zone_id null)."""
    return cells.where("zone_id IS NOT NULL").rollup("zone_id").agg(F.count("*").alias("cells"))


def label_places(cells: DataFrame) -> DataFrame:
    """Mean row and column of each zone's cells, to put its label at."""
    return cells.where("zone_id IS NOT NULL").groupBy("zone_id").agg(F.avg("row").alias("row"), F.avg("col").alias("col"))
