"""GeoJSON of drainage lines and zones, in longitude and latitude."""

from __future__ import annotations

import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crs import unproject, unproject_xy
from ..model import Grid, VegClass
from ..operators.hydrology import reach_line, simplify_staircase
from ..operators.zones import Zone

DECIMALS = 7


def drainage_table(reaches: DataFrame, grid: Grid) -> DataFrame:
    """reach_id, strahler_order, length_m, contributing_area_ha, line of (lon, lat): rounded and without staircase vertices."""
    kept = reaches.withColumn("xy", reach_line("cells", grid)).withColumn("xy", simplify_staircase("xy"))

    def place(p: F.Column) -> F.Column:
        lon, lat = unproject(p["x"], p["y"], grid.crs or "")
        return F.struct(F.bround(lon, DECIMALS).alias("lon"), F.bround(lat, DECIMALS).alias("lat"))

    return kept.select("reach_id", "strahler_order", F.bround("length_m", 1).alias("length_m"), F.bround("contributing_area_ha", 3).alias("contributing_area_ha"), F.transform("xy", place).alias("line"))


def drainage_features(reaches: DataFrame, grid: Grid) -> list[dict[str, Any]]:
    out = []
    for r in drainage_table(reaches, grid).orderBy("reach_id").collect():
        properties = {k: r[k] for k in ("reach_id", "strahler_order", "length_m", "contributing_area_ha")}
        out.append({"type": "Feature", "properties": properties, "geometry": {"type": "LineString", "coordinates": [[p["lon"], p["lat"]] for p in r["line"]]}})
    return out


def number(value: float | None, places: int | None = None) -> float | None:
    """A float that JSON can hold."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return None
    return round(value, places) if places is not None and isinstance(value, float) else value


def zone_features(zones: list[Zone], summary: DataFrame, classes: tuple[VegClass, ...], grid: Grid) -> list[dict[str, Any]]:
    rows = {r["zone_id"]: r for r in summary.collect()}
    names = ["zone_id", "name", "total_acres", "woody_acres", "treatment_acres", "mean_slope_deg", *(f"{c.key}_acres" for c in classes)]
    out = []
    for z in zones:
        rings = [[[[round(v, DECIMALS) for v in unproject_xy(x, y, grid.crs or "")] for x, y in ring] for ring in polygon] for polygon in z.polygons]
        geometry = {"type": "Polygon", "coordinates": rings[0]} if len(rings) == 1 else {"type": "MultiPolygon", "coordinates": rings}
        out.append({"type": "Feature", "properties": {n: number(rows[z.zone_id][n], 4) for n in names}, "geometry": geometry})
    return out


def write_geojson(path: str | Path, features: list[dict[str, Any]]) -> None:
    """A feature to a line."""
    lines = ",\n".join(json.dumps(f, ensure_ascii=False, separators=(",", ":"), allow_nan=False) for f in features)
    Path(path).write_text(f'{{"type":"FeatureCollection","features":[\n{lines}\n]}}\n', encoding="utf-8", newline="\n")
