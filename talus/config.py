"""TOML settings: known tables with known keys only; other top-level tables are passed over."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, is_dataclass
from pathlib import Path
from typing import Any, TypeVar

from .errors import ConfigError
from .model import CanopyParams, GroundParams, HillshadeParams, HydrologyParams, PipelineParams, VegetationParams

T = TypeVar("T")


@dataclass(frozen=True)
class RegionConfig:
    name: str
    land_status: str
    bbox_wgs84: tuple[float, float, float, float]
    notes: str = ""


@dataclass(frozen=True)
class Config:
    pipeline: PipelineParams
    region: RegionConfig | None = None


TABLES = {"ground": GroundParams, "canopy": CanopyParams, "hydrology": HydrologyParams, "vegetation": VegetationParams, "hillshade": HillshadeParams}


def _made(kind: type[T], values: Any, where: str) -> T:
    """An instance of a parameter class from a TOML table."""
    assert is_dataclass(kind)
    if not isinstance(values, dict):
        raise ConfigError(f"[{where}] is not a table")
    known = {f.name for f in fields(kind)}
    if extra := sorted(set(values) - known):
        raise ConfigError(f"[{where}] has unknown keys: {', '.join(extra)}")
    try:
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
    except TypeError as e:
        raise ConfigError(f"[{where}] {e}") from e


def parse_config(text: str) -> Config:
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"broken TOML: {e}") from e
    pipeline = dict(found.get("pipeline", {}))
    parts = {name: _made(kind, pipeline.pop(name), f"pipeline.{name}") for name, kind in TABLES.items() if name in pipeline}
    params = _made(PipelineParams, {**pipeline, **parts}, "pipeline")
    if not params.resolution_m > 0:
        raise ConfigError("resolution_m must be positive")
    region = _made(RegionConfig, found["region"], "region") if "region" in found else None
    if region:
        check_bbox(region.bbox_wgs84)
    return Config(params, region)


def check_bbox(bbox: tuple[float, ...]) -> None:
    if len(bbox) != 4 or not (bbox[0] < bbox[2] and bbox[1] < bbox[3]):
        raise ConfigError("a box needs west, south, east, north with west < east and south < north")


def load_config(path: str | Path) -> Config:
    try:
        return parse_config(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e}") from e


#: Settings of the packaged example region: open dunes, where steep faces are ground.
DEMO_REGION = """
[region]
name = "White Sands dune field"
land_status = "Public land in a national park of the United States"
bbox_wgs84 = [-106.2700, 32.8150, -106.2640, 32.8200]
notes = "An example; any box of longitude and latitude will do."
[pipeline.ground]
terrain_slope = 0.6
[pipeline.canopy]
max_height_m = 15.0
"""


def load_demo_region_config() -> Config:
    return parse_config(DEMO_REGION)
