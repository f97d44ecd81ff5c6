"""The catalogue of point tiles: search, coverage, choice and download."""

from __future__ import annotations

import json
import logging
import os
import re
import urllib.parse
import urllib.request
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DownloadError, InputDataError

log = logging.getLogger(__name__)

#: Where the public catalogue is and which hosts it may lead to.
SEARCH_URL = "https://tnmaccess.nationalmap.gov/api/v1/products"
DATASET = "Lidar Point Cloud (LPC)"
SEARCH_HOSTS, FILE_HOSTS = ("tnmaccess.nationalmap.gov",), ("usgs.gov", "prd-tnm.s3.amazonaws.com")
LATTICE, FULL = 11, 0.999

TILES = "title string, url string, size_bytes long, date string, west double, south double, east double, north double, project string, filename string, nth long"
ITEM = "struct<title:string,downloadURL:string,urls:struct<LAZ:string>,sizeInBytes:bigint,publicationDate:string,boundingBox:struct<minX:double,minY:double,maxX:double,maxY:double>>"

Opener = Callable[[str, float], Any]


def _open(url: str, timeout_s: float) -> Any:
    return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "talus"}), timeout=timeout_s)  # noqa: S310


def check_url(url: str, hosts: tuple[str, ...] = FILE_HOSTS) -> None:
    """Refuse what isn't https at one of the hosts or below it."""
    parts = urllib.parse.urlsplit(url)
    labels = (parts.hostname or "").split(".")
    if parts.scheme != "https" or not {".".join(labels[i:]) for i in range(len(labels))} & set(hosts):
        raise DownloadError(f"refused: {url} is not https at a known host")


def check_name(name: str, url: str) -> None:
    """Refuse what isn't the bare name of a point tile."""
    if not name.lower().endswith(".laz") or re.search(r"[\\/\0]", name):
        raise DownloadError(f"refused: {name!r} of {url} is not the name of a point tile")


def project_of(url: Column, title: Column) -> Column:
    """The path part after ``Projects``; else the title without its last word."""
    found = F.regexp_extract(url, "/Projects/([^/]+)/", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(title, " [^ ]*$", ""))


def parse_products(spark: SparkSession, payload: str) -> DataFrame:
    """Tiles of a catalogue answer: items with a box and a LAZ file."""
    answer = spark.createDataFrame([(payload,)], "payload string").select(F.from_json("payload", f"struct<items:array<{ITEM}>>").alias("a"))
    items = answer.select(F.posexplode("a.items").alias("nth", "i"))
    url = F.coalesce("i.downloadURL", "i.urls.LAZ")
    box = F.col("i.boundingBox")
    kept = items.withColumn("url", url).where(F.lower("url").endswith(".laz") & box["minX"].isNotNull() & box["minY"].isNotNull() & box["maxX"].isNotNull() & box["maxY"].isNotNull())
    title = F.coalesce("i.title", F.lit(""))
    return kept.select(
        title.alias("title"),
        "url",
        F.coalesce("i.sizeInBytes", F.lit(0)).cast("long").alias("size_bytes"),
        F.coalesce("i.publicationDate", F.lit("")).alias("date"),
        box["minX"].alias("west"),
        box["minY"].alias("south"),
        box["maxX"].alias("east"),
        box["maxY"].alias("north"),
        project_of(F.col("url"), title).alias("project"),
        F.element_at(F.split(F.parse_url("url", F.lit("PATH")), "/"), -1).alias("filename"),
        F.col("nth").cast("long").alias("nth"),
    )


def search_tiles(spark: SparkSession, bbox: tuple[float, float, float, float], timeout_s: float = 60, max_items: int = 200, opener: Opener = _open) -> DataFrame:
    """Tiles that the catalogue has for a box, one page."""
    query = urllib.parse.urlencode({"datasets": DATASET, "bbox": ",".join(map(str, bbox)), "max": max_items, "outputFormat": "JSON"})
    url = f"{SEARCH_URL}?{query}"
    check_url(url, SEARCH_HOSTS)
    try:
        with opener(url, timeout_s) as answer:
            check_url(answer.geturl(), SEARCH_HOSTS)
            payload = answer.read().decode()
    except OSError as e:
        raise DownloadError(f"the catalogue can't be reached: {e}") from e
    try:
        json.loads(payload)
    except ValueError as e:
        raise DownloadError("the catalogue's answer isn't JSON") from e
    return parse_products(spark, payload)


def intersects(bbox: tuple[float, float, float, float]) -> Column:
    """Boxes that meet or touch ``bbox``."""
    west, south, east, north = bbox
    return (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)


def lattice(spark: SparkSession, bbox: tuple[float, float, float, float], n: int = LATTICE) -> DataFrame:
    """n x n places over a box, its edges included: place, lon, lat."""
    west, south, east, north = bbox
    step = F.lit(float(n - 1))
    i, j = F.col("place") % n, F.floor(F.col("place") / n)
    return spark.range(n * n).withColumnRenamed("id", "place").select("place", (F.lit(west) + i / step * F.lit(east - west)).alias("lon"), (F.lit(south) + j / step * F.lit(north - south)).alias("lat"))


def coverage(tiles: DataFrame, bbox: tuple[float, float, float, float], by: list[str] | None = None) -> DataFrame:
    """Share of the lattice's places that tiles cover, edges included, for each of the groups ``by``."""
    places = lattice(tiles.sparkSession, bbox)
    near = tiles.where(intersects(bbox))
    # 121 places: the one side is of fixed size.
    met = near.join(F.broadcast(places), (F.col("lon") >= F.col("west")) & (F.col("lon") <= F.col("east")) & (F.col("lat") >= F.col("south")) & (F.col("lat") <= F.col("north")))
    return met.groupBy(*(by or [])).agg((F.count_distinct("place") / F.lit(float(LATTICE**2))).alias("share"))


def select_tiles(tiles: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """The tiles of the best project for a box, by file name, with its ``share``.

    Full cover first, else the larger share; then the newest tile, then the fewer
    bytes, then the project seen first.
    """
    near = tiles.where(intersects(bbox))
    totals = near.groupBy("project").agg(F.max("date").alias("newest"), F.sum("size_bytes").alias("total_bytes"), F.min("nth").alias("seen"))
    ranked = totals.join(coverage(near, bbox, ["project"]), "project", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    ranked = ranked.withColumn("key", F.when(F.col("share") >= FULL, F.lit(1.0)).otherwise(F.col("share")))
    best = ranked.orderBy(F.desc("key"), F.desc("newest"), "total_bytes", "seen").limit(1)
    return near.join(F.broadcast(best.select("project", "share")), "project").orderBy("filename")


def chosen(tiles: DataFrame, bbox: tuple[float, float, float, float]) -> list[dict[str, Any]]:
    """``select_tiles`` as rows; a warning where cover is partial, an error where there is none."""
    rows = [r.asDict() for r in select_tiles(tiles, bbox).collect()]
    if not rows:
        raise InputDataError("no point tile meets the box")
    if rows[0]["share"] < FULL:
        log.warning("tiles cover %.0f %% of the box", 100 * rows[0]["share"])
    return rows


def totals_by_project(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("project").agg(F.max("date").alias("newest"), F.sum("size_bytes").alias("total_bytes"), F.count("*").alias("tiles"))


def download_tiles(tiles: list[dict[str, Any]], dest: str | Path, timeout_s: float = 600, opener: Opener = _open) -> list[Path]:
    """Fetch tiles (url, filename, size_bytes) into a folder; those there in full, known size are kept."""
    folder = Path(dest)
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for tile in tiles:
        check_url(tile["url"])
        check_name(tile["filename"], tile["url"])
        target = folder / tile["filename"]
        out.append(target)
        if tile["size_bytes"] and target.exists() and target.stat().st_size == tile["size_bytes"]:
            continue
        part = target.with_name(target.name + ".part")
        try:
            with opener(tile["url"], timeout_s) as answer, part.open("wb") as f:
                check_url(answer.geturl())
                while chunk := answer.read(1 << 20):
                    f.write(chunk)
        except OSError as e:
            part.unlink(missing_ok=True)
            raise DownloadError(f"can't fetch {tile['url']}: {e}") from e
        except DownloadError:
            part.unlink(missing_ok=True)
            raise
        os.replace(part, target)
    return out
