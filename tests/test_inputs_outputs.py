"""Files there and back, the catalogue, and whole runs on small scenes."""

import io
import json
import struct
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.cli import build_parser, main, slug
from talus.errors import DownloadError, InputDataError, MissingDependencyError
from talus.model import Grid, PointCloud
from talus.operators import raster
from talus.plans.workflows import run_demo
from talus.sinks import maps
from talus.sources import catalog, las, tiff
from talus.sources.synth import SceneParams, make_scene
from talus.streaming.cells import start

BOX = (-100.00, 35.00, -99.99, 35.01)


def item(title, date, west, east, name="a.laz", size=10, project="P"):
    return {"title": title, "downloadURL": f"https://rockyweb.usgs.gov/x/Projects/{project}/LAZ/{name}", "sizeInBytes": size, "publicationDate": date, "boundingBox": {"minX": west, "minY": 34.9, "maxX": east, "maxY": 35.1}}


ITEMS = [item("old b", "2015-01-01", -100.1, -99.9, "b.laz", project="Old"), item("new a", "2024-01-01", -100.1, -99.995, "n.LAZ", project="New"), item("x y", "2020-01-01", -100.1, -99.9, "x.zip", project="Zip"), item("far", "2025-01-01", 10, 11, "f.laz", project="Far")]


class Answer(io.BytesIO):
    def __init__(self, data, url):
        super().__init__(data)
        self.url = url

    def geturl(self):
        return self.url


def test_tiles_are_parsed_chosen_and_fetched(spark, tmp_path):
    tiles = catalog.search_tiles(spark, BOX, opener=lambda url, t: Answer(json.dumps({"items": ITEMS}).encode(), url))
    assert [(r["project"], r["filename"]) for r in tiles.orderBy("nth").collect()] == [("Old", "b.laz"), ("New", "n.LAZ"), ("Far", "f.laz")]
    best = catalog.chosen(tiles, BOX)
    assert [(t["filename"], t["share"]) for t in best] == [("b.laz", 1.0)]
    assert [t["project"] for t in catalog.chosen(tiles.where("project != 'Old'"), BOX)] == ["New"]
    with pytest.raises(InputDataError):
        catalog.chosen(tiles.where("project = 'Far'"), BOX)
    done = catalog.download_tiles(best, tmp_path, opener=lambda url, t: Answer(b"0123456789", url))
    assert done[0].read_bytes() == b"0123456789"
    catalog.download_tiles(best, tmp_path, opener=lambda url, t: pytest.fail("it is there already"))
    done[0].unlink()
    with pytest.raises(DownloadError):
        catalog.download_tiles(best, tmp_path, opener=lambda url, t: Answer(b"", "https://elsewhere.example/x"))
    assert not list(tmp_path.iterdir())
    fetched = []

    def opener(url, t):
        fetched.append(url)
        return Answer(b"01", url)

    (tmp_path / "u.laz").write_bytes(b"part")  # of a tile of unknown size: fetched again
    unknown = {"url": "https://data.usgs.gov/a/u.laz", "filename": "u.laz", "size_bytes": 0}
    assert catalog.download_tiles([unknown], tmp_path, opener=opener)[0].read_bytes() == b"01" and len(fetched) == 1
    for url, name in (("https://usgs.gov.example.com/a.laz", "a.laz"), ("http://data.usgs.gov/a.laz", "a.laz"), ("https://badusgs.gov/a.laz", "a.laz"), ("https://data.usgs.gov/a.exe", "a.exe"), ("https://data.usgs.gov/x", "../a.laz"), ("https://data.usgs.gov/x", "..\\a.laz")):
        with pytest.raises(DownloadError):
            catalog.download_tiles([{"url": url, "filename": name, "size_bytes": 1}], tmp_path, opener=opener)
    assert len(fetched) == 1
    with pytest.raises(DownloadError):  # the catalogue may not lead to where files are
        catalog.search_tiles(spark, BOX, opener=lambda url, t: Answer(b"{}", "https://data.usgs.gov/x"))
    untitled = spark.createDataFrame([("https://h/x.laz", "Some Site 12")], "u string, t string")
    assert untitled.select(catalog.project_of(F.col("u"), F.col("t"))).first()[0] == "Some Site"


def lzw(data):
    """TIFF's LZW, the plain way: a clear code, then codes of growing width, one early."""
    bits, out, width = "", [], 9
    table = {bytes([i]): i for i in range(256)}
    n, word = 258, b""
    bits += f"{256:09b}"
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        bits += f"{table[word]:0{width}b}"
        table[longer] = n
        n += 1
        if n == 4095:
            bits += f"{256:012b}"
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif n == 1 << width:
            width += 1
        word = bytes([byte])
    if word:
        bits += f"{table[word]:0{width}b}"
        width += n + 1 == 1 << width < 4096
    bits += f"{257:0{width}b}"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_scale_bars_have_round_lengths():
    assert [maps.nice_length(x) for x in (100, 400, 1000, 37, 2600, 0.4)] == [20, 100, 200, 5, 500, pytest.approx(0.1)]


def test_rasters_are_brought_to_a_bounded_size(spark):
    g = Grid(0.0, 7.0, 1.0, 10, 7)
    cells = tiff.from_array(spark, np.arange(70.0).reshape(7, 10), g)
    found, coarse = raster.reduced(cells, g, 4, v=F.max("v"))
    assert (coarse.shape, coarse.res, coarse.bounds) == ((3, 4), 3.0, (0.0, -2.0, 12.0, 7.0))
    assert tiff.to_array(found, coarse, "v").tolist() == [[22, 25, 28, 29], [52, 55, 58, 59], [62, 65, 68, 69]]
    assert raster.reduced(cells, g, 10, v=F.max("v"))[1] == g


def test_lzw_is_unpacked():
    rng = np.random.default_rng(3)
    for data in (b"", b"a", b"ab" * 500, bytes(rng.integers(0, 256, 20_000, dtype=np.uint8)), bytes(rng.integers(0, 3, 60_000, dtype=np.uint8))):
        assert tiff.unlzw(lzw(data)) == data


def tiled(path, data, side, predictor):
    """A GeoTIFF as other programs write it: LZW in tiles."""
    height, width = data.shape
    down, across = -(-height // side), -(-width // side)
    whole = np.zeros((down * side, across * side), data.dtype)
    whole[:height, :width] = data
    parts = []
    for r in range(down):
        for c in range(across):
            part = whole[r * side : (r + 1) * side, c * side : (c + 1) * side]
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((side, 1), data.dtype))
            parts.append(lzw(part.astype(data.dtype).tobytes()))
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [data.dtype.itemsize * 8]), (259, 3, [5]), (277, 3, [1]), (317, 3, [predictor]), (322, 3, [side]), (323, 3, [side]), (324, 4, None), (325, 4, [len(p) for p in parts]), (339, 3, [3 if data.dtype.kind == "f" else 1]), (33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 200.0, 0.0])]
    at = 8 + np.cumsum([0] + [len(p) for p in parts])
    tags[8] = (324, 4, at[:-1].tolist())
    start, extra, entries = int(at[-1]), b"", b""
    for tag, kind, values in tags:
        packed = struct.pack(f"<{len(values)}{ {3: 'H', 4: 'L', 12: 'd'}[kind]}", *values)
        entries += struct.pack("<HHL", tag, kind, len(values))
        entries += packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<L", start + 6 + 12 * len(tags) + len(extra))
        extra += packed if len(packed) > 4 else b""
    path.write_bytes(struct.pack("<2sHL", b"II", 42, start) + b"".join(parts) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra)


def test_tiles_packed_by_lzw_are_read(tmp_path):
    rng = np.random.default_rng(4)
    for data, predictor in ((rng.normal(size=(37, 50)).astype("<f4"), 1), (rng.integers(0, 255, (37, 50)).astype("u1"), 2)):
        tiled(tmp_path / "a.tif", data, 16, predictor)
        found, grid = tiff.read_geotiff(tmp_path / "a.tif")
        assert (found == data).all() and (grid.x0, grid.y1, grid.res, grid.shape) == (100.0, 200.0, 2.0, data.shape)


def test_large_rasters_are_written_by_their_tasks(spark, tmp_path):
    data = np.random.default_rng(5).normal(size=(30, 45)).round(3)
    data[3, 4] = np.nan
    g = Grid(1000.0, 2030.0, 1.0, 45, 30, "EPSG:32631")
    cells = tiff.from_array(spark, data, g)
    tiff.write_raster(cells, F.col("v"), g, tmp_path / "one.tif", "float64", -9999.0)
    tiff.write_raster(cells, F.col("v"), g, tmp_path / "many.tif", "float64", -9999.0, one_file=100, tile=16)
    whole, grid = tiff.read_geotiff(tmp_path / "one.tif")
    assert np.array_equal(whole, data, equal_nan=True) and grid.bounds == g.bounds
    parts = sorted((tmp_path / "many").iterdir())
    assert len(parts) == 6
    again = np.full(g.shape, np.nan)
    for part in parts:
        values, at = tiff.read_geotiff(part)
        r, c = int(g.y1 - at.y1), int(at.x0 - g.x0)
        again[r : r + at.height, c : c + at.width] = values
    assert np.array_equal(again, data, equal_nan=True)


def test_las_there_and_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(*map(float, p), int(c)) for p, c in zip(rng.uniform((166_600, 1000, 300), (166_650, 1050, 305), (400, 3)).round(3), rng.choice([1, 2, 7], 400), strict=True)]
    points = spark.createDataFrame(rows, "x double, y double, z double, classification int")
    path = tmp_path / "t.las"
    las.write_las(PointCloud(points, "EPSG:32631"), path)
    cloud = las.read_las(spark, [str(tmp_path)], chunk_size=150)
    got = sorted((round(r.x, 3), round(r.y, 3), round(r.z, 3), r.classification) for r in cloud.points.collect())
    assert got == sorted(rows) and cloud.crs == "EPSG:32631" and cloud.points.rdd.getNumPartitions() == 3
    raised = las.read_las(spark, [str(path)], z_units="ft").points.agg(F.max("z")).first()[0]
    assert raised == pytest.approx(max(r[2] for r in rows) * 0.3048)
    header = las.read_header(str(path))
    assert las.outside((0, 0, 1, 1), header) and not las.outside((header.maxs[0], 0, 1e9, 1e9), header)
    with pytest.raises(InputDataError):
        las.read_las(spark, [str(path)], bbox_wgs84=(10.0, 10.0, 10.1, 10.1))
    with pytest.raises(InputDataError):
        las.read_header(str(tmp_path / "none.las"))
    (tmp_path / "t.laz").write_bytes(path.read_bytes())
    with pytest.raises(MissingDependencyError):
        las.read_header(str(tmp_path / "t.laz"))


def test_geotiff_there_and_back(tmp_path):
    g = Grid(500_000.0, 1030.0, 0.5, 70, 130, "EPSG:32631", 0.3048)
    data = np.random.default_rng(2).normal(size=g.shape).astype(np.float32).astype(float)
    data[3, 4] = np.nan
    tiff.write_geotiff(tmp_path / "a.tif", data, g, "float32", -9999.0, "x")
    back, grid = tiff.read_geotiff(tmp_path / "a.tif")
    assert np.array_equal(back, data, equal_nan=True) and grid == g
    with pytest.raises(InputDataError):
        tiff.write_geotiff(tmp_path / "b.tif", data[1:], g)


def test_a_demonstration_passes_its_checks_and_writes_everything(spark, tmp_path):
    result = run_demo(spark, tmp_path, seed=5, size_m=100.0)
    assert result.passed, [c for c in result.checks if not c.passed]
    assert [c.key for c in result.checks] == "ground_recall ground_commission dem_rmse dem_rmse_under_crowns crown_top_error area_error_shrub area_error_small_tree area_error_tree woody_area_error channel_coverage channel_offset_median channel_offset_p95 outlet_share".split()
    summary = json.loads((tmp_path / "summary.json").read_text())
    assert sum(c["cells"] for c in summary["classes"]) == 10_000 and len(summary["zones"]) == 3
    assert sum(z["cells"] for z in summary["zones"]) == 10_000
    dem, _ = tiff.read_geotiff(tmp_path / "rasters/dem.tif")
    assert dem.shape == (100, 100) and not np.isnan(dem).any()
    assert spark.read.parquet(str(tmp_path / "cells")).count() == 10_000
    assert "doc.kml" in zipfile.ZipFile(tmp_path / "site.kmz").namelist()
    assert "Validation" in (tmp_path / "report.md").read_text() and "<table>" in (tmp_path / "report.html").read_text()
    lines = json.loads((tmp_path / "vectors/drainage_lines.geojson").read_text())["features"]
    assert lines and lines[0]["properties"]["reach_id"] == 1
    plates = {p.stem: ElementTree.parse(p).getroot() for p in (tmp_path / "maps").iterdir()}
    assert sorted(plates) == ["canopy", "hydrology", "overview", "slope", "terrain", "vegetation"]
    svg = "{http://www.w3.org/2000/svg}"
    for name, plate in plates.items():
        texts = [t.text for t in plate.iter(f"{svg}text")]
        assert len(list(plate.iter(f"{svg}image"))) == 1 and {"N", "20 m"} <= set(texts)
        assert len(list(plate.iter(f"{svg}polyline"))) == (len(lines) if name in ("hydrology", "overview", "terrain") else 0)
        assert len(list(plate.iter(f"{svg}polygon"))) == (3 if name in ("vegetation", "overview") else 0)
        if name == "slope":
            assert [t.split(":")[0] for t in texts if "degrees" in t] == ["0-5 degrees", "5-10 degrees", "10-20 degrees", ">20 degrees"]


def test_scenes_repeat(spark):
    one, two = (make_scene(spark, 4, SceneParams(size_m=60.0)).cloud.points.agg(F.count("*"), F.sum("z")).first() for _ in range(2))
    assert one == two


def test_command_line(spark, tmp_path, capsys):
    assert slug("Example hills!") == "example-hills"
    assert build_parser().parse_args(["demo", "--seed", "3"]).seed == 3
    with pytest.raises(SystemExit):
        build_parser().parse_args(["demo", "--seed", "-1"])
    with pytest.raises(SystemExit):
        build_parser().parse_args(["run"])
    assert main(["run", "--laz", str(tmp_path / "none.las")], spark) == 2
    (tmp_path / "c.toml").write_text("[pipeline]\nzoom = 1")
    assert main(["run", "--config", str(tmp_path / "c.toml"), "--laz", "x"], spark) == 2
    assert "unknown keys" in capsys.readouterr().err


def test_running_cells_follow_new_tiles(spark, tmp_path):
    g = Grid(0.0, 4.0, 1.0, 4, 4)
    for k, rows in enumerate(([(0.5, 3.5, 1.0, 2), (0.5, 3.5, 9.0, 7)], [(0.5, 3.5, 3.0, 1)])):
        spark.createDataFrame(rows, "x double, y double, z double, classification int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("x double, y double, z double, classification int").parquet(f"{tmp_path}/in/*")
        q = start(stream, g, "cells", f"{tmp_path}/state")
        q.awaitTermination()
    found = spark.table("cells").collect()
    assert [(r["cell"], r["n"], r["low"], r["high"], r["mean"]) for r in found] == [(0, 2, 1.0, 3.0, 2.0)]
