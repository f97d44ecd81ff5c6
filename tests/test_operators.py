"""Operators against hand-computed answers and plain NumPy versions of them."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.config import load_demo_region_config, parse_config
from talus.errors import ConfigError, InputDataError
from talus.functions import crs
from talus.lineage import cut, numbered
from talus.model import Grid, GroundParams, HydrologyParams, PointCloud, VegetationParams, build_classes, noise_mask
from talus.operators import canopy, classes, fill, graph, ground, hydrology, raster, terrain, zones
from talus.sources.tiff import from_array, to_array

PLANE = Grid(500_000.0, 1030.0, 1.0, 20, 30, "EPSG:32631")


def grid_of(data, res=1.0):
    return Grid(0.0, data.shape[0] * res, res, data.shape[1], data.shape[0])


def layer(df, grid, name="v"):
    return to_array(df, grid, name)


def test_grid_snaps_outward_and_leaves_out_its_east_and_south_edges(spark):
    g = Grid.from_bounds(10.2, 20.7, 15.1, 23.0, 1.0)
    assert (g.x0, g.bounds[1], g.shape) == (10.0, 20.0, (3, 6))
    points = spark.createDataFrame([(500_000.0, 1030.0), (500_019.5, 1000.5), (500_020.0, 1010.0), (500_010.0, 1000.0)], "x double, y double")
    assert [r[0] for r in points.select(PLANE.flat_index()).collect()] == [0, 599, None, None]
    with pytest.raises(ConfigError):
        Grid.from_bounds(0, 0, 1, 1, 0)
    with pytest.raises(ConfigError):
        Grid.from_bounds(1, 0, 0, 1, 1)
    assert Grid(0, 10, 10, 10, 10, None, 0.3048).res_m == pytest.approx(3.048)


def test_cell_statistics(spark):
    points = spark.createDataFrame([(500_000.2, 1029.5, 3.0), (500_000.8, 1029.5, 5.0), (500_001.5, 1029.5, 7.0)], "x double, y double, z double")
    for stat, first, second, empty in (("min", 3, 7, None), ("max", 5, 7, None), ("mean", 4, 7, None), ("count", 2, 1, 0)):
        found = {r["cell"]: r["v"] for r in raster.cell_statistic(points, PLANE, stat).collect()}
        assert (found[0], found[1], found[2], len(found)) == (first, second, empty, 600)
    with pytest.raises(ConfigError):
        raster.cell_statistic(points, PLANE, "mode")


def test_neighbourhoods_and_opening_equal_numpy(spark):
    data = np.random.default_rng(1).normal(size=(11, 13))
    g = grid_of(data)
    found = raster.around(from_array(spark, data, g), "v").collect()
    padded = np.pad(data, 1, mode="edge")
    for r in found:
        want = padded[r["row"] : r["row"] + 3, r["col"] : r["col"] + 3].ravel()
        assert [r["nb"][k] for k in raster.AROUND] == want.tolist()
    opened = layer(raster.opening(from_array(spark, data, g), 3), g)

    def box(a, f):
        return np.array([[f(a[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]) for j in range(a.shape[1])] for i in range(a.shape[0])])

    assert (opened == box(box(data, np.min), np.max)).all()
    assert ground.window_sizes(1.0, 20.0) == [3, 5, 9, 17] and ground.window_sizes(30.0, 20.0) == [3]


def test_gradient_slope_aspect_and_hillshade_of_a_plane(spark):
    rows, cols = np.indices((9, 9))
    data = 100 + 0.1 * cols + 0.2 * (8 - rows)
    g = grid_of(data)
    found = terrain.with_gradient(from_array(spark, data, g, "dem"), 1.0).withColumns({"slope": terrain.slope_degrees(), "aspect": terrain.aspect_degrees(), "shade": terrain.hillshade()}).where("row = 4 AND col = 4").first()
    assert found["dz_dx"] == pytest.approx(0.1) and found["dz_dy"] == pytest.approx(0.2)
    assert found["slope"] == pytest.approx(math.degrees(math.atan(math.hypot(0.1, 0.2))))
    assert found["aspect"] == pytest.approx(math.degrees(math.atan2(-0.1, -0.2)) % 360)
    flat = terrain.with_gradient(from_array(spark, np.ones((5, 5)), grid_of(np.ones((5, 5))), "dem"), 1.0).withColumns({"aspect": terrain.aspect_degrees(), "shade": terrain.hillshade()}).first()
    assert flat["aspect"] is None and flat["shade"] == pytest.approx(math.sin(math.radians(45)))


def relax(data, tolerance=1e-4, sweeps=400):
    out, void = data.copy(), np.isnan(data)
    known = np.argwhere(~void)
    for i, j in np.argwhere(void):
        out[i, j] = data[tuple(known[((known - (i, j)) ** 2).sum(axis=1).argmin()])]
    for _ in range(sweeps):
        p = np.pad(out, 1, mode="edge")
        after = np.where(void, (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4, out)
        change = np.abs(after - out).max()
        out = after
        if change < tolerance:
            return out
    return out


def test_voids_are_filled_alike_whole_and_by_tile(spark):
    rng = np.random.default_rng(2)
    rows, cols = np.indices((24, 26))
    data = 5 + 0.3 * cols - 0.2 * rows + rng.normal(0, 0.1, rows.shape)
    data[rng.uniform(size=data.shape) < 0.3] = np.nan
    data[8:15, 5:14] = np.nan
    data[:, 22:] = np.nan  # a margin without data
    data[20] = np.nan
    g = grid_of(data)
    whole = layer(fill.fill_voids(from_array(spark, data, g), g), g)
    assert np.abs(whole - relax(data)).max() < 1e-2 and not np.isnan(whole).any()
    for side, depth, most in ((7, 3, 400), (10, 10, 400), (64, 64, 7)):
        parts = layer(fill.fill_voids(from_array(spark, data, g), g, whole=0, side=side, depth=depth, max_iter=most), g)
        alike = whole if most == 400 else layer(fill.fill_voids(from_array(spark, data, g), g, max_iter=most), g)
        assert (parts == alike).all(), (side, depth)
    full = from_array(spark, np.ones((3, 3)), grid_of(np.ones((3, 3))))
    assert fill.fill_voids(full, grid_of(np.ones((3, 3)))) is full
    with pytest.raises(InputDataError):
        fill.fill_voids(from_array(spark, np.full((3, 3), np.nan), grid_of(np.ones((3, 3)))), grid_of(np.ones((3, 3))))


def flood(dem):
    h, w = dem.shape
    water, heap = np.full(dem.shape, np.inf), []
    for i in range(h):
        for j in range(w):
            near = dem[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
            if not np.isnan(dem[i, j]) and (i in (0, h - 1) or j in (0, w - 1) or np.isnan(near).any()):
                water[i, j] = dem[i, j]
                heapq.heappush(heap, (dem[i, j], i, j))
    done = set()
    while heap:
        level, i, j = heapq.heappop(heap)
        if (i, j) in done:
            continue
        done.add((i, j))
        for a in range(max(0, i - 1), min(h, i + 2)):
            for b in range(max(0, j - 1), min(w, j + 2)):
                if not np.isnan(dem[a, b]) and water[a, b] == np.inf:
                    water[a, b] = max(dem[a, b], math.nextafter(level, math.inf))
                    heapq.heappush(heap, (water[a, b], a, b))
    return np.where(np.isnan(dem), np.nan, water)


def test_nearest_columns_by_an_envelope():
    rng = np.random.default_rng(12)
    for _ in range(300):
        cols = np.sort(rng.choice(40, rng.integers(1, 15), replace=False))
        apart = rng.integers(0, 9, len(cols)) ** 2
        want = [int(np.argmin(apart + (cols - c) ** 2)) for c in range(40)]
        assert fill._envelope(cols, apart, np.arange(40)).tolist() == want


@pytest.mark.parametrize("side", [512, 7, 2])
def test_depressions_are_filled_as_by_a_sequential_flood(spark, side):
    dem = np.random.default_rng(3).normal(size=(18, 20)).round(1)
    dem[4, 4] = np.nan
    g = grid_of(dem)
    found = layer(fill.fill_depressions(from_array(spark, dem, g, "dem"), g, side=side), g, "filled")
    want = flood(dem)
    assert (np.isnan(found) == np.isnan(dem)).all()
    assert np.nanmax(np.abs(found - want)) <= 1e-12


def test_directions_accumulation_and_orders(spark, monkeypatch):
    rng = np.random.default_rng(4)
    dem = rng.normal(size=(16, 17))
    g = grid_of(dem)
    cells = fill.fill_depressions(from_array(spark, dem, g, "dem"), g)
    found = hydrology.flow_direction(cells, g).withColumn("downstream", hydrology.downstream(g)).orderBy("cell").collect()
    after = [r["downstream"] for r in found]
    inner = [r for r in found if 0 < r["row"] < 15 and 0 < r["col"] < 16]
    assert all(r["downstream"] is not None for r in inner)  # every inner cell drains
    want = np.ones(g.n_cells, int)
    for c in sorted(range(g.n_cells), key=lambda c: -found[c]["filled"]):
        if after[c] is not None:
            want[after[c]] += want[c]
    table = spark.createDataFrame([(c, a) for c, a in enumerate(after)], "cell long, downstream long")
    for small in (graph.SMALL, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        acc = {r["cell"]: r["acc"] for r in hydrology.flow_accumulation(table).collect()}
        assert [acc[c] for c in range(g.n_cells)] == want.tolist()
    assert sum(want[c] for c in range(g.n_cells) if after[c] is None) == g.n_cells


def test_reaches_and_strahler_equal_a_walk(spark):
    rng = np.random.default_rng(5)
    n = 300
    after = [None] + [int(rng.integers(0, c)) for c in range(1, n)]  # a random tree towards 0
    acc = np.ones(n, int)
    for c in range(n - 1, 0, -1):
        acc[after[c]] += acc[c]
    g = Grid(0.0, 20.0, 1.0, 20, 20)
    table = spark.createDataFrame([(c, a, int(x)) for c, (a, x) in enumerate(zip(after, acc, strict=True))], "cell long, downstream long, acc long")
    stream = hydrology.streams(table, 2)
    found = {r["start"]: r for r in hydrology.reaches(stream, g).collect()}
    kept = [c for c in range(n) if acc[c] >= 2]
    into = {c: [u for u in kept if after[u] == c] for c in kept}
    order = {}
    for c in sorted(kept, key=lambda c: acc[c]):
        orders = sorted((order[u] for u in into[c]), reverse=True)
        order[c] = 1 if not orders else orders[0] + (len(orders) > 1 and orders[1] == orders[0])
    want = {}
    for s in kept:
        if len(into[s]) != 1:
            path = [s]
            while after[path[-1]] is not None:
                path.append(after[path[-1]])
                if len(into[path[-1]]) != 1:
                    break
            if len(path) >= 2:
                last = path[-2] if len(into[path[-1]]) != 1 else path[-1]
                want[s] = (path, order[s], acc[last] / 10_000)
    assert set(found) == set(want)
    for s, (path, o, area) in want.items():
        assert (found[s]["cells"], found[s]["strahler_order"]) == (path, o) and found[s]["contributing_area_ha"] == pytest.approx(area)
    assert [r["reach_id"] for r in sorted(found.values(), key=lambda r: r["start"])] == list(range(1, len(found) + 1))
    for small in (None, 0):  # in one task, and in rounds of jobs
        own = {r["cell"]: r["strahler_order"] for r in hydrology.strahler_orders(stream, small).collect()}
        assert all(own[c] == order[c] for c in kept)
    by_rounds = {r["start"]: (r["reach_id"], r["cells"], r["strahler_order"]) for r in hydrology.reaches(stream, g, small=0).collect()}
    assert by_rounds == {s: (r["reach_id"], r["cells"], r["strahler_order"]) for s, r in found.items()}
    assert hydrology.reaches(stream.where("cell < 0"), g).count() == 0 == hydrology.strahler_orders(stream.where("cell < 0"), 0).count()


def test_ranks_of_full_and_empty_trees(spark):
    full = spark.createDataFrame([(i, (i - 1) // 2 if i else None) for i in range(31)], "node long, next long")
    for small in (None, 0):
        found = {r["node"]: r["rank"] for r in graph.ranks(full, small).collect()}
        assert found == {i: 5 - (i + 1).bit_length() + 1 for i in range(31)}


def plan_bytes(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def recorded(monkeypatch, module):
    """The sizes that the plans of a module's checkpoints are taken for, as they come."""
    sizes = []

    def run(df):
        kept = cut(df)
        sizes.append(plan_bytes(kept))
        return kept

    monkeypatch.setattr(module, "cut", run)
    return sizes


def test_rounds_of_joins_keep_the_plans_sizes_bounded(spark):
    nodes = cut(spark.range(40).select(F.col("id").alias("node"), F.col("id").alias("at")))
    assert plan_bytes(nodes) < 2**20  # a size that fits is left as it is
    for _ in range(8):
        ahead = nodes.select(F.col("node").alias("at"), (F.col("at") + 1).alias("after"))
        nodes = cut(nodes.join(ahead, "at").select("node", F.least("after", F.lit(39)).alias("at")))
        assert plan_bytes(nodes) < 2**63
    assert nodes.schema.simpleString() == "struct<node:bigint,at:bigint>"
    assert sorted(r["at"] for r in nodes.collect()) == [39 if n > 38 else min(39, n + 255) for n in range(40)]


def test_orders_in_rounds_keep_the_plans_sizes_bounded(spark, monkeypatch):
    sizes = recorded(monkeypatch, graph)
    found = graph.ranks(spark.createDataFrame([(i, (i - 1) // 2 if i else None) for i in range(127)], "node long, next long"), 0)
    assert {r["node"]: r["rank"] for r in found.collect()} == {i: 8 - (i + 1).bit_length() for i in range(127)}
    assert len(sizes) > 20 and max(sizes) < 2**63


def test_depressions_in_rounds_keep_the_plans_sizes_bounded(spark, monkeypatch):
    sizes = recorded(monkeypatch, fill)
    dem = np.full((12, 12), 9.0)
    dem[1:11, 1::2] = 0.0  # trenches that turn at alternate ends, so that water goes round by many tiles
    dem[1, 2:11:4], dem[10, 4:11:4] = 1.0, 1.0
    dem[0, 1] = -1.0
    g = grid_of(dem)
    found = layer(fill.fill_depressions(from_array(spark, dem, g, "dem"), g, side=3), g, "filled")
    assert np.abs(found - flood(dem)).max() <= 1e-12
    assert len(sizes) > 8 and max(sizes) < 2**63


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert [(r["v"], r["n"]) for r in numbered(rows, ["v"], "n").orderBy("n").collect()] == [(i, i + 1) for i in range(1000)]
    assert numbered(rows.where("v < 0"), ["v"], "n").count() == 0


def test_lines_are_simplified_and_measured(spark):
    line = [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (4, 3)]
    row = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in line], [0, 1, 2, 23, 44, 64])], "l array<struct<x:double,y:double>>, cells array<long>")
    g = Grid(0.0, 20.0, 1.0, 20, 20)
    found = row.select(hydrology.simplify_staircase("l").alias("k"), hydrology.path_length("cells", g).alias("m")).first()
    assert [(p["x"], p["y"]) for p in found["k"]] == [(0, 0), (2, 0), (4, 2), (4, 3)]
    assert found["m"] == pytest.approx(3 + 2 * math.sqrt(2))


def test_empty_boxes_are_refused():
    for box in ((0, 0, 0, 5), (0, 0, 5, 0), (5, 0, 0, 5)):
        with pytest.raises(ConfigError):
            Grid.from_bounds(*box, 1.0)
    g = Grid.from_bounds(10.2, 20.7, 15.1, 23.0, 1.0, meters_per_unit=2.0)
    assert g.extent_m == (0.0, 12.0, 0.0, 6.0) and g.transform == (1.0, 0.0, 10.0, 0.0, -1.0, 23.0) and g.bounds == (10.0, 20.0, 16.0, 23.0)


def test_classes_are_checked():
    assert [c.label for c in build_classes()] == ["Open (<0.5 m)", "Shrub (0.5-2 m)", "Small tree (2-5 m)", "Tree (>5 m)"]
    for wrong in ({"breaks_m": (2.0, 1.0, 5.0)}, {"breaks_m": (0.0, 1.0, 2.0)}, {"names": ("a",)}, {"woody": ("Moss",)}, {"colors": ()}):
        with pytest.raises(ConfigError):
            build_classes(VegetationParams(**wrong))


def test_systems_of_zones_are_read_or_refused():
    square = [[[500002, 5], [500012, 5], [500012, 15], [500002, 15], [500002, 5]]]
    make = lambda name: {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": square}}]} | ({"crs": {"properties": {"name": name}}} if name else {})
    g = Grid(500_000.0, 30.0, 1.0, 20, 30, "EPSG:32631")
    for name in ("EPSG:32631", "urn:ogc:def:crs:EPSG::32631", "urn:ogc:def:crs:EPSG:9.8:32631"):
        assert zones.zones_from_geojson(make(name), g)[0].polygons[0][0][0] == (500002.0, 5.0)
    for name in ("the town's own", "urn:ogc:def:crs:EPSG::27700"):
        with pytest.raises(InputDataError):
            zones.zones_from_geojson(make(name), g)
    with pytest.raises(InputDataError):
        zones.zones_from_geojson(make("EPSG:32631"), Grid(0.0, 1.0, 1.0, 1, 1))


def test_components(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)], "a long, b long")
    for small in (graph.SMALL, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        found = {r["node"]: r["root"] for r in graph.components(edges).where("node != 5").collect()}
        assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}


def test_canopy_takes_spikes_and_pits_out(spark):
    chm = np.full((7, 7), 8.0)
    chm[3, 3], chm[1, 5], chm[6] = 0.5, 80.0, -1.0
    g = grid_of(chm)
    cells = from_array(spark, chm, g, "dsm").withColumn("dem", F.lit(0.0))
    found = layer(canopy.canopy_height_model(cells), g, "chm")
    assert found[3, 3] == 8.0 and found[1, 5] == 8.0 and (found[6] == 0).all()


def test_surface_ignores_what_is_no_vegetation(spark):
    g = Grid(0.0, 5.0, 1.0, 5, 5)
    rows = [(1.5, 3.5, 4.0, 1), (1.5, 3.5, 55.0, 18), (2.5, 2.5, 9.0, 6), (3.5, 1.5, 1.0, 1)]
    points = spark.createDataFrame(rows, "x double, y double, z double, classification int")
    dem = from_array(spark, np.full((5, 5), 2.0), g, "dem")
    found = layer(canopy.surface_model(points, dem, g), g, "dsm")
    assert found[1, 1] == 4.0 and found[3, 3] == 2.0 and found[2, 2] == 2.5 and found[0, 4] == 2.0


def test_classes_and_areas(spark):
    found = build_classes()
    heights = np.array([[0, 0.49, 0.5, 1.99], [2, 4.99, 5, np.nan]])
    g = grid_of(heights)
    codes = layer(from_array(spark, heights, g, "chm").withColumn("code", classes.classify(found)), g, "code")
    assert codes.tolist() == [[1, 1, 2, 2], [3, 3, 4, 0]]
    table = from_array(spark, np.array([[1, 2, 2, 3], [4, 4, 4, 0]], float), g, "code").withColumn("code", F.col("code").cast("int"))
    areas = classes.class_areas(table, found, 4046.8564224).orderBy("code")
    assert [r["cells"] for r in areas.collect()] == [1, 2, 1, 3]
    assert tuple(areas.agg(classes.role_acres("woody"), classes.role_acres("treatment")).first()) == (6.0, 3.0)
    assert [r["percent"] for r in classes.class_areas(table, found, 1.0, F.lit(False)).collect()] == [0.0] * 4
    assert [c.label for c in found] == ["Open (<0.5 m)", "Shrub (0.5-2 m)", "Small tree (2-5 m)", "Tree (>5 m)"] and classes.woody_floor(found) == 0.5
    for bad in ({"breaks_m": (2.0, 1.0, 3.0)}, {"names": ("a",)}, {"woody": ("Moss",)}):
        with pytest.raises(ConfigError):
            build_classes(VegetationParams(**bad))


def test_ground_is_told_from_roof_and_shrub(spark):
    rng = np.random.default_rng(6)
    x, y = rng.uniform(0, 60, (2, 12_000))
    z, kind = 50 + 0.1 * x + rng.normal(0, 0.02, len(x)), np.zeros(len(x), int)
    roof = (x > 20) & (x < 32) & (y > 20) & (y < 30)
    shrub = (np.hypot(x - 45, y - 45) < 2) & (rng.uniform(size=len(x)) < 0.8)
    z[roof] += 6
    z[shrub] += rng.uniform(0.6, 1.5, shrub.sum())
    kind[roof | shrub] = 1
    rows = list(zip(x.tolist(), y.tolist(), z.tolist(), [1] * len(x), kind.tolist(), strict=True))
    points = spark.createDataFrame(rows, "x double, y double, z double, classification int, raised int")
    found = ground.pmf_ground(PointCloud(points), GroundParams(), 1.0).groupBy("raised").agg(F.avg(F.col("is_ground").cast("double")).alias("share"))
    share = {r["raised"]: r["share"] for r in found.collect()}
    assert share[0] > 0.97 and share[1] < 0.03
    with pytest.raises(InputDataError):
        ground.classify_ground(PointCloud(points), GroundParams(method="existing"))
    assert points.where(noise_mask()).isEmpty()


def test_zones(spark):
    def square(x, y, side):
        return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]

    def feature(kind, coordinates, **properties):
        return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}

    collection = {
        "type": "FeatureCollection",
        "crs": {"type": "name", "properties": {"name": "EPSG:32631"}},
        "features": [feature("Point", [0, 0]), feature("Polygon", [square(500_002, 1005, 10)], name="A"), feature("MultiPolygon", [[square(500_010, 1005, 4), square(500_011, 1006, 2)]]), feature("Polygon", [square(600_000, 1005, 4)], name="Away")],
    }
    listed = zones.zones_from_geojson(collection, PLANE)
    assert [(z.zone_id, z.name) for z in listed] == [(1, "A"), (2, "Zone 2"), (3, "Away")]
    table = zones.zone_table(spark, listed)
    cells = zones.rasterize_zones(raster.domain(spark, PLANE), table, PLANE).withColumns({"code": F.lit(2), "slope": F.lit(3.0)})
    counts = {r["zone_id"]: r["cells"] for r in zones.zone_totals(cells).collect()}
    assert counts == {1: 100 - 8 + 2, 2: 12, None: 106}  # the later zone takes the overlap, but for its hole
    summary = {r["name"]: r for r in zones.summarize_zones(cells, table, build_classes(), PLANE).collect()}
    assert summary["Away"]["cells"] == 0 and summary["Away"]["mean_slope_deg"] is None and summary["Zone 2"]["shrub_acres"] == pytest.approx(12 / 4046.8564224)
    for bad in ({}, {"features": [feature("Point", [0, 0])]}):
        with pytest.raises(InputDataError):
            zones.zones_from_geojson(bad, PLANE)


def test_sampling_is_bilinear_and_clamped(spark):
    rows, cols = np.indices((6, 5))
    data = 10.0 + cols - 2 * rows
    g = grid_of(data)
    points = spark.createDataFrame([(2.0, 3.0), (0.1, 5.9), (2.5, 2.25)], "x double, y double")
    found = {(r["x"], r["y"]): r["sampled"] for r in raster.sample(points, from_array(spark, data, g), g).collect()}
    assert found[(2.0, 3.0)] == pytest.approx(10 + 1.5 - 2 * 2.5) and found[(0.1, 5.9)] == 10.0 and found[(2.5, 2.25)] == pytest.approx(10 + 2 - 2 * 3.25)
    coarse = raster.block_max(from_array(spark, np.arange(16.0).reshape(4, 4), grid_of(np.ones((4, 4)))), 2)
    assert sorted(r["v"] for r in coarse.collect()) == [5, 7, 13, 15]


def test_projection_goes_there_and_back(spark):
    lon, lat = -97.84, 30.32
    x, y = crs.project_xy(lon, lat, "EPSG:32614")
    assert crs.unproject_xy(x, y, "EPSG:32614") == pytest.approx((lon, lat), abs=1e-10)
    a, b = crs.project(F.lit(lon), F.lit(lat), "EPSG:32614")
    assert tuple(spark.range(1).select(a, b).first()) == pytest.approx((x, y), abs=1e-6)
    assert crs.project_xy(3.0, 0.0, "EPSG:32631") == pytest.approx((500_000.0, 0.0))
    assert crs.meters_per_unit("EPSG:32614") == 1.0 and crs.meters_per_unit('PROJCS["x",UNIT["US survey foot",0.3048006096]]') == 1200 / 3937
    for bad in (None, "EPSG:4326"):
        with pytest.raises(InputDataError):
            crs.meters_per_unit(bad)
    w, s, e, n = crs.project_bounds((-97.842, 30.318, -97.836, 30.323), "EPSG:32614")
    assert 570 < e - w < 590 and 550 < n - s < 565


LCC = 'PROJCS["x",GEOGCS["NAD27",SPHEROID["Clarke 1866",6378206.4,294.978698214]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",{a}],PARAMETER["standard_parallel_2",{b}],PARAMETER["latitude_of_origin",{o}],PARAMETER["central_meridian",{m}],PARAMETER["false_easting",{e}],PARAMETER["false_northing",{n}],UNIT["{u}",{k}]]'


def test_other_projections_go_there_and_back(spark):
    texas = LCC.format(a=30.11666666666667, b=31.88333333333333, o=29.66666666666667, m=-100.3333333333333, e=2296583.333, n=9842500.0, u="US survey foot", k=0.3048006096012192)
    plane = 'PROJCS["NAD83 / Florida East",PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",24.33333333333333],PARAMETER["central_meridian",-81],PARAMETER["scale_factor",0.999941177],PARAMETER["false_easting",200000],PARAMETER["false_northing",0],UNIT["metre",1]]'
    new = 'PROJCRS["x",CONVERSION["y",METHOD["Lambert Conic Conformal (1SP)"],PARAMETER["Latitude of natural origin",18],PARAMETER["Longitude of natural origin",-77],PARAMETER["Scale factor at natural origin",1],PARAMETER["False easting",250000],PARAMETER["False northing",150000]],LENGTHUNIT["metre",1]]'
    for system, lon, lat in ((texas, -97.7, 30.3), (plane, -81.3, 28.5), (new, -76.8, 18.1), ("EPSG:5070", -120.5, 47.1), ("EPSG:3338", -150.0, 61.2), ("EPSG:3034", 24.0, 60.0), ("EPSG:32733", 14.0, -22.0)):
        x, y = crs.project_xy(lon, lat, system)
        assert crs.unproject_xy(x, y, system) == pytest.approx((lon, lat), abs=6e-9), system  # less than a millimeter
        a, b = crs.project(F.lit(lon), F.lit(lat), system)
        c, d = crs.unproject(F.lit(x), F.lit(y), system)
        assert tuple(spark.range(1).select(a, b, c, d).first()) == pytest.approx((x, y, lon, lat), abs=1e-6)
    # Places where the answer is known: a false origin, and scale along a standard parallel.
    assert crs.project_xy(-100.3333333333333, 29.66666666666667, texas) == pytest.approx((2296583.333, 9842500.0), abs=1e-3)
    assert crs.project_xy(-81.0, 24.33333333333333, plane) == pytest.approx((200_000.0, 0.0), abs=1e-6)
    assert crs.project_xy(-96.0, 23.0, "EPSG:5070") == pytest.approx((0.0, 0.0), abs=1e-6)
    sine = math.sin(math.radians(45.5))
    arc = math.radians(1e-4) * 6378137 * math.cos(math.radians(45.5)) / math.sqrt(1 - 0.00669438 * sine * sine)
    (x0, y0), (x1, y1) = crs.project_xy(-96.0, 45.5, "EPSG:5070"), crs.project_xy(-95.9999, 45.5, "EPSG:5070")
    assert math.hypot(x1 - x0, y1 - y0) == pytest.approx(arc, rel=1e-6)
    box = [crs.project_xy(lon, lat, "EPSG:5070") for lon, lat in ((-110, 40), (-109.999, 40), (-109.999, 40.001), (-110, 40.001))]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(box, box[1:] + box[:1], strict=True))) / 2
    m = lambda lat: crs._area(math.sin(math.radians(lat)), crs.PLAIN)
    assert area == pytest.approx(crs.A**2 / 2 * math.radians(0.001) * (m(40.001) - m(40)), rel=1e-5)
    for bad in ("EPSG:27700", 'PROJCS["x",PROJECTION["Krovak"],UNIT["metre",1]]', 'PROJCS["x",PROJECTION["Albers_Conic_Equal_Area"],UNIT["metre",1]]'):
        with pytest.raises(InputDataError):
            crs.project_xy(0.0, 50.0, bad)


def test_settings():
    assert load_demo_region_config().pipeline.ground.terrain_slope == 0.6
    assert parse_config("[other]\nx = 1").region is None
    region = '[region]\nname = "a"\nland_status = "b"\n'
    for bad in ("[pipeline]\nzoom = 1", "[pipeline.ground]\nmethod = 'magic'", "broken", region, region + "bbox_wgs84 = [1, 2, 0, 3]", region + "bbox_wgs84 = [1, 2]", "[pipeline]\nresolution_m = 0"):
        with pytest.raises(ConfigError):
            parse_config(bad)


def test_threshold_follows_cell_area():
    assert hydrology.threshold_cells(HydrologyParams(1.0), Grid(0, 10, 2.0, 5, 5)) == 2500
