"""The engine's operators as queries on the supplied tables, and the SQL that says what each must return.

``lineitem`` is read as a point cloud over a 64 x 64 lattice (heights in whole
millimeters, so that sums don't depend on their order) and ``events`` as a tile
catalogue.  Values of transcendental functions are rounded to 6 places alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import CanopyParams, GroundParams, Grid, HillshadeParams, PipelineParams, VegetationParams, build_classes, noise_mask, vegetation_mask
from .operators import canopy, classes, fill, ground, hydrology, raster, terrain, zones
from .plans import pipeline, validation
from .sources import catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SIDE = 64
GRID = Grid(0.0, float(SIDE), 1.0, SIDE, SIDE, "EPSG:32631")
CLASSES = build_classes(VegetationParams())
RES_MM = 1000.0


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


VIEW = """
SELECT cast((l_partkey * 31 + l_linenumber * 7) % 64 AS bigint) AS col, cast((l_suppkey * 17 + l_orderkey) % 64 AS bigint) AS row,
       cast(300000 + 20 * ((l_partkey * 31 + l_linenumber * 7) % 64) + CASE WHEN l_linenumber > 4 THEN 100 * cast(l_quantity AS bigint) ELSE 0 END AS bigint) AS z_mm,
       CASE WHEN l_quantity = 1 THEN 7 WHEN l_quantity = 50 THEN 18 WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS cls,
       l_orderkey, l_linenumber
FROM lineitem
"""
#: Common table expressions: the points with their cell, the lattice, and a surface without voids.
POINTS = f"WITH RECURSIVE p AS (SELECT *, row * 64 + col AS cell FROM ({VIEW})), d AS (SELECT i AS cell, i // 64 AS row, i % 64 AS col FROM range(4096) t(i))"
SURFACE = POINTS + ", s AS (SELECT d.cell, d.row, d.col, cast(coalesce(m, 300000 + 20 * d.col) AS double) AS v FROM d LEFT JOIN (SELECT cell, min(z_mm) AS m FROM p WHERE cls NOT IN (7, 18) GROUP BY cell) USING (cell))"
#: The same without ties, for flow.
UNTIED = SURFACE + ", u AS (SELECT cell, row, col, v * 4096 + (cell * 1237 + 11) % 4096 AS v FROM s)"


def beside(src: str, into: str, edge: bool = True, value: str = "v") -> str:
    """SQL: a table of the nine values around each cell, the edge replicated or null."""
    cols, joins = [], []
    for k, (dr, dc) in {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "c": (0, 0), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}.items():
        r, c = f"a.row + {dr}", f"a.col + {dc}"
        if edge:
            r, c = f"least(greatest({r}, 0), 63)", f"least(greatest({c}, 0), 63)"
        cols.append(f"j_{k}.{value} AS {k}")
        joins.append(f"LEFT JOIN {src} j_{k} ON j_{k}.row = {r} AND j_{k}.col = {c}")
    return f"{into} AS (SELECT a.cell, a.row, a.col, {', '.join(cols)} FROM {src} a {' '.join(joins)})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud: x, y, z (mm), classification and what the view is keyed by."""
    view = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "cast((l_partkey * 31 + l_linenumber * 7) % 64 AS bigint) AS col0",
        "cast((l_suppkey * 17 + l_orderkey) % 64 AS bigint) AS row0",
        "CASE WHEN l_linenumber > 4 THEN 100 * cast(l_quantity AS bigint) ELSE 0 END AS above",
        "CASE WHEN l_quantity = 1 THEN 7 WHEN l_quantity = 50 THEN 18 WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS classification",
        "l_orderkey",
        "l_linenumber",
    )
    return view.select((F.col("col0") + 0.5).alias("x"), (F.lit(63.5) - F.col("row0")).alias("y"), (F.lit(300000) + 20 * F.col("col0") + F.col("above")).cast("double").alias("z"), F.col("classification").cast("smallint").alias("classification"), "l_orderkey", "l_linenumber")


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest returns by cell, a plane where there are none: cell, row, col, v."""
    found = raster.cell_statistic(points(spark, sf_dir).where(~noise_mask()), GRID, "min")
    return found.withColumn("v", F.coalesce("v", (300000 + 20 * F.col("col")).cast("double")))


def untied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface(spark, sf_dir).withColumn("v", F.col("v") * 4096 + (F.col("cell") * 1237 + 11) % 4096)


def micro(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


def _stat(stat: str, sql: str) -> None:
    @query(f"cell_{stat}", f"{POINTS} SELECT d.cell, {sql} AS v FROM d LEFT JOIN (SELECT * FROM p WHERE cls NOT IN (7, 18)) q USING (cell) GROUP BY d.cell")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raster.cell_statistic(points(spark, sf_dir).where(~noise_mask()), GRID, stat).select("cell", "v")


for _name, _sql in {"min": "min(z_mm)::double", "max": "max(z_mm)::double", "mean": "sum(z_mm)::double / count(z_mm)", "count": "count(z_mm)"}.items():
    _stat(_name, _sql)


@query("flat_index_edges", "SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 0 AND 19 AND n_nationkey BETWEEN 1 AND 20 THEN cast((20 - n_nationkey) * 20 + n_nationkey AS bigint) END AS cell FROM nation")
def flat_index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on cell corners: west and north edges are in, east and south edges out."""
    grid = Grid(0.0, 20.0, 1.0, 20, 20)
    at = F.col("n_nationkey").cast("double")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", grid.flat_index(at, at).alias("cell"))


@query("noise_filter", f"{POINTS} SELECT cast(cls AS smallint) AS classification, count(*) AS n FROM p WHERE cls NOT IN (7, 18) GROUP BY cls")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(~noise_mask()).groupBy("classification").agg(F.count("*").alias("n"))


@query("vegetation_filter", f"{POINTS} SELECT cell, count(*) AS n FROM p WHERE cls NOT IN (6, 7, 9, 17, 18) GROUP BY cell")
def vegetation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.occupied(points(spark, sf_dir).where(vegetation_mask()), GRID, n=F.count("*"))


@query("ground_share_auto", f"{POINTS} SELECT sum(CASE WHEN cls = 2 THEN 1.0::double ELSE 0.0::double END) / count(*) AS share, sum(CASE WHEN cls = 2 THEN 1.0::double ELSE 0.0::double END) / count(*) >= 0.05 AS trusted FROM p WHERE cls NOT IN (7, 18)")
def ground_share_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = ground.ground_share(points(spark, sf_dir))
    return spark.createDataFrame([(share, share >= GroundParams().min_existing_fraction)], "share double, trusted boolean")


GROUND_MEAN = "g AS (SELECT cell, sum(z_mm)::double / count(*) AS dem FROM p WHERE cls = 2 GROUP BY cell)"


@query("dem_mean_void_fraction", f"{POINTS}, {GROUND_MEAN} SELECT sum(dem) IS NOT NULL AS any_ground, avg(CASE WHEN dem IS NULL THEN 1.0 ELSE 0.0 END)::double AS void_fraction FROM d LEFT JOIN g USING (cell)")
def dem_mean_void_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem, share = ground.bare_earth_model(points(spark, sf_dir).withColumn("is_ground", F.col("classification") == 2), GRID)
    return dem.agg((F.count("dem") > 0).alias("any_ground"), F.lit(share).alias("void_fraction"))


@query("dem_filled")
def dem_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voids filled by relaxation: an iteration that SQL would need a row a sweep and cell for."""
    found = raster.dense(raster.occupied(points(spark, sf_dir).where("classification = 2"), GRID, dem=F.avg("z")), GRID)
    return fill.fill_voids(found, GRID, "dem").select("cell", "dem")


@query("dem_filled_tiles")
def dem_filled_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, of a raster with wider voids, by tiles as large rasters are; tests hold both against each other."""
    found = raster.dense(raster.occupied(high_points(spark, sf_dir), GRID, dem=F.avg("z")), GRID)
    return fill.fill_voids(found, GRID, "dem", whole=0, side=32, depth=32, max_iter=96).select("cell", "dem")


TOP = "t AS (SELECT d.cell, d.row, d.col, m::double AS v FROM d LEFT JOIN (SELECT cell, max(z_mm) AS m FROM p WHERE cls = 1 AND z_mm > 302000 GROUP BY cell) USING (cell))"


def high_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns well above the plane: few enough that cells lack them."""
    return points(spark, sf_dir).where((F.col("z") > 302000) & (F.col("classification") != 2))


@query("dsm_max", f"{POINTS}, {TOP} SELECT cell, v FROM t")
def dsm_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canopy.top_heights(high_points(spark, sf_dir), GRID).select("cell", "v")


_SUM9 = " + ".join(f"coalesce({k}, 0.0)" for k in raster.AROUND)
_N9 = " + ".join(f"({k} IS NOT NULL)::int" for k in raster.AROUND)


@query("dsm_void_neighbor_mean", f"{SURFACE}, {TOP}, {beside('t', 'b')} SELECT b.cell, greatest(coalesce(b.c, CASE WHEN {_N9} > 0 THEN ({_SUM9}) / ({_N9}) END, s.v), s.v) AS dsm FROM b JOIN s USING (cell)")
def dsm_void_neighbor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = surface(spark, sf_dir).withColumnRenamed("v", "dem")
    return canopy.surface_model(high_points(spark, sf_dir), dem, GRID).select("cell", "dsm")


CHM = f"{SURFACE}, {TOP}, h AS (SELECT s.cell, s.row, s.col, greatest((coalesce(t.v, s.v) - s.v) / 1000.0::double, 0.0::double) AS v FROM s JOIN t USING (cell))"


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dsm and dem in meters."""
    top = canopy.top_heights(high_points(spark, sf_dir), GRID).select("cell", F.col("v").alias("top"))
    both = surface(spark, sf_dir).join(top, "cell")
    return both.select("cell", "row", "col", F.lit(0.0).alias("dem"), ((F.coalesce("top", "v") - F.col("v")) / 1000.0).alias("dsm"))


@query("chm_clip", f"{CHM} SELECT cell, v AS chm FROM h")
def chm_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a spike or pit to take out, heights are clipped at the ground."""
    return canopy.canopy_height_model(heights(spark, sf_dir), CanopyParams(max_height_m=1e9, pit_fill_m=0.0)).select("cell", "chm")


_MEDIAN = f"list_sort([{', '.join(raster.AROUND)}])[5]"
_SPIKE = f"CASE WHEN c > 4.0 THEN least({_MEDIAN}, 4.0::double) ELSE c END"
CLEAN = f"{CHM}, {beside('h', 'b')}, k AS (SELECT cell, row, col, CASE WHEN {_MEDIAN} - ({_SPIKE}) > 1.5 THEN {_MEDIAN} ELSE {_SPIKE} END AS chm FROM b)"


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canopy.canopy_height_model(heights(spark, sf_dir), CanopyParams(max_height_m=4.0, pit_fill_m=1.5))


@query("chm_spike_pit", f"{CLEAN} SELECT cell, chm FROM k")
def chm_spike_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("cell", "chm")


_CODE = "cast(CASE WHEN chm IS NULL THEN 0 WHEN chm >= 5 THEN 4 WHEN chm >= 2 THEN 3 WHEN chm >= 0.5 THEN 2 ELSE 1 END AS smallint)"


@query("class_codes", f"{CLEAN} SELECT cell, {_CODE} AS code FROM k")
def class_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("cell", classes.classify(CLASSES).alias("code"))


_CLASS_ROWS = ", ".join(f"({c.code}, '{c.name}', {str(c.woody).lower()}, {str(c.treatment).lower()})" for c in CLASSES)
#: Flagship: points to cells, the highest less the mean ground, class by height, acres by class.
FLAGSHIP = f"""{POINTS}, {GROUND_MEAN}, t AS (SELECT cell, max(z_mm)::double AS top FROM p WHERE cls NOT IN (6, 7, 9, 17, 18) GROUP BY cell),
k AS (SELECT d.cell, greatest((top - dem) / 1000.0::double, 0.0::double) AS chm FROM d LEFT JOIN g USING (cell) LEFT JOIN t USING (cell)),
n AS (SELECT code, count(*) AS n FROM (SELECT CASE WHEN top IS NULL OR dem IS NULL THEN 0 WHEN chm >= 5 THEN 4 WHEN chm >= 2 THEN 3 WHEN chm >= 0.5 THEN 2 ELSE 1 END AS code FROM k LEFT JOIN g USING (cell) LEFT JOIN t USING (cell)) WHERE code > 0 GROUP BY code),
c(code, name, woody, treatment) AS (VALUES {_CLASS_ROWS}),
a AS (SELECT cast(c.code AS smallint) AS code, name, woody, treatment, coalesce(n, 0) AS cells FROM c LEFT JOIN n ON c.code = n.code)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, chm, code from one pass over the points."""
    ground = F.avg(F.when(F.col("classification") == 2, F.col("z")))
    top = F.max(F.when(vegetation_mask(), F.col("z")))
    found = raster.dense(raster.occupied(points(spark, sf_dir), GRID, dem=ground, top=top), GRID)
    above = (F.col("top") - F.col("dem")) / 1000.0
    chm = found.withColumn("chm", F.when(above.isNotNull(), F.greatest(above, F.lit(0.0))))
    return chm.withColumn("code", classes.classify(CLASSES))


@query(
    "class_areas",
    f"{FLAGSHIP} SELECT code, name, woody, treatment, cells, cells * 1.0::double / 10000.0::double AS area_ha, cells * 1.0::double / 4046.8564224::double AS area_acres, "
    "CASE WHEN sum(cells) OVER () > 0 THEN cells * 100.0::double / (sum(cells) OVER ())::double ELSE 0.0 END AS percent FROM a",
)
def class_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.class_areas(flagship(spark, sf_dir), CLASSES, GRID.cell_area_m2)


@query("woody_treatment", f"{FLAGSHIP} SELECT floor(sum(CASE WHEN woody THEN cells * 1.0::double / 4046.8564224::double END) * 1e6 + 0.5) / 1e6 AS woody_acres, floor(sum(CASE WHEN treatment THEN cells * 1.0::double / 4046.8564224::double END) * 1e6 + 0.5) / 1e6 AS treatment_acres FROM a")
def woody_treatment(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = classes.class_areas(flagship(spark, sf_dir), CLASSES, GRID.cell_area_m2)
    return areas.agg(micro(classes.role_acres("woody")).alias("woody_acres"), micro(classes.role_acres("treatment")).alias("treatment_acres"))


_DX, _DY = "((ne + 2 * e + se) - (nw + 2 * w + sw)) / 8000.0::double", "((nw + 2 * n + ne) - (sw + 2 * s + se)) / 8000.0::double"
GRADIENT = f"{SURFACE}, {beside('s', 'b')}, q AS (SELECT cell, row, col, {_DX} AS dx, {_DY} AS dy FROM b)"
_SLOPE = "degrees(atan(sqrt(dx * dx + dy * dy)))"


def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.with_gradient(surface(spark, sf_dir), RES_MM, "v")


@query("horn_gradient", f"{GRADIENT} SELECT cell, dx AS dz_dx, dy AS dz_dy FROM q")
def horn_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gradient(spark, sf_dir).select("cell", "dz_dx", "dz_dy")


@query("slope", f"{GRADIENT} SELECT cell, floor({_SLOPE} * 1e6 + 0.5) / 1e6 AS slope FROM q")
def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gradient(spark, sf_dir).select("cell", micro(terrain.slope_degrees()).alias("slope"))


@query("aspect", f"{GRADIENT} SELECT cell, CASE WHEN sqrt(dx * dx + dy * dy) >= 1e-6 THEN floor((degrees(atan2(-dx, -dy)) + CASE WHEN degrees(atan2(-dx, -dy)) < 0 THEN 360.0 ELSE 0.0 END) * 1e6 + 0.5) / 1e6 END AS aspect FROM q")
def aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gradient(spark, sf_dir).select("cell", micro(terrain.aspect_degrees()).alias("aspect"))


_AZ, _AL = math.radians(315.0), math.radians(45.0)


@query(
    "hillshade",
    f"{GRADIENT} SELECT cell, floor(greatest(0.0::double, least(1.0::double, ({math.sin(_AL)!r}::double - {math.cos(_AL) * math.sin(_AZ)!r}::double * dx - {math.cos(_AL) * math.cos(_AZ)!r}::double * dy) / sqrt(1.0::double + dx * dx + dy * dy))) * 1e6 + 0.5) / 1e6 AS shade FROM q",
)
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gradient(spark, sf_dir).select("cell", micro(terrain.hillshade(HillshadeParams())).alias("shade"))


_BINS = [("0-5", 0, 5), ("5-10", 5, 10), ("10-20", 10, 20), (">20", 20, 90)]


@query("slope_shares", f"{GRADIENT}, z AS (SELECT {_SLOPE} AS slope FROM q) " + " UNION ALL ".join(f"SELECT '{n}' AS bin, 100.0::double * count(*) FILTER (WHERE slope >= {a} AND slope < {b}) / count(*)::double AS percent FROM z" for n, a, b in _BINS))
def slope_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = gradient(spark, sf_dir).withColumn("slope", terrain.slope_degrees()).agg(terrain.slope_shares().alias("m"))
    return shares.select(F.explode("m").alias("bin", "percent"))


def _drop_sql() -> str:
    drops = {name: f"(c - {name}) / {RES_MM * (math.sqrt(2.0) if r and c else 1.0)!r}::double" for _, name, r, c in hydrology.DIRECTIONS}
    most = f"greatest({', '.join(drops.values())})"
    cases = " ".join(f"WHEN {drops[name]} = {most} THEN {code}" for code, name, *_ in hydrology.DIRECTIONS)
    return f"CASE WHEN row IN (0, 63) OR col IN (0, 63) THEN 0 WHEN {most} > 0 THEN CASE {cases} END ELSE 0 END"


_OFFSETS = " ".join(f"WHEN {code} THEN cell + {r * SIDE + c}" for code, _, r, c in hydrology.DIRECTIONS)
D8 = f"{UNTIED}, {beside('u', 'b', False)}, f AS (SELECT cell, row, col, cast({_drop_sql()} AS smallint) AS direction FROM b), e AS (SELECT cell, row, col, direction, CASE direction {_OFFSETS} END AS downstream FROM f)"


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hydrology.flow_direction(untied(spark, sf_dir), GRID, "v", res_m=RES_MM)
    return found.withColumn("downstream", hydrology.downstream(GRID))


@query("d8_codes", f"{D8} SELECT cell, direction FROM e")
def d8_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed(spark, sf_dir).select("cell", "direction")


@query("downstream", f"{D8} SELECT cell, downstream FROM e")
def downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed(spark, sf_dir).select("cell", "downstream")


ACCUMULATED = D8 + ", w(place, from_cell) AS (SELECT cell, cell FROM e UNION ALL SELECT e.downstream, w.from_cell FROM w JOIN e ON w.place = e.cell WHERE e.downstream IS NOT NULL), acc AS (SELECT place AS cell, count(*) AS acc, sum(from_cell % 7 + 1) AS weighted FROM w GROUP BY place)"


@query("flow_accum", f"{ACCUMULATED} SELECT cell, acc FROM acc")
def flow_accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydrology.flow_accumulation(directed(spark, sf_dir))


@query("flow_accum_rounds", f"{ACCUMULATED} SELECT cell, acc FROM acc")
def flow_accum_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As graphs too large for one task are accumulated: a round of jobs for each doubling."""
    return hydrology.flow_accumulation(directed(spark, sf_dir), small=0)


@query("log_contributing_area", f"{ACCUMULATED} SELECT cell, floor(CASE WHEN acc >= 200 THEN log10(acc::double) END * 1e6 + 0.5) / 1e6 AS log_m2 FROM acc")
def log_contributing_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydrology.flow_accumulation(directed(spark, sf_dir)).select("cell", micro(terrain.log_contributing_area(GRID)).alias("log_m2"))


@query("flow_accum_weighted", f"{ACCUMULATED} SELECT cell, cast(weighted AS bigint) AS acc FROM acc")
def flow_accum_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydrology.flow_accumulation(directed(spark, sf_dir), F.col("cell") % 7 + 1)


LIMIT = 6
STREAMS = f"""{ACCUMULATED}, st AS (SELECT e.cell, e.downstream, acc FROM e JOIN acc USING (cell) WHERE acc >= {LIMIT}),
sw AS (SELECT st.cell, st.downstream, st.acc, coalesce(n, 0) AS inflow FROM st LEFT JOIN (SELECT downstream AS cell, count(*) AS n FROM st WHERE downstream IS NOT NULL GROUP BY downstream) USING (cell))"""


def stream_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = directed(spark, sf_dir).select("cell", "downstream")
    return hydrology.streams(cells.join(hydrology.flow_accumulation(cells), "cell"), LIMIT)


@query("stream_mask", f"{STREAMS} SELECT cell, inflow FROM sw")
def stream_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_cells(spark, sf_dir).select("cell", "inflow")


#: Each path walks on until the next cell is a junction, which it includes.
REACHES = f"""{STREAMS}, walk(start, cell, k, acc, next, done) AS (
  SELECT cell, cell, 1, acc, downstream, false FROM sw WHERE inflow <> 1
  UNION ALL
  SELECT walk.start, sw.cell, walk.k + 1, CASE WHEN sw.inflow = 1 THEN sw.acc ELSE walk.acc END, sw.downstream, sw.inflow <> 1 FROM walk JOIN sw ON walk.next = sw.cell WHERE NOT walk.done)"""


@query("reaches", f"{REACHES} SELECT start, max(k) AS n_cells, max(acc) * 1.0::double AS area FROM walk GROUP BY start HAVING max(k) >= 2")
def reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hydrology.reaches(stream_cells(spark, sf_dir), GRID)
    return found.select("start", F.size("cells").alias("n_cells"), F.floor(F.col("contributing_area_ha") * 10_000 + 0.5).cast("double").alias("area"))


@query("reaches_rounds", f"{REACHES}, n AS (SELECT start, max(k) AS n_cells FROM walk GROUP BY start HAVING max(k) >= 2) SELECT cast(row_number() OVER (ORDER BY start) AS integer) AS reach_id, start, n_cells FROM n")
def reaches_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As in graphs too large for one task, with the reaches' numbers."""
    found = hydrology.reaches(stream_cells(spark, sf_dir), GRID, small=0)
    return found.select("reach_id", "start", F.size("cells").alias("n_cells"))


def _rank_sql(most: int) -> str:
    """SQL: reaches of each order and more, as those at or below a place where two of the order before come together."""
    parts = ["n1 AS (SELECT start, max(CASE WHEN done THEN cell END) AS into_cell FROM walk GROUP BY start)"]
    for k in range(1, most):
        parts.append(f"r{k}(start) AS (SELECT into_cell FROM n{k} WHERE into_cell IS NOT NULL GROUP BY into_cell HAVING count(*) >= 2 UNION SELECT n{k}.into_cell FROM r{k} JOIN n{k} ON n{k}.start = r{k}.start WHERE n{k}.into_cell IS NOT NULL)")
        parts.append(f"n{k + 1} AS (SELECT * FROM n{k} WHERE start IN (SELECT start FROM r{k}))")
    every = " UNION ALL ".join(f"SELECT start FROM n{k}" for k in range(1, most + 1))
    return f"{', '.join(parts)}, ranked AS (SELECT start, count(*) AS strahler_order FROM ({every}) GROUP BY start)"


#: Six orders: a stream of order seven would need 64 heads of at least ``LIMIT`` cells each, more than the lattice's shape allows.
STRAHLER = f"{REACHES}, {_rank_sql(7)} SELECT cell, strahler_order FROM walk JOIN ranked USING (start) WHERE NOT done OR k = 1"


@query("strahler", STRAHLER)
def strahler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydrology.strahler_orders(stream_cells(spark, sf_dir))


@query("strahler_rounds", STRAHLER)
def strahler_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As in graphs too large for one task: a round for each order."""
    return hydrology.strahler_orders(stream_cells(spark, sf_dir), small=0)


_STEPS = f"""{REACHES}, v AS (SELECT start, k, cell % 64 AS x, -(cell // 64) AS y FROM walk WHERE start IN (SELECT start FROM walk GROUP BY start HAVING max(k) >= 2)),
t AS (SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, lead(x) OVER o - x AS ex, lead(y) OVER o - y AS ey FROM v WINDOW o AS (PARTITION BY start ORDER BY k))"""


@query(
    "simplify",
    f"""{_STEPS} SELECT start, cast(count(*) AS integer) AS vertices, cast(count(*) FILTER (WHERE dx IS NULL OR ex IS NULL OR sign(dx) <> sign(ex) OR sign(dy) <> sign(ey)) AS integer) AS kept,
floor((count(*) FILTER (WHERE abs(dx) + abs(dy) = 1) + count(*) FILTER (WHERE abs(dx) + abs(dy) = 2) * sqrt(2.0::double)) * 1e6 + 0.5) / 1e6 AS length_m FROM t GROUP BY start""",
)
def simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hydrology.reaches(stream_cells(spark, sf_dir), GRID).withColumn("line", hydrology.reach_line("cells", GRID))
    kept = found.withColumn("kept", hydrology.simplify_staircase("line"))
    return kept.select("start", F.size("line").alias("vertices"), F.size("kept").alias("kept"), micro(F.col("length_m")).alias("length_m"))


@query("depressions_filled")
def depressions_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flooding is a fixpoint over the whole lattice; tests hold it against a sequential flood."""
    return fill.fill_depressions(untied(spark, sf_dir), GRID, "v", side=32).select("cell", "filled")


def _box_sql(src: str, into: str, least: bool, half: int) -> str:
    f = "min" if least else "max"
    return f"{into}r AS (SELECT cell, row, col, {f}(v) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS v FROM {src}), {into} AS (SELECT cell, row, col, {f}(v) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS v FROM {into}r)"


OPENED = f"{SURFACE}, {_box_sql('s', 'o1', True, 1)}, {_box_sql('o1', 'o2', False, 1)}"


@query("opening_3", f"{OPENED} SELECT cell, v FROM o2")
def opening_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.opening(surface(spark, sf_dir), 3).select("cell", "v")


@query("opening_chain", f"{OPENED}, {_box_sql('o2', 'o3', True, 2)}, {_box_sql('o3', 'o4', False, 2)} SELECT s.cell, s.v - o2.v > 50 OR o2.v - o4.v > 90 AS off FROM s JOIN o2 USING (cell) JOIN o4 USING (cell)")
def opening_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 3 and 5 in turn, each on the last one's opening; cells that stand above either."""
    return ground.raised_cells(surface(spark, sf_dir), [(3, 50.0), (5, 90.0)]).select("cell", "off")


_U, _V = "least(greatest(col + (l_orderkey % 100) / 100.0::double - 0.5::double, 0.0::double), 63.0::double)", "least(greatest(64.0::double - (64.0::double - row - (l_linenumber % 10) / 10.0::double) - 0.5::double, 0.0::double), 63.0::double)"


@query(
    "bilinear_sample",
    f"""{SURFACE}, {beside('s', 'b')}, r AS (SELECT l_orderkey, l_linenumber, z_mm, {_U} AS u, {_V} AS v FROM p),
x AS (SELECT *, u - floor(u) AS fx, v - floor(v) AS fy, cast(floor(v) * 64 + floor(u) AS bigint) AS cell FROM r)
SELECT l_orderkey, l_linenumber, z_mm::double AS z, floor(((c * (1 - fx) + e * fx) * (1 - fy) + (s * (1 - fx) + se * fx) * fy) * 1000 + 0.5) / 1000.0::double AS sampled FROM x JOIN b USING (cell)""",
)
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    moved = found.withColumn("x", F.col("x") - 0.5 + (F.col("l_orderkey") % 100) / 100.0).withColumn("y", F.lit(64.0) - (F.lit(63.5) - F.col("y")) - (F.col("l_linenumber") % 10) / 10.0)
    sampled = raster.sample(moved, surface(spark, sf_dir), GRID)
    return sampled.select("l_orderkey", "l_linenumber", "z", (F.floor(F.col("sampled") * 1000 + 0.5) / 1000.0).alias("sampled"))


def _ring(west: float, south: float, east: float, north: float) -> tuple[tuple[float, float], ...]:
    return ((west, south), (east, south), (east, north), (west, north), (west, south))


#: Two zones that overlap, the first with a hole, and one outside the lattice.
HOLE, ONE, TWO = (12.1, 20.3, 18.9, 25.6), (5.2, 10.2, 30.7, 40.8), (25.3, 30.4, 50.6, 60.1)
ZONES = [zones.Zone(1, "One", ((_ring(*ONE), _ring(*HOLE)),)), zones.Zone(2, "Two", ((_ring(*TWO),),)), zones.Zone(3, "Away", ((_ring(100.2, 100.2, 120.5, 120.5),),))]


def _within(box: tuple[float, float, float, float]) -> str:
    return f"(col + 0.5 > {box[0]} AND col + 0.5 < {box[2]} AND 63.5 - row > {box[1]} AND 63.5 - row < {box[3]})"


_ZONE = f"cast(CASE WHEN {_within(TWO)} THEN 2 WHEN {_within(ONE)} AND NOT {_within(HOLE)} THEN 1 END AS integer)"


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.domain(spark, GRID)
    return zones.rasterize_zones(cells, zones.zone_table(spark, ZONES), GRID)


@query("zone_raster", f"{POINTS} SELECT cell, {_ZONE} AS zone_id FROM d")
def zone_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zoned(spark, sf_dir).select("cell", "zone_id")


_ZONE_COUNTS = ", ".join(f"count(*) FILTER (WHERE code = {c.code}) AS n_{c.code}" for c in CLASSES)


def _acres(codes: list[int], name: str) -> str:
    total = " + ".join(f"coalesce(n_{c}, 0)" for c in codes)
    return f"({total}) * {1.0 / 4046.8564224!r}::double AS {name}"


@query(
    "zone_summary",
    f"""{GRADIENT}, {FLAGSHIP.removeprefix(POINTS).lstrip(", ")}, y AS (SELECT d.cell, {_ZONE.replace("col +", "d.col +").replace("- row", "- d.row")} AS zone_id,
  CASE WHEN top IS NULL OR dem IS NULL THEN 0 WHEN chm >= 5 THEN 4 WHEN chm >= 2 THEN 3 WHEN chm >= 0.5 THEN 2 ELSE 1 END AS code, {_SLOPE} AS slope
  FROM d JOIN k USING (cell) LEFT JOIN g USING (cell) LEFT JOIN t USING (cell) JOIN q USING (cell)),
m AS (SELECT zone_id, count(*) AS cells, avg(slope) AS slope, {_ZONE_COUNTS} FROM y WHERE zone_id IS NOT NULL GROUP BY zone_id),
i(zone_id, name) AS (VALUES (1, 'One'), (2, 'Two'), (3, 'Away'))
SELECT cast(i.zone_id AS integer) AS zone_id, name, coalesce(cells, 0) AS cells, coalesce(cells, 0) * {1.0 / 4046.8564224!r}::double AS total_acres, {_acres([2, 3, 4], 'woody_acres')}, {_acres([2, 3], 'treatment_acres')},
  floor(slope * 1e6 + 0.5) / 1e6 AS mean_slope_deg, {", ".join(_acres([c.code], f"{c.key}_acres") for c in CLASSES)} FROM i LEFT JOIN m ON i.zone_id = m.zone_id""",
)
def zone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    slopes = gradient(spark, sf_dir).select("cell", terrain.slope_degrees().alias("slope"))
    cells = zoned(spark, sf_dir).join(flagship(spark, sf_dir).select("cell", "code"), "cell").join(slopes, "cell")
    found = zones.summarize_zones(cells, zones.zone_table(spark, ZONES), CLASSES, GRID)
    return found.withColumn("mean_slope_deg", micro(F.col("mean_slope_deg")))


@query("zone_rollup", f"{POINTS}, y AS (SELECT {_ZONE} AS zone_id FROM d) SELECT zone_id, count(*) AS cells FROM y WHERE zone_id IS NOT NULL GROUP BY ROLLUP (zone_id)")
def zone_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.zone_totals(zoned(spark, sf_dir))


@query("zone_label_places", f"{POINTS}, y AS (SELECT row, col, {_ZONE} AS zone_id FROM d) SELECT zone_id, avg(row)::double AS row, avg(col)::double AS col FROM y WHERE zone_id IS NOT NULL GROUP BY zone_id")
def zone_label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.label_places(zoned(spark, sf_dir))


@query("block_max", f"{SURFACE} SELECT cast(row // 4 AS integer) AS row, cast(col // 4 AS integer) AS col, max(v) AS v FROM s GROUP BY ALL")
def block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.block_max(surface(spark, sf_dir), 4)


BBOX = (0.0, 0.0, 2.0, 2.0)
_TILES = """t AS (SELECT event_type AS project, cast(event_id AS varchar) || '.laz' AS filename, event_id % 1000 + 1 AS size_bytes, strftime(ts, '%Y-%m-%d') AS date,
  (user_id % 30) / 10.0::double AS west, (event_id % 30) / 10.0::double AS south, (user_id % 30) / 10.0::double + 0.35::double AS east, (event_id % 30) / 10.0::double + 0.35::double AS north, event_id AS nth FROM events),
n AS (SELECT * FROM t WHERE west <= 2 AND east >= 0 AND south <= 2 AND north >= 0),
l AS (SELECT i AS place, 0.0::double + (i % 11) / 10.0::double * 2.0::double AS lon, 0.0::double + (i // 11) / 10.0::double * 2.0::double AS lat FROM range(121) r(i)),
c AS (SELECT project, count(DISTINCT place) / 121.0::double AS share FROM n JOIN l ON lon >= west AND lon <= east AND lat >= south AND lat <= north GROUP BY project)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as catalogue rows."""
    found = spark.read.parquet(f"{sf_dir}/events.parquet")
    west, south = (F.col("user_id") % 30) / 10.0, (F.col("event_id") % 30) / 10.0
    return found.select(
        F.col("event_type").alias("project"),
        F.concat(F.col("event_id").cast("string"), F.lit(".laz")).alias("filename"),
        (F.col("event_id") % 1000 + 1).alias("size_bytes"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        west.alias("west"),
        south.alias("south"),
        (west + 0.35).alias("east"),
        (south + 0.35).alias("north"),
        F.col("event_id").alias("nth"),
    )


@query("tile_coverage", f"WITH {_TILES} SELECT project, share FROM c")
def tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.coverage(tiles(spark, sf_dir), BBOX, ["project"])


@query("tile_totals", f"WITH {_TILES} SELECT project, max(date) AS newest, cast(sum(size_bytes) AS bigint) AS total_bytes, count(*) AS tiles FROM t GROUP BY project")
def tile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.totals_by_project(tiles(spark, sf_dir))


@query(
    "tile_select",
    f"""WITH {_TILES}, r AS (SELECT project, coalesce(any_value(share), 0) AS share, max(date) AS newest, sum(size_bytes) AS total, min(nth) AS seen FROM n LEFT JOIN c USING (project) GROUP BY project),
b AS (SELECT project, share FROM r ORDER BY CASE WHEN share >= 0.999 THEN 1.0 ELSE share END DESC, newest DESC, total, seen LIMIT 1)
SELECT n.project, filename, b.share FROM n JOIN b USING (project)""",
)
def tile_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.select_tiles(tiles(spark, sf_dir), BBOX).select("project", "filename", "share")


_ERRORS = f"{SURFACE}, x AS (SELECT p.z_mm - s.v AS e FROM p JOIN s USING (cell) WHERE p.cls NOT IN (7, 18))"


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.with_cell(points(spark, sf_dir).where(~noise_mask()), GRID)
    return found.join(surface(spark, sf_dir).select("cell", "v"), "cell").select((F.col("z") - F.col("v")).alias("e"))


@query("rmse", f"{_ERRORS} SELECT floor(sqrt(sum(e * e) / count(*)) * 1e6 + 0.5) / 1e6 AS rmse FROM x")
def rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors(spark, sf_dir).agg(micro(validation.rmse(F.col("e"))).alias("rmse"))


@query("median_p95", f"{_ERRORS} SELECT median(e) AS median, floor(quantile_cont(e, 0.95) * 1e3 + 0.5) / 1e3 AS p95 FROM x")
def median_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle, tail = validation.middle_and_tail("e")
    return errors(spark, sf_dir).agg(middle.alias("median"), (F.floor(tail * 1e3 + 0.5) / 1e3).alias("p95"))


@query(
    "site_stats",
    f"""{GRADIENT}, {FLAGSHIP.removeprefix(POINTS).lstrip(", ")} SELECT (SELECT count(*) FROM p) AS points_total, (SELECT count(*) FROM p WHERE cls IN (7, 18)) AS points_noise, (SELECT count(*) FROM p WHERE cls = 2) AS points_ground,
(SELECT min(v) FROM s) AS low, (SELECT max(v) FROM s) AS high, (SELECT max(v) - min(v) FROM s) AS relief_m, floor(avg({_SLOPE}) * 1e6 + 0.5) / 1e6 AS mean_slope_deg,
(SELECT count(*) FROM p WHERE cls NOT IN (7, 18)) / 4096.0::double AS point_density_per_m2, (SELECT count(*) FROM p WHERE cls = 2) / 4096.0::double AS ground_density_per_m2, (SELECT string_agg(name, ',' ORDER BY code) FROM a WHERE treatment) AS treatment_classes,
(SELECT floor(sum(CASE WHEN woody THEN cells * 1.0::double / 4046.8564224::double END) * 1e6 + 0.5) / 1e6 FROM a) AS woody_acres, 0::bigint AS channel_reaches FROM q""",
)
def site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole set of scalars those that the lattice and its points determine."""
    nothing = {"chm": F.lit(0.0), "acc": F.lit(1).cast("long"), "sink_depth": F.lit(0.0), "stream_order": F.lit(0)}
    cells = gradient(spark, sf_dir).withColumn("slope", terrain.slope_degrees()).withColumnRenamed("v", "dem").withColumns(nothing)
    cloud = points(spark, sf_dir).withColumn("is_ground", F.col("classification") == 2)
    areas = classes.class_areas(flagship(spark, sf_dir), CLASSES, GRID.cell_area_m2)
    reaches = spark.createDataFrame([], "length_m double")
    found = pipeline.site_stats(cloud, cells, reaches, areas, GRID, PipelineParams(), "existing", 0.0)
    return found.select(
        "points_total", "points_noise", "points_ground", F.col("elevation_min_m").alias("low"), F.col("elevation_max_m").alias("high"), "relief_m", micro(F.col("slope_mean_deg")).alias("mean_slope_deg"),
        "point_density_per_m2", "ground_density_per_m2", F.array_join("treatment_classes", ",").alias("treatment_classes"), micro(F.col("woody_acres")).alias("woody_acres"), "channel_reaches",
    )


_SHADES = ", ".join(str([int(c[1 + 2 * i : 3 + 2 * i], 16) / 255.0 for c in terrain.ELEVATION_COLORS]) + f" AS ramp_{name}" for i, name in enumerate(("red", "green", "blue")))


@query(
    "shaded_color",
    f"""{GRADIENT}, sh AS (SELECT q.cell, greatest(0.0::double, least(1.0::double, ({math.sin(_AL)!r}::double - {math.cos(_AL) * math.sin(_AZ)!r}::double * dx - {math.cos(_AL) * math.cos(_AZ)!r}::double * dy) / sqrt(1.0::double + dx * dx + dy * dy))) AS shade FROM q),
t AS (SELECT s.cell, 0.45::double + 0.55::double * shade AS light, (v - min(v) OVER ()) / greatest(max(v) OVER () - min(v) OVER (), 1e-9) * 3 AS share FROM s JOIN sh ON s.cell = sh.cell),
w AS (SELECT *, least(cast(floor(share) AS integer), 2) AS b FROM t), c AS (SELECT {_SHADES})
SELECT cell, """
    + ", ".join(f"floor(greatest(0.0::double, least(1.0::double, (ramp_{n}[b + 1]::double + (ramp_{n}[b + 2]::double - ramp_{n}[b + 1]::double) * (share - b)) * light)) * 1e6 + 0.5) / 1e6 AS {n}" for n in ("red", "green", "blue"))
    + " FROM w, c",
)
def shaded_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = terrain.shaded_color(gradient(spark, sf_dir).withColumn("hillshade", terrain.hillshade(HillshadeParams())), "v")
    return found.select("cell", *(micro(F.col(c)).alias(c) for c in ("red", "green", "blue")))


@query("local_meters", f"{POINTS} SELECT l_orderkey, l_linenumber, (col + 0.5) * 2.0::double AS east_m, (63.5 - row) * 2.0::double AS north_m FROM p")
def local_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets from the south-west corner, of a lattice whose unit is two meters."""
    east, north = Grid(0.0, float(SIDE), 1.0, SIDE, SIDE, None, 2.0).local_meters()
    return points(spark, sf_dir).select("l_orderkey", "l_linenumber", east.alias("east_m"), north.alias("north_m"))


#: Slanted edges, and a triangle as a hole.
SLANTED = ((8.3, 3.1), (55.7, 20.4), (40.2, 58.6), (3.9, 33.2), (8.3, 3.1))
SLANTED_HOLE = ((20.1, 20.2), (35.4, 25.3), (24.6, 40.7), (20.1, 20.2))


def _odd(*rings: tuple[tuple[float, float], ...]) -> str:
    """SQL: whether a cell's center is inside an odd number of rings, by the edges that its line eastward crosses."""
    edges = [(a, b) for ring in rings for a, b in zip(ring, ring[1:], strict=False)]
    crossed = (f"(({y1} > 63.5 - row) <> ({y2} > 63.5 - row) AND col + 0.5 < ({x2 - x1!r}::double) * (63.5 - row - {y1}) / {y2 - y1!r}::double + {x1})::int" for (x1, y1), (x2, y2) in edges)
    return f"({' + '.join(crossed)}) % 2 = 1"


@query("zone_slanted", f"{POINTS} SELECT cell, cast(CASE WHEN {_odd(SLANTED, SLANTED_HOLE)} THEN 1 END AS integer) AS zone_id FROM d")
def zone_slanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = zones.zone_table(spark, [zones.Zone(1, "Slanted", ((SLANTED, SLANTED_HOLE),))])
    return zones.rasterize_zones(raster.domain(spark, GRID), table, GRID).select("cell", "zone_id")


#: A lattice that grows with the points, 64 cells a side for the first 60,000: its queries take the paths of large rasters.
BASE_POINTS = 60_000
GROWING = f"""
WITH RECURSIVE n AS (SELECT 64 * cast(greatest(1, ceil(sqrt(count(*) / {BASE_POINTS}.0::double))) AS bigint) AS side FROM lineitem),
p AS (SELECT (l_suppkey * 17 + l_orderkey) % side AS row, (l_partkey * 31 + l_linenumber * 7) % side AS col, CASE WHEN l_linenumber > 4 THEN 100 * cast(l_quantity AS bigint) ELSE 0 END AS above
      FROM lineitem, n WHERE l_quantity NOT IN (1, 50)),
c AS (SELECT side, unnest(range(side * side)) AS cell FROM n),
s AS (SELECT cell, cell // side AS row, cell % side AS col, side, ((300000 + 20 * (cell % side) + coalesce(above, 0)) * 1048576 + (cell * 1237 + 11) % 1048576)::double AS v
      FROM c LEFT JOIN (SELECT row, col, min(above) AS above FROM p GROUP BY row, col) q ON q.row = cell // side AND q.col = cell % side)"""


def growing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """Lowest returns over the growing lattice, a plane where there are none, without ties; and its grid."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = SIDE * max(1, math.ceil(math.sqrt(lines.count() / BASE_POINTS)))
    grid = Grid(0.0, float(side), 1.0, side, side, "EPSG:32631")
    col, row = (F.col("l_partkey") * 31 + F.col("l_linenumber") * 7) % side, (F.col("l_suppkey") * 17 + F.col("l_orderkey")) % side
    above = F.when(F.col("l_linenumber") > 4, 100 * F.col("l_quantity").cast("long")).otherwise(0)
    cloud = lines.where("l_quantity NOT IN (1, 50)").select((col + 0.5).alias("x"), (F.lit(side - 0.5) - row).alias("y"), above.cast("double").alias("z"))
    lowest = raster.cell_statistic(cloud, grid, "min")
    height = F.lit(300000) + 20 * F.col("col") + F.coalesce("v", F.lit(0.0))
    return lowest.withColumn("v", height * 1048576 + (F.col("cell") * 1237 + 11) % 1048576), grid


def growing_flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    cells, grid = growing(spark, sf_dir)
    found = hydrology.flow_direction(cells, grid, "v", res_m=RES_MM)
    return found.withColumn("downstream", hydrology.downstream(grid)), grid


_AROUND = [(name, r, c) for _, name, r, c in hydrology.DIRECTIONS]
_NEAR = f"b AS (SELECT s.*, {', '.join(f'j_{k}.v AS {k}' for k, *_ in _AROUND)} FROM s {' '.join(f'LEFT JOIN s j_{k} ON j_{k}.row = s.row + {r} AND j_{k}.col = s.col + {c}' for k, r, c in _AROUND)})"
_FALLS = {k: f"(v - {k}) / {RES_MM * (math.sqrt(2.0) if r and c else 1.0)!r}::double" for k, r, c in _AROUND}
_STEEPEST = f"greatest({', '.join(_FALLS.values())})"
GROWING_FLOW = (
    f"{GROWING}, {_NEAR}, e AS (SELECT cell, CASE WHEN row IN (0, side - 1) OR col IN (0, side - 1) OR NOT {_STEEPEST} > 0 THEN NULL "
    + " ".join(f"WHEN {_FALLS[k]} = {_STEEPEST} THEN cell + {r} * side + {c}" for k, r, c in _AROUND)
    + " END AS downstream FROM b), w(place, from_cell) AS (SELECT cell, cell FROM e UNION ALL SELECT e.downstream, w.from_cell FROM w JOIN e ON w.place = e.cell WHERE e.downstream IS NOT NULL)"
)


@query("growing_flow_accum", f"{GROWING_FLOW} SELECT place AS cell, count(*) AS acc FROM w GROUP BY place")
def growing_flow_accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = growing_flow(spark, sf_dir)
    return hydrology.flow_accumulation(cells, small=0)


@query("growing_opening", f"{GROWING}, {_box_sql('s', 'o1', True, 4)}, {_box_sql('o1', 'o2', False, 4)} SELECT cell, v FROM o2")
def growing_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.opening(growing(spark, sf_dir)[0], 9).select("cell", "v")


@query("growing_depressions")
def growing_depressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tiles; tests hold them against a sequential flood."""
    cells, grid = growing(spark, sf_dir)
    return fill.fill_depressions(cells, grid, "v", side=64).select("cell", "filled")


@query("growing_voids")
def growing_voids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tiles, of a raster of which every seventh column and a margin are void."""
    cells, grid = growing(spark, sf_dir)
    holed = cells.withColumn("v", F.when((F.col("col") % 7 != 3) & (F.col("row") >= 8), F.col("v") / 1048576))
    return fill.fill_voids(holed, grid, whole=0, side=64, depth=32, max_iter=64).select("cell", "v")


@query("growing_strahler")
def growing_strahler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In rounds of jobs; ``strahler_rounds`` has the SQL."""
    cells, _ = growing_flow(spark, sf_dir)
    cells = cells.select("cell", "downstream")
    stream = hydrology.streams(cells.join(hydrology.flow_accumulation(cells, small=0), "cell"), LIMIT)
    return hydrology.strahler_orders(stream, small=0)
