"""Filling: voids by relaxation, depressions by flooding.

Both are fixpoints over neighbourhoods, solved tile by tile.  Relaxation takes
many sweeps at once in tiles that know as many cells around them.  In flooding, a
tile solves itself given its neighbours' border values, and is solved again only
when those change; what is written in a round is borders alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputDataError
from ..lineage import cut
from ..model import Grid

#: Rasters of at most so many cells are filled within one task.
WHOLE = 1_000_000
STEPS8 = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def _neighbours(grid: Grid) -> F.Column:
    """The cells around (row, col) that are in the grid."""
    around = [F.when(((F.col("row") + r) >= 0) & ((F.col("row") + r) < grid.height) & ((F.col("col") + c) >= 0) & ((F.col("col") + c) < grid.width), (F.col("row") + r).cast("long") * grid.width + F.col("col") + c) for r, c in STEPS8]
    return F.array_compact(F.array(*around))


def _nearest(values: np.ndarray) -> np.ndarray:
    """Each null place's nearest value (of equally near ones, the first by row, then column): a column pass, then a row pass."""
    height, width = values.shape
    known = ~np.isnan(values)
    rows = np.arange(height)[:, None]
    above = np.maximum.accumulate(np.where(known, rows, -1), axis=0)
    below = np.minimum.accumulate(np.where(known, rows, height * 4)[::-1], axis=0)[::-1]
    far = 1e15
    up, down = np.where(above >= 0, (rows - above) ** 2.0, far), np.where(below < height, (below - rows) ** 2.0, far)
    nearest = np.where(up <= down, above, below)
    apart, out, cols = np.minimum(up, down), values.copy(), np.arange(width)
    for i in np.flatnonzero(~known.all(axis=1)):
        holes = np.flatnonzero(~known[i])
        best = (apart[i][None, :] + (holes[:, None] - cols) ** 2.0).argmin(axis=1)
        out[i, holes] = values[nearest[i, best], best]
    return out


def _filled_whole(frame: pd.DataFrame, grid: Grid, max_iter: int, tolerance: float) -> pd.DataFrame:
    """All voids of a raster that one task can hold."""
    values = np.full(grid.shape, np.nan)
    values[frame["row"].to_numpy(), frame["col"].to_numpy()] = frame["v"].to_numpy(float)
    i, j = np.nonzero(np.isnan(values))
    values = _nearest(values)
    sides = [(np.maximum(i - 1, 0), j), (np.minimum(i + 1, grid.height - 1), j), (i, np.maximum(j - 1, 0)), (i, np.minimum(j + 1, grid.width - 1))]
    for _ in range(max_iter):
        after = (values[sides[0]] + values[sides[1]] + values[sides[2]] + values[sides[3]]) / 4.0
        change = np.abs(after - values[i, j]).max()
        values[i, j] = after
        if change < tolerance:
            break
    return pd.DataFrame({"cell": i.astype(np.int64) * grid.width + j, "v": values[i, j]})


def _envelope(cols: np.ndarray, apart: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place of a row, which column is the nearest: squared distances ``apart`` within the columns, first ones on ties.

    Each column's distance over the row is a parabola; the least of them is the
    lower envelope, found from left to right.
    """
    stack: list[int] = []
    since: list[int] = []  # the first place at which each of the stack is nearer than those before it
    for q, (c, d) in enumerate(zip(cols.tolist(), apart.tolist(), strict=True)):
        begin = -1
        while stack:
            v = stack[-1]
            begin = ((d + c * c) - (int(apart[v]) + int(cols[v]) ** 2)) // (2 * (c - int(cols[v]))) + 1
            if begin > since[-1]:
                break
            stack.pop()
            since.pop()
            begin = -1
        stack.append(q)
        since.append(begin)
    return np.array(stack)[np.searchsorted(since, places, side="right") - 1]


def _started(kept: DataFrame, grid: Grid) -> DataFrame:
    """(cell, v) of each void cell of (cell, row, col, v): its nearest value, by a column pass and then a row pass."""
    down = Window.partitionBy("col").orderBy("row")
    known = F.when(F.col("v").isNotNull(), F.struct("row", "v"))
    above = F.last(known, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.first(known, ignorenulls=True).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    columns = kept.withColumn("_a", above).withColumn("_b", below)
    up, under = F.pow(F.col("row") - F.col("_a.row"), 2), F.pow(F.col("_b.row") - F.col("row"), 2)
    first = F.col("_b").isNull() | (up <= under)
    columns = columns.withColumn("near", F.when(first, F.col("_a.v")).otherwise(F.col("_b.v"))).withColumn("apart", F.when(first, up).otherwise(under).cast("long"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        holes = np.sort(frame.loc[frame["v"].isna(), "col"].to_numpy(np.int64))
        offered = frame[frame["apart"].notna()].sort_values("col")
        nearest = _envelope(offered["col"].to_numpy(np.int64), offered["apart"].to_numpy(np.int64), holes)
        return pd.DataFrame({"cell": int(key[0]) * grid.width + holes, "v": offered["near"].to_numpy(float)[nearest]})

    rows = columns.where("v IS NULL").select("row").distinct()
    return columns.join(rows, "row").select("row", "col", "v", "near", "apart").groupBy("row").applyInPandas(run, "cell long, v double")


def _dealt(cells: DataFrame, grid: Grid, side: int, halo: int) -> DataFrame:
    """``cells`` dealt to tiles (tr, tc) of ``side`` cells and, not as their own, to those within ``halo`` cells."""
    steps = sorted({-halo, 0, halo})
    spots = [F.struct(F.floor((F.col("row") + r) / side).cast("int").alias("tr"), F.floor((F.col("col") + c) / side).cast("int").alias("tc")) for r in steps for c in steps]
    out = cells.withColumn("_t", F.explode(F.array_distinct(F.array(*spots)))).select(*cells.columns, "_t.tr", "_t.tc")
    out = out.where((F.col("tr") >= 0) & (F.col("tr") <= (grid.height - 1) // side) & (F.col("tc") >= 0) & (F.col("tc") <= (grid.width - 1) // side))
    return out.withColumn("own", (F.floor(F.col("row") / side) == F.col("tr")) & (F.floor(F.col("col") / side) == F.col("tc")))


def _swept(sweeps: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A tile's void cells after so many sweeps, and the largest change of each sweep in them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, cols = frame["row"].to_numpy(), frame["col"].to_numpy()
        r0, c0 = rows.min(), cols.min()
        values = np.zeros((rows.max() - r0 + 1, cols.max() - c0 + 1))
        void, ours = np.zeros(values.shape, bool), np.zeros(values.shape, bool)
        values[rows - r0, cols - c0] = frame["v"].to_numpy(float)
        void[rows - r0, cols - c0] = frame["void"].to_numpy(bool)
        ours[rows - r0, cols - c0] = (frame["own"] & frame["void"]).to_numpy(bool)
        i, j = np.nonzero(void)
        own = ours[i, j]
        up, down = np.maximum(i - 1, 0), np.minimum(i + 1, values.shape[0] - 1)  # beyond the edge, the cell itself
        left, right = np.maximum(j - 1, 0), np.minimum(j + 1, values.shape[1] - 1)
        changes = []
        for _ in range(sweeps):
            after = (values[up, j] + values[down, j] + values[i, left] + values[i, right]) / 4.0
            changes.append(float(np.abs(after - values[i, j])[own].max(initial=0.0)))
            values[i, j] = after
        mine = (frame["own"] & frame["void"]).to_numpy(bool)
        found = pd.DataFrame({"cell": frame["cell"].to_numpy()[mine], "v": values[rows[mine] - r0, cols[mine] - c0]}).astype({"cell": "Int64"})
        rounds = pd.DataFrame({"sweep": range(1, sweeps + 1), "change": changes}).astype({"sweep": "Int64"})
        return pd.concat([found, rounds]).reindex(columns=["cell", "v", "sweep", "change"])

    return run


def fill_voids(cells: DataFrame, grid: Grid, value: str = "v", max_iter: int = 400, tolerance: float = 1e-4, whole: int | None = None, side: int = 512, depth: int = 64) -> DataFrame:
    """``cells`` (cell, row, col, value, ...) with every null value filled.

    A void starts from its nearest values and is averaged over its four
    neighbours, the edge replicated, until the largest change of a sweep is below
    the tolerance.  Without voids the table comes back as it is.  All void is an
    error.  Rasters of at most ``whole`` cells (``WHOLE`` without) take one task;
    of others, tiles with voids take ``depth`` sweeps at a time.
    """
    n_void, n_all = cells.agg(F.count_if(F.col(value).isNull()), F.count("*")).first()
    if not n_void:
        return cells
    if n_void == n_all:
        raise InputDataError("every cell is void; there is nothing to fill from")
    kept = cells.select("cell", "row", "col", F.col(value).cast("double").alias("v"))
    if n_all <= (WHOLE if whole is None else whole):
        one = kept.withColumn("_all", F.lit(0)).groupBy("_all")
        filled = one.applyInPandas(lambda frame: _filled_whole(frame, grid, max_iter, tolerance), "cell long, v double")
    else:
        depth = min(depth, side)
        now = cut(_started(kept, grid))
        tiles = kept.where("v IS NULL").select(F.floor(F.col("row") / side).cast("int").alias("tr"), F.floor(F.col("col") / side).cast("int").alias("tc")).distinct()
        dealt = _dealt(kept.withColumnRenamed("v", "given").withColumn("void", F.col("given").isNull()), grid, side, depth)
        dealt = cut(dealt.join(tiles, ["tr", "tc"]))

        def swept(sweeps: int) -> DataFrame:
            state = dealt.join(now, "cell", "left").withColumn("v", F.coalesce("given", "v")).drop("given")
            return cut(state.groupBy("tr", "tc").applyInPandas(_swept(sweeps), "cell long, v double, sweep long, change double"))

        left = max_iter
        while left > 0:
            sweeps = min(depth, left)
            found = swept(sweeps)
            changes = found.where("cell IS NULL").groupBy("sweep").agg(F.max("change").alias("change")).where(F.col("change") < tolerance)
            enough = changes.agg(F.min("sweep")).first()[0]
            if enough is not None and enough < sweeps:
                found = swept(int(enough))
            now = found.where("cell IS NOT NULL").select("cell", "v")
            left = 0 if enough is not None else left - sweeps
        filled = now
    return cells.join(filled.withColumnRenamed("v", "_filled"), "cell", "left").withColumn(value, F.coalesce(F.col(value), F.col("_filled"))).drop("_filled")


def _flood(seeded: np.ndarray, z: np.ndarray, water: np.ndarray) -> np.ndarray:
    """Least water surface over ``z`` that falls to a seed or a known value: the queue takes the lowest cell first."""
    height, width = z.shape
    water = water.copy()
    heap = [(float(water[i, j]), i, j) for i, j in zip(*np.nonzero(np.isfinite(water)), strict=True)]
    heapq.heapify(heap)
    while heap:
        level, i, j = heapq.heappop(heap)
        if level > water[i, j]:
            continue
        above = math.nextafter(level, math.inf)
        for di, dj in STEPS8:
            a, b = i + di, j + dj
            if 0 <= a < height and 0 <= b < width and not seeded[a, b]:
                here = z[a, b]
                if not math.isnan(here):
                    new = here if here > level else above
                    if new < water[a, b]:
                        water[a, b] = new
                        heapq.heappush(heap, (new, a, b))
    return water


def _tile(side: int, borders: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A tile's own water surface, or that of the cells along its border alone, given what is known around it."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * side - 1, int(key[1]) * side - 1
        z = np.full((side + 2, side + 2), np.nan)
        water = np.full((side + 2, side + 2), np.inf)
        seeded = np.ones((side + 2, side + 2), bool)
        r, c = frame["row"].to_numpy() - r0, frame["col"].to_numpy() - c0
        own = frame["own"].to_numpy(bool)
        z[r, c] = frame["z"].to_numpy(float)
        w = frame["w"].to_numpy(float)
        water[r, c] = np.where(np.isnan(w), np.inf, w)  # not reached yet, or no data
        seeded[r, c] = ~own | frame["seed"].to_numpy(bool)  # the halo is known, not solved
        solved = _flood(seeded, z, water)
        i = np.flatnonzero(own & ((r == 1) | (r == side) | (c == 1) | (c == side)) if borders else own)
        return pd.DataFrame({"cell": frame["cell"].to_numpy()[i], "row": frame["row"].to_numpy()[i], "col": frame["col"].to_numpy()[i], "w": solved[r[i], c[i]]})

    return run


def fill_depressions(cells: DataFrame, grid: Grid, value: str = "dem", into: str = "filled", side: int = 512) -> DataFrame:
    """Adds the surface on which every cell falls to an outlet: border cells and cells beside no data.

    A cell that must rise is raised to the next float above its lowest
    neighbour, so that flats keep a direction.  No data stays so.  Tiles of
    ``side`` cells are solved apart and pass on the water along their borders; a
    tile is solved again when that around it falls, and at the end once for all
    its cells.  One tile is the sequential priority flood.
    """
    kept = cells.select("cell", "row", "col", F.col(value).alias("z"))
    nothing = kept.where("z IS NULL").withColumn("near", _neighbours(grid)).select(F.explode("near").alias("cell")).distinct().withColumn("beside", F.lit(True))
    border = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == grid.height - 1) | (F.col("col") == grid.width - 1)
    seeded = kept.join(nothing, "cell", "left").withColumn("seed", F.col("z").isNotNull() & (border | F.coalesce("beside", F.lit(False))))
    dealt = cut(_dealt(seeded.select("cell", "row", "col", "z", "seed"), grid, side, 1))
    given = F.when(F.col("seed"), F.col("z"))
    schema = "cell long, row int, col int, w double"
    known = None  # (cell, row, col, w) of the cells along the tiles' borders
    waiting = None if max(grid.shape) > side else dealt.select("tr", "tc").limit(0)

    def state(rows: DataFrame) -> DataFrame:
        if known is None:
            return rows.withColumn("w", given)
        around = known.select("cell", F.col("w").alias("_w"))
        return rows.join(around, "cell", "left").withColumn("w", F.when(F.col("own"), given).otherwise(F.coalesce("_w", given))).drop("_w")

    while waiting is None or not waiting.isEmpty():
        some = dealt if waiting is None else dealt.join(waiting, ["tr", "tc"])
        solved = cut(state(some).groupBy("tr", "tc").applyInPandas(_tile(side, True), schema))
        if known is None:
            known = fallen = solved
        else:
            fallen = cut(solved.join(known.select("cell", F.col("w").alias("before")), "cell").where("w < before").drop("before"))
            known = cut(known.join(fallen.select("cell", F.col("w").alias("after")), "cell", "left").withColumn("w", F.coalesce("after", "w")).drop("after"))
        reached = fallen.where(F.col("w") < float("inf")).select("row", "col")
        waiting = cut(_dealt(reached, grid, side, 1).where("NOT own").select("tr", "tc").distinct())
    whole = state(dealt).groupBy("tr", "tc").applyInPandas(_tile(side, False), schema)
    return cells.join(whole.select("cell", F.when(F.col("w") < float("inf"), F.col("w")).alias(into)), "cell", "left")
