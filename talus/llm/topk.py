"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

A block of vectors keeps, for each dimension, its rows in order of that
component.  A query goes down each list from the end that its sign favours.  The
sum of its products with the values reached bounds every row not yet met; once
that bound is below the kth score of the rows met, no such row can enter the
result.  How deep that is, is found for many queries at once.  Where the lists
would meet before that, as in many dimensions, all rows are met, and are scored
in storage order.

Scores are exact whole numbers: floating-point products only where no partial sum
can reach 2^53, else 64-bit ones, and beyond those numbers without a bound.

Scale: rows that repeat are one with a count.  A block's rows come to one task,
where its lists are built once; then the queries stream past them in batches.  A
task returns k rows a query, and ranks are taken over those.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, SCALE = 20, 64
#: Components that a block holds: no less than the first while there are tasks for every core, no more than the second.
SMALL, LARGE, TASKS = 1 << 19, 1 << 22, 4
#: Scores that are held at once; rows whose scores tell where a query may stop.
HELD, SEEN = 1 << 22, 512


class Lists:
    """A block's vectors of whole numbers and, for each dimension, its rows and values from least to greatest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.ids, self.vectors = ids, vectors
        self.counts = np.ones(len(ids), np.int64) if counts is None else counts
        order = np.argsort(vectors, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T)
        self.most = max(map(abs, (self.values[:, 0].min(), self.values[:, -1].max()))) if vectors.size else 0

    def exact(self, queries: np.ndarray) -> tuple[Lists, np.ndarray]:
        """These lists and the queries in a type whose sums of products are exact."""
        most = int(self.most) * int(np.abs(queries).max() if queries.size else 0) * max(1, queries.shape[1])
        kind = np.dtype(float) if most < 1 << 53 else np.dtype(np.int64) if most < 1 << 63 else np.dtype(object)
        if kind == self.vectors.dtype:
            return self, queries.astype(kind)
        other = Lists.__new__(Lists)
        other.ids, other.order, other.most, other.counts = self.ids, self.order, self.most, self.counts
        other.vectors, other.values = _whole(self.vectors, kind), _whole(self.values, kind)
        return other, _whole(queries, kind)

    def reach(self, queries: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """For each query and depth, the most that a row can score that is not among the first so many of any list."""
        n, up = len(self.ids), np.where(queries > 0, queries, 0)
        return up @ self.values[:, n - 1 - depths] + (queries - up) @ self.values[:, depths]

    def met(self, query: np.ndarray, depth: int) -> np.ndarray:
        """The rows among the first ``depth`` of a list that the query goes down."""
        n, found = len(self.ids), np.zeros(len(self.ids), bool)
        found[self.order[query > 0, n - depth :]] = True
        found[self.order[query < 0, :depth]] = True
        return np.flatnonzero(found)

    def first(self, scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Places of the best scores that hold k rows, repeated ones counted; ties to the smaller id."""
        places = np.arange(len(rows))
        if len(rows) > 4 * k:
            places = np.flatnonzero(scores >= np.partition(scores, len(rows) - k)[len(rows) - k])
        order = places[np.lexsort((-self.ids[rows[places]], scores[places]))[::-1]]
        before = np.cumsum(self.counts[rows[order]]) - self.counts[rows[order]]
        return order[before < k]

    def stops(self, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """The depth at which each query's bound is below its kth score, by the scores of a few rows; -1 where the lists meet first."""
        n = len(self.ids)
        out = np.full(len(queries), -1)
        some = np.unique(np.linspace(0, n - 1, min(n, max(SEEN, 8 * k))).astype(int))
        if len(some) <= k or queries.dtype == object:
            return out
        scores = queries @ self.vectors[some].T
        scores[some == own[:, None]] = -np.inf if scores.dtype == float else np.iinfo(np.int64).min
        kth = np.partition(scores, len(some) - k, axis=1)[:, len(some) - k]
        width = np.maximum(1, np.count_nonzero(queries, axis=1))
        depths = np.unique(np.geomspace(1, n, 64).astype(int))
        depths = depths[depths * width.min() < n]
        # A row not met could tie with the kth and have a smaller id, so the bound has to be below it.
        enough = (self.reach(queries, depths) < kth[:, None]) & (depths * width[:, None] < n)
        return np.where(enough.any(axis=1), depths[enough.argmax(axis=1)] if len(depths) else -1, -1)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
        """For each query, the best (score, id, count), which hold its k best; ``own`` is its own row here, or -1."""
        lists, queries = self.exact(queries)
        out: list[list[tuple[int, int, int]]] = [[] for _ in queries]

        def put(i: int, scores: np.ndarray, rows: np.ndarray) -> None:
            # One more, as its own row may be among them; of one that repeats, the other copies stay.
            best = self.first(scores, rows, k + 1)
            found = [(int(scores[b]), int(rows[b])) for b in best]
            out[i] = [(s, int(self.ids[r]), n) for s, r in found if (n := int(self.counts[r]) - int(r == own[i]))]

        depth = lists.stops(queries, own, k)
        for i in np.flatnonzero(depth >= 0).tolist():
            rows = lists.met(queries[i], depth[i])
            put(i, lists.vectors[rows] @ queries[i], rows)
        rest, step, rows = np.flatnonzero(depth < 0), max(1, HELD // max(1, len(self.ids))), np.arange(len(self.ids))
        for lo in range(0, len(rest), step):
            part = rest[lo : lo + step]
            for i, scores in zip(part.tolist(), _long(queries[part] @ lists.vectors.T), strict=True):
                put(i, scores, rows)
        return out


def _long(scores: np.ndarray) -> np.ndarray:
    """Scores without a bound as longs, those beyond their range as its ends."""
    return scores if scores.dtype != object else np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _whole(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    if kind != np.dtype(object) or values.dtype == kind:
        return values.astype(kind)
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


def _matrix(column: pd.Series, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors, a row each; missing components are 0."""
    out = np.zeros((len(column), width))
    if len(column) and (column.map(len) == width).all():
        out = np.array(column.tolist(), float).reshape(len(column), width)
    else:
        for i, v in enumerate(column):
            out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        found = np.floor(out * scale)
    if np.abs(out).max(initial=0.0) >= 2.0**46:  # not every whole number of that size is a float
        exact = [[int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale) for x in row] for row in out.tolist()]
        most = max(abs(x) for row in exact for x in row)
        return np.array(exact, np.int64 if most < 1 << 62 else object).reshape(out.shape)
    return found


def _search(k: int, scale: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From rows sorted by block, each block's vectors before its queries, the best rows of each block for each query."""

    def answers(asked: pd.DataFrame, lists: Lists, rid: np.ndarray, width: int) -> pd.DataFrame:
        place = np.minimum(np.searchsorted(rid, asked["rid"].to_numpy()), len(rid) - 1)
        own = np.where(rid[place] == asked["rid"].to_numpy(), place, -1)
        queries = _matrix(asked["v"].map(lambda v: v[:width]), width, scale)
        rows = [(q, r, i, s, n) for q, r, found in zip(asked["vec_id"].tolist(), asked["rid"].tolist(), lists.top(queries, own, k), strict=True) for s, i, n in found if n > 0]
        return pd.DataFrame(rows, columns=["query_id", "rid", "vec_id", "score", "n"]).astype("int64")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, lists, rid, width = None, [], None, np.empty(0, np.int64), 0
        for frame in frames:
            for key, part in frame.groupby(["block", "asks"], sort=False):
                if key[0] != block:
                    block, held, lists = key[0], [], None
                if not key[1]:
                    held.append(part)
                    continue
                if lists is None:
                    if not held:
                        continue  # a block without vectors
                    rows = pd.concat(held, ignore_index=True).sort_values("rid")
                    held, rid, width = [], rows["rid"].to_numpy(), int(rows["v"].map(len).max())
                    lists = Lists(rows["vec_id"].to_numpy(), _matrix(rows["v"], width, scale), rows["copies"].to_numpy())
                for lo in range(0, len(part), 1024):
                    yield answers(part.iloc[lo : lo + 1024], lists, rid, width)

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = 20, scale: int = SCALE) -> DataFrame:
    """The k highest integer inner products of each query with every row but its own.

    vectors: vec_id, embedding (numbers); other columns play no part.  Components
    become floor(scale * x).  Queries are rows whose vec_id is divisible by
    ``every``.  Result: query_id, rank (from 1), vec_id, score; ties to the
    smaller vec_id; all rows, if there are fewer than k.

    Rows without id or vector, and vectors with null or non-finite components,
    take no part.  Rows that repeat are rows each: as candidates, also of each
    other, and as queries.  Missing components of shorter vectors count as 0.  A
    score beyond the range of a long counts as that range's end.  An empty table
    gives no rows.
    """
    kind = vectors.schema["embedding"].dataType
    single = kind.simpleString() == "array<float>"
    valid = F.expr("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    value = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    # Grouped by the vector itself: equal hashes are no proof.
    rows = vectors.where(valid).select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    whole = cut(rows).withColumn("rid", F.monotonically_increasing_id())  # of a table that is written, so it stays the same
    n, width = whole.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    size = n * max(1, width)
    blocks = max(1, math.ceil(size / LARGE), min(math.ceil(size / SMALL), TASKS * cores))
    queries = whole.where(F.col("vec_id") % every == 0)
    placed = whole.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(0))
    sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(1))
    both = placed.unionByName(sent).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks")
    found = both.mapInPandas(_search(k, scale), "query_id long, rid long, vec_id long, score long, n long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = found.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") - F.col("n") < k)
    each = ranked.withColumn("rank", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.least(F.col("upto"), F.lit(k).cast("long")))))
    repeats = queries.where("copies > 1").select("rid", "copies")
    out = each.join(repeats, "rid", "left").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
