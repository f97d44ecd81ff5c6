"""Forests of cells: pointer doubling, accumulation and roots, in a logarithmic number of rounds.

A round is a job, so graphs of at most ``SMALL`` rows, by a count of them, are
solved by the same rounds within one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

SMALL = 500_000


def _in_one_task(rows: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda frame: solve(frame.drop(columns="_all")), schema)


def _places(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each node's place in order of the nodes, and the place of its next, -1 without one."""
    order = np.argsort(frame["node"].to_numpy())
    node = frame["node"].to_numpy()[order]
    following = frame["next"].to_numpy(float, na_value=np.nan)[order]
    after = np.searchsorted(node, np.nan_to_num(following).astype(np.int64))
    return order, np.where(np.isnan(following), -1, after)


def _accumulated(frame: pd.DataFrame) -> pd.DataFrame:
    order, after = _places(frame)
    acc = frame["acc"].to_numpy()[order]
    while (after >= 0).any():
        moving = np.flatnonzero(after >= 0)
        gained = acc.copy()
        np.add.at(gained, after[moving], acc[moving])
        acc, after = gained, np.where(after >= 0, after[after], -1)
    return pd.DataFrame({"node": frame["node"].to_numpy()[order], "acc": acc})


def _rooted(frame: pd.DataFrame) -> pd.DataFrame:
    order, after = _places(frame)
    node = frame["node"].to_numpy()[order]
    at = np.where(after >= 0, after, np.arange(len(node)))
    while (at[at] != at).any():
        at = at[at]
    return pd.DataFrame({"node": node, "root": node[at]})


def _ranked(frame: pd.DataFrame) -> pd.DataFrame:
    order, after = _places(frame)
    rank, alive = np.ones(len(after), np.int64), np.ones(len(after), bool)
    while True:
        coming = after[alive & (after >= 0)]
        reached, at = np.bincount(coming, minlength=len(after)) >= 2, after
        while (at >= 0).any():  # what lies below a meeting
            moving = np.flatnonzero(at >= 0)
            further = reached.copy()
            np.logical_or.at(further, at[moving], reached[moving])
            reached, at = further, np.where(at >= 0, at[at], -1)
        if not reached.any():
            return pd.DataFrame({"node": frame["node"].to_numpy()[order], "rank": rank})
        rank += reached
        alive = reached


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    node, ends = np.unique(frame[["a", "b"]].to_numpy(), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(node))
    while True:
        lower = label.copy()
        np.minimum.at(lower, a, label[b])
        np.minimum.at(lower, b, label[a])
        lower = lower[lower]
        if (lower == label).all():
            return pd.DataFrame({"node": node, "root": node[label]})
        label = lower


def accumulate(nodes: DataFrame, weight: str = "weight", small: int | None = None) -> DataFrame:
    """(node, acc): each node's weight with that of all nodes that lead to it.

    nodes: node, next (null at a root), weight.  After k rounds ``acc`` covers
    the 2^k nearest steps upstream and ``next`` points 2^k steps on.  ``small``
    is how many rows one task may hold; ``SMALL`` without.
    """
    state = cut(nodes.select("node", "next", F.col(weight).alias("acc")))
    if state.count() <= (SMALL if small is None else small):
        return _in_one_task(state, _accumulated, f"node long, acc {state.schema['acc'].dataType.simpleString()}")
    while True:
        moving = state.where("next IS NOT NULL")
        if moving.isEmpty():
            return state.select("node", "acc")
        gained = moving.groupBy("next").agg(F.sum("acc").alias("gain")).withColumnRenamed("next", "node")
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("after"))
        state = cut(
            state.join(gained, "node", "left")
            .join(ahead, "next", "left")
            .select("node", F.col("after").alias("next"), (F.col("acc") + F.coalesce("gain", F.lit(0))).alias("acc"))
        )


def roots(nodes: DataFrame, small: int | None = None) -> DataFrame:
    """(node, root): where following ``next`` from each node ends.  nodes: node, next (null at a root)."""
    state = cut(nodes.select("node", "next"))
    if state.count() <= (SMALL if small is None else small):
        return _in_one_task(state, _rooted, "node long, root long")
    state = state.select("node", F.coalesce("next", "node").alias("at"))
    while True:
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("after"))
        moved = cut(state.join(ahead, "at").select("node", F.col("after").alias("at"), (F.col("after") != F.col("at")).alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("node", F.col("at").alias("root"))
        state = moved.select("node", "at")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for every node that has an edge.  edges: a, b."""
    edges = cut(edges.select("a", "b"))
    if edges.count() <= SMALL:
        return _in_one_task(edges, _joined, "node long, root long")
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = cut(both.where("u != v").distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        # The least label around, then the label of that label: paths halve each round.
        seen = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = label.join(seen, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("u").alias("label"), F.col("label").alias("further"))
        after = cut(lower.join(jump, "label").select("u", "old", F.least("label", "further").alias("label")))
        label = after.select("u", "label")
        if after.where("old != label").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("label").alias("root"))


def ranks(nodes: DataFrame, small: int | None = None) -> DataFrame:
    """(node, rank): Strahler's order in a forest.  nodes: node, next (null at a root).

    All nodes have rank 1.  Those of rank k and more that lie at or below a place
    where two such come together have rank k + 1, so there is a round for each
    rank, of which there are no more than the logarithm of the nodes.
    """
    alive = cut(nodes.select("node", "next"))
    if alive.count() <= (SMALL if small is None else small):
        return _in_one_task(alive, _ranked, "node long, rank long")
    levels = alive.select("node", F.lit(1).cast("long").alias("rank"))
    for rank in range(2, 65):
        meetings = cut(alive.where("next IS NOT NULL").groupBy("next").count().where("count >= 2").select(F.col("next").alias("node"), F.lit(1).cast("long").alias("weight")))
        if meetings.isEmpty():
            break
        marked = alive.join(meetings, "node", "left").select("node", "next", F.coalesce("weight", F.lit(0)).alias("weight"))
        alive = cut(alive.join(accumulate(marked, small=small).where("acc > 0").select("node"), "node"))
        levels = levels.unionByName(alive.select("node", F.lit(rank).cast("long").alias("rank")))
    return levels.groupBy("node").agg(F.max("rank").alias("rank"))
