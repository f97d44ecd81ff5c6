"""SimHash near-duplicates, linked through the anchor points of a covering code.

Two 64-bit fingerprints that differ in at most three bits differ in at most one
bit of their low 31 bits or of the next 31 bits.  Over 31 bits the words of the
Hamming code of length 31 are anchors: every value lies within radius 1 of one.
A value is sent to each anchor within radius 1 + 1, at most 16 of them, so two
values that differ in one bit meet at the anchor nearest to either.  At an anchor
whole fingerprints are compared.

Scale: texts are read once and leave as eight bytes.  Equal fingerprints are
merged before they are sent, so groups of copies cost nothing.  An anchor gives
the edges of a spanning forest, not its pairs; an anchor with more than
``BLOCK`` fingerprints is compared block against block in tasks of their own.
Components come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .common import cut

THRESHOLD, SHINGLE, SEED, BLOCK, LENGTH = 3, 3, 42, 2048, 31


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 hashes of a text's word shingles in order, repeats included; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(words) - shingle + 1)]
    ends = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 where there are none."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[lo : lo + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit majority of the XXH64 hashes of a text's word shingles; 0 where it has no words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) for every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "text_hash", "fp"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index into ``values`` and anchor, for each value and code word within radius 2 of it."""
    syndrome = np.zeros(len(values), np.int64)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, LENGTH + 1) if i >> j & 1)
        syndrome |= (np.bitwise_count(values & mask).astype(np.int64) & 1) << j
    bit = np.concatenate(([0], 1 << np.arange(LENGTH, dtype=np.int64)))
    rows, words = [np.arange(len(values))], [values ^ bit[syndrome]]
    for i in range(1, LENGTH + 1):
        other = syndrome ^ i
        at = np.flatnonzero((syndrome > 0) & (other > i))
        rows.append(at)
        words.append(values[at] ^ bit[i] ^ bit[other[at]])
    return np.concatenate(rows), np.concatenate(words)


def _replicate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    low = (1 << LENGTH) - 1
    for frame in frames:
        fps = frame["fp"].to_numpy()
        for part in range(2):
            at, words = _anchors((fps >> (part * LENGTH)) & low)
            yield pd.DataFrame({"anchor": words | (part << LENGTH), "fp": fps[at]})


def _forest(left: np.ndarray, right: np.ndarray | None = None, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Edges that connect what links of at most ``threshold`` bits connect: within one block, or across two."""
    nodes = left if right is None else np.concatenate([left, right])
    # Unsigned: bits of a negative number would be counted of its absolute value.
    ours, others = left.view(np.uint64), (left if right is None else right).view(np.uint64)
    label, shift = np.arange(len(nodes)), 0 if right is None else len(left)
    edges: list[tuple[int, int]] = []
    for i, value in enumerate(ours):
        near = np.flatnonzero(np.bitwise_count((others[i + 1 :] if right is None else others) ^ value) <= threshold)
        for j in near + (i + 1 if right is None else shift):
            if label[i] != label[j]:
                edges.append((int(left[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return edges


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of each anchor's rows, which come sorted; blocks of an anchor with several come back for comparison."""
    anchor, held, chunk = None, np.empty(0, np.int64), 0

    def ended(more: bool) -> Iterator[pd.DataFrame]:
        if len(held) > 1 and (edges := _forest(held)):
            yield pd.DataFrame(edges, columns=["a", "b"]).assign(anchor=None, chunk=None)[["a", "b", "anchor", "chunk"]]
        if chunk or more:
            yield pd.DataFrame({"a": held, "b": held, "anchor": anchor, "chunk": chunk})

    for frame in frames:
        keys, fps = frame["anchor"].to_numpy(), frame["fp"].to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        # Alone at its anchor, and neither first nor last of what came: nothing to compare.
        busy = (ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
        for s, e in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True):
            if keys[s] != anchor:
                yield from ended(False)
                anchor, held, chunk = int(keys[s]), np.empty(0, np.int64), 0
            while s < e:
                if len(held) == BLOCK:
                    yield from ended(True)
                    held, chunk = np.empty(0, np.int64), chunk + 1
                took = min(e - s, BLOCK - len(held))
                held, s = np.concatenate([held, fps[s : s + took]]), s + took
    yield from ended(False)


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    first = frame["chunk"].to_numpy() == frame["i"].to_numpy()
    fps = frame["a"].to_numpy()
    return pd.DataFrame(_forest(fps[first], fps[~first]), columns=["a", "b"]).astype("int64")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): edges whose closure is that of all links between the distinct fingerprints."""
    sent = distinct.select("fp").mapInPandas(_replicate, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    found = cut(sent.mapInPandas(_links, "a long, b long, anchor long, chunk long"))
    blocks = found.where("anchor IS NOT NULL")
    several = blocks.groupBy("anchor").agg((F.max("chunk") + 1).alias("n"))
    pairs = (
        blocks.join(several, "anchor")
        .select("anchor", "chunk", "a", F.explode(F.expr("filter(sequence(0L, n - 1), x -> x != chunk)")).alias("other"))
        .select("anchor", "chunk", "a", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    across = pairs.groupBy("anchor", "i", "j").applyInPandas(_across, "a long, b long")
    return found.where("anchor IS NULL").select("a", "b").unionByName(across)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that isn't its component's least one.

    As few edges as one task can hold, by a count of them, take no rounds of jobs.
    """
    kept = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    if kept.count() <= graph.SMALL:
        return graph.components(kept.select(F.col("u").alias("a"), F.col("v").alias("b"))).where("node != root")
    before = None
    while True:
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        kept = cut(moved.where("u != v").distinct())
        after = tuple(kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before or not after[0]:
            return kept.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row: ``root`` names the row's group."""
    rows = cut(fingerprints(docs))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct))
    at = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = at.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(at.select("fp", "root").join(named, "root"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The near-duplicate group of every row of ``docs`` (doc_id, text; other columns play no part).

    Result, a row per input row: doc_id, fingerprint (16 hex digits),
    component_id (least doc_id that links of at most three bits reach).

    Null and empty texts have fingerprint zero and are linked as any other.
    Repeated rows stay repeated.  A null doc_id is kept; its component_id is the
    least known doc_id of its group, or null.  An empty table gives no rows.
    """
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
