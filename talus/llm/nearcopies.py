"""Near copies: SimHash links, completed by the exact Jaccard similarity of word shingles.

Fingerprints of texts that are similar to 0.8 differ in ten bits and more, beyond
what anchors can cover, so SimHash alone misses most such links.  It gives the
first pairs, through its anchors.  The rest come from a prefix filter: two sets
whose similarity reaches a threshold share a member among the first few of each in
any order of all members, so no pair is missed.  Rare shingles come first; how
common they are is told by a sample, which has no part in what is found.  Where
the member before is shared too, the pair meets there.  At the first member that two
sets share, what either has from there on bounds what they share; pairs that it
rules out are not made.

A pair is first held against counts: each set is dealt to buckets by hash, and the
smaller counts of the two, summed, bound what they share.  What passes is checked
by whole sets, first one pair a set, then those that still join two groups.

Scale: texts are read as shingle hashes, equal sets are merged, and only prefixes
are dealt.  At a shingle one set meets all others, so a group of copies gives as
many pairs as it has sets.  Shingles whose sets are not one component after that
take rounds, each with a few sets of the largest component and a few others against
all of other components.  No task holds the sets of a shingle at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, cut, meeting, small
from .simhash import SEED, components, links, majority, shingle_hashes

#: Word shingles and the least similarity of near copies, unless a contract says otherwise.
SHINGLE, SIMILAR = 5, 0.8
#: Of how many texts one is sampled, shingles held as common, and how many sets of a shingle meet all others in the first round.
SAMPLE, COMMON, REPS = 12, 400_000, 4
#: More pairs than these are checked in two turns.
TRIED = 50_000
#: Shingles a bucket, about, and the fewest buckets.
CROWD, BUCKETS = 4, 64

ROWS = "doc_id long, text_hash long, node long, n long, fp long, counts binary, prefix array<long>"


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct word shingles, sorted; a shorter text is one shingle."""
    return np.unique(shingle_hashes(text, size).view(np.int64))


def counts(members: np.ndarray) -> bytes:
    """How many members fall into each bucket by their low bits; a power of two buckets, 255 standing for as many or more."""
    buckets = max(BUCKETS, 1 << max(0, len(members) // CROWD - 1).bit_length())
    return np.minimum(np.bincount(members & (buckets - 1), minlength=buckets), 255).astype(np.uint8).tobytes()


def shared_at_most(a: bytes, b: bytes, n: int) -> int:
    """The most members that two sets can share, by their counts; ``n``: the size of the smaller set."""
    left, right = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if (left == 255).any() or (right == 255).any():
        return n
    size = min(len(left), len(right))  # buckets by fewer bits are sums of those by more
    left, right = (x.reshape(-1, size).sum(axis=0, dtype=np.int64) for x in (left, right))
    return int(np.minimum(left, right).sum())


def enough(both: int, n: int, m: int, similar: float) -> bool:
    """Whether sets of ``n`` and ``m`` members that share ``both`` are similar."""
    return both >= similar * (n + m - both) - 1e-9


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several texts of a sample share, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), size))], ["token"])

    some = texts.where(F.expr(f"pmod(text_hash, {SAMPLE}) = 0")).select("text_hash", "text").dropDuplicates(["text_hash"])
    tokens = some.select("text").mapInArrow(run, "token long")
    found = tokens.groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(COMMON).toPandas().sort_values("token")
    return found["token"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def _read(size: int, similar: float, common: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text: its set's name and size, its fingerprint, counts by bucket, and prefix."""
    tokens, often = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            nodes, sizes, fps, tallies, prefixes = [], [], [], [], []
            for t in batch.column(2):
                hashes = shingle_hashes(t.as_py(), size)
                found = np.unique(hashes.view(np.int64))
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                fps.append(majority(hashes))
                tallies.append(counts(found))
                order = np.zeros(len(found), np.int64)
                if len(tokens) and len(found):
                    at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
                    order = np.where(tokens[at] == found, often[at], 0)
                first = len(found) - math.ceil(len(found) * similar - 1e-9) + 1 if len(found) else 0
                prefixes.append(found[np.lexsort((found, order))[:first]])
            signed = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
            arrays = [batch.column(0), batch.column(1), next(signed), pa.array(sizes, pa.int64()), next(signed), pa.array(tallies, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "node", "n", "fp", "counts", "prefix"])

    return run


def _fit(n: str, m: str, prev: str, other: str, rest: str, its: str, similar: float) -> F.Column:
    """Whether sets of two sizes may be similar and don't meet at the member before already.

    ``rest`` and ``its`` count a set's members from the token on.  Similar sets pass at
    the first member that they share, as all that they share is among those.
    """
    sizes = F.least(n, m) >= F.lit(similar) * F.greatest(n, m) - F.lit(1e-9)
    return sizes & (F.least(rest, its) >= F.lit(similar / (1 + similar)) * (F.col(n) + F.col(m)) - F.lit(1e-6)) & (F.col(prev) != F.col(other))


def _starred(dealt: DataFrame, similar: float) -> DataFrame:
    """Of (token, id, n, prev, rest) each set with the least set of its token: rep, null where the two need no check.

    Tokens of one set are left out.  ``token`` is null where a token has but two
    sets, which have met.  Rows stream by in order; none waits for its whole group.
    """
    order = Window.partitionBy("token").orderBy("id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.first(F.struct("id", "n", "prev", "rest")).over(so_far)
    rows = dealt.withColumn("_r", least).withColumn("_k", F.row_number().over(order)).withColumn("_1", F.lead("id", 1).over(order)).withColumn("_2", F.lead("id", 2).over(order))
    several = (F.col("_k") > 1) | F.col("_1").isNotNull()
    more = (F.col("_k") > 2) | F.when(F.col("_k") == 1, F.col("_2")).otherwise(F.col("_1")).isNotNull()
    meets = (F.col("_k") > 1) & _fit("n", "_r.n", "prev", "_r.prev", "rest", "_r.rest", similar)
    kept = rows.where(several).select(F.when(more & (F.col("_k") > 1), F.col("token")).alias("token"), "id", "n", "prev", "rest", F.when(meets, F.col("_r.id")).alias("rep"))
    return kept.where("token IS NOT NULL OR rep IS NOT NULL")


def _apart(rows: DataFrame) -> DataFrame:
    """Those of (token, id, n, prev, rest, comp) whose token has sets of several components and with several members before, with ``main``, its largest component."""
    sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("c"), F.min("prev").alias("p"), F.max("prev").alias("q"))
    several = sizes.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.min("p").alias("p"), F.max("q").alias("q"))
    return rows.join(several.where("comps > 1 AND p != q").select("token", "main"), "token")


class _Search:
    """The links found so far between sets of shingles, and what it takes to check more."""

    def __init__(self, sets: DataFrame, texts: DataFrame, size: int, similar: float) -> None:
        self.sets, self.texts, self.size, self.similar = sets, texts, size, similar
        self.edges = self.roots = None

    def rooted(self, rows: DataFrame, column: str, into: str) -> DataFrame:
        """``rows`` with the component of a set."""
        if self.roots is None:
            return rows.withColumn(into, F.col(column))
        found = self.roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        return rows.join(found, F.col(column) == F.col("_node"), "left").withColumn(into, F.coalesce("_root", column)).drop("_node", "_root")

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs that counts leave open and that join two components."""
        similar = self.similar

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [enough(shared_at_most(x.as_py(), y.as_py(), min(i, j)), i, j, similar) for x, y, i, j in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        apart = self.rooted(self.rooted(pairs.select("a", "b").distinct(), "a", "_ra"), "b", "_rb").where("_ra != _rb")
        left, right = (self.sets.select(F.col("node").alias(c), F.col("counts").alias(f"c{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
        return cut(apart.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", "na", "nb").mapInArrow(run, "a long, b long"))

    def _similar(self, pairs: DataFrame, n: int) -> DataFrame:
        """The pairs, ``n`` of them, whose whole sets are similar."""
        size, similar = self.size, self.similar

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), size) for t in batch.column(1)], pa.list_(pa.int64()))], ["node", "members"])

        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = self.sets.select("node", "text_hash").join(named, "node")
        wanted = F.broadcast(wanted) if 2 * n <= FEW else wanted
        whole = cut(self.texts.join(wanted, "text_hash").dropDuplicates(["node"]).select("node", "text").mapInArrow(sets, "node long, members array<long>"))
        left, right = (whole.select(F.col("node").alias(c), F.col("members").alias(f"m{c}")) for c in "ab")
        both, sizes = F.size(F.array_intersect("ma", "mb")), F.size("ma") + F.size("mb")
        return cut(pairs.join(left, "a").join(right, "b").where(both >= F.lit(similar) * (sizes - both) - F.lit(1e-9)).select("a", "b"))

    def _link(self, pairs: DataFrame, n: int) -> None:
        edges = self._similar(pairs, n)
        self.edges = edges if self.edges is None else self.edges.unionByName(edges)
        self.roots = cut(components(self.edges))

    def add(self, pairs: DataFrame) -> None:
        """Link the sets of those pairs (a, b) that are similar."""
        pairs = self._possible(pairs)
        n = pairs.count()
        if n > TRIED:
            # One pair a set links most groups; the others matter only where they join two.
            tried = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
            self._link(tried, n)
            pairs = self._possible(pairs.join(tried, ["a", "b"], "left_anti"))
            n = pairs.count()
        if n:
            self._link(pairs, n)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each group that near copies link: that of the least doc_id, null last.

    Near copies are texts whose sets of ``shingle`` words have a Jaccard
    similarity of ``similar`` or more; texts without words, null ones too, are
    copies of each other.  Rows that repeat doc_id and text are one row here.  All
    columns are kept, and an empty table stays empty.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = cut(texts.mapInArrow(_read(shingle, similar, _common(texts, shingle)), ROWS))
    sets = cut(rows.groupBy("node").agg(F.min("text_hash").alias("text_hash"), *(F.first(c).alias(c) for c in ("n", "fp", "counts", "prefix"))))
    search = _Search(sets, texts, shingle, similar)
    # Operator 4: of the sets with one fingerprint each meets the least, and anchors link the fingerprints.
    of = sets.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("sets"))
    same = sets.select("fp", "node").join(of.where("sets > 1").select("fp", F.col("node").alias("a")), "fp").select("a", F.col("node").alias("b")).where("a != b")
    close = links(of.select("fp")).join(of.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    close = close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # Whatever else shares a member of its prefix.
    dealt = sets.select(F.col("node").alias("id"), "n", "prefix", F.posexplode("prefix").alias("at", "token"))
    dealt = dealt.select("token", "id", "n", F.expr("if(at = 0, id, prefix[greatest(at - 1, 0)])").alias("prev"), (F.col("n") - F.col("at")).alias("rest"))
    met = cut(_starred(dealt, similar))
    search.add(same.unionByName(close).unionByName(met.where("rep IS NOT NULL").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"))))
    left, reps = met.where("token IS NOT NULL").select("token", "id", "n", "prev", "rest"), REPS
    while True:
        left = cut(_apart(search.rooted(left, "id", "comp")))
        if left.isEmpty():
            break
        # Those first that share the most: what copies were made of shares more than they do among each other.
        shares = left.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_shares"))
        turn = Window.partitionBy("token", "_in").orderBy(F.desc("_shares"), "id")
        known = left.join(shares, F.col("id") == F.col("_id")).withColumn("_in", F.col("comp") == F.col("main"))
        chosen = cut(known.withColumn("_k", F.row_number().over(turn)).where(F.col("_k") <= reps).select("token", "id", "n", "prev", "rest", "comp"))
        ours = chosen.select("token", F.col("id").alias("x"), F.col("n").alias("m"), F.col("prev").alias("other"), F.col("rest").alias("behind"), F.col("comp").alias("its"))
        pairs = left.join(ours, "token").where((F.col("comp") != F.col("its")) & _fit("n", "m", "prev", "other", "rest", "behind", similar))
        search.add(pairs.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")))
        left = left.join(chosen.select("token", "id"), ["token", "id"], "left_anti").select("token", "id", "n", "prev", "rest")
        reps *= 8  # what the first few don't bring together has to be compared anyway
    # Rows are kept or left out by their keys; whole documents are dealt only where they repeat.
    placed = search.rooted(rows.select("doc_id", "text_hash", "node"), "node", "root").groupBy("doc_id", "text_hash").agg(F.first("root").alias("root"), F.count("*").alias("times"))
    known = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    winners = placed.groupBy("root").agg(F.min(known).alias("w")).select(F.col("root").alias("_root"), F.col("w.doc_id").alias("w_id"), F.col("w.text_hash").alias("w_hash"))
    wins = (F.col("root") == F.col("_root")) & F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))
    judged = cut(placed.join(winners, wins, "left").select("doc_id", "text_hash", F.col("_root").isNull().alias("lost"), "times"))
    once = meeting(docs, judged.where("lost OR times > 1"), "left_anti")
    repeated = judged.where("NOT lost AND times > 1")
    if repeated.isEmpty():
        return once
    again = meeting(docs, repeated, "left_semi")
    # Of rows that repeat, the one whose columns have the least hash.
    row = F.struct(*(F.col(c) for c in docs.columns))
    named = again.select(row.alias("_row"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    least = named.groupBy("doc_id", "text_hash").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return once.unionByName(least.select("_row.*"))
