"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key, -ln(u) / weight, from a hash of its id,
so reruns agree.  A source whose target is n and a fraction times its size takes
n complete epochs and then, in key order, documents up to the rest of its budget.

Scale: the documents are read once and leave as a few numbers each.  No source is
sorted as a whole: sums by key bucket find the one bucket in which a source's
budget ends, and only that bucket's rows are sorted and prefix-summed, rows of one
doc_id and size as one.  Sources may be as many as sites: they are numbered by
range, and the level that their targets share is found by sums over them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, cut, numbered

BUCKETS, MOST, WEIGHTS = 4096, 3, (1, 2, 3)
SALTS = 64


def size_of(text: str = "text") -> Column:
    """How many runs of characters other than ASCII white space a text has; null has none."""
    spaced = f"coalesce({text}, '')"
    for code in range(0x09, 0x0E):
        spaced = f"replace({spaced}, chr({code}), ' ')"
    return F.expr(f"cast(size(array_remove(split({spaced}, ' '), '')) as bigint)")


def targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The target of each source, a row each: source, source_size -> target.

    Sources weigh ``weights`` in turn, by code point and null last, and share the
    sum of all sizes.  A target above ``most`` times its source's size stops there
    and the others share the excess by weight: the level, a target's share of its
    weight, rises until no more sources stop below it.
    """
    turn = (F.col("_nth") - 1) % len(weights)
    weighed = numbered(sizes, [F.col("source").asc_nulls_last()], "_nth")
    weighed = weighed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    weighed = cut(weighed.withColumn("stop", most * F.col("source_size")))
    stops_at = F.col("stop").cast("double") / F.col("weight").cast("double")
    level, stopped = -1.0, -1
    while True:
        below = stops_at < level
        total, free, n = weighed.agg(
            F.coalesce(F.sum("source_size") - F.coalesce(F.sum(F.when(below, F.col("stop"))), F.lit(0)), F.lit(0)), F.coalesce(F.sum(F.when(~below, F.col("weight"))), F.lit(0)), F.count_if(below)
        ).first()
        if n == stopped or not free:
            break
        level, stopped = float(total) / float(free), n
    share = F.least(F.col("stop").cast("double"), F.lit(level) * F.col("weight")) if free else F.col("stop").cast("double")
    return weighed.select("source", "source_size", share.alias("target"))


def _by_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's plan, without dealing rows out by source, of which one may have a third.

    A plan of few sources, by a count of them, goes to every task; a larger one is
    repeated for each of ``SALTS`` parts of a source.
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    if plan.count() <= FEW:
        return rows.join(F.broadcast(plan), same)
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)))
    return parts.join(salted, same & (F.col("part") == F.col("salt"))).drop("part", "salt")


def mix(docs: DataFrame, quality: DataFrame | None = None, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """How often the mix takes each document.

    docs: doc_id, source, text.  quality: doc_id, weight (above 0; 1 where a
    document has none, the largest where it has several).  Other columns play no
    part.  Result, a row per input row: doc_id, size, source_size, target, taken.

    A null text has size 0.  A null source is a source.  Repeated rows count and
    are taken each; a null doc_id draws its key from the text.  Sources without
    words, and empty tables, take nothing.
    """
    seed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    unit = (F.conv(F.substring(seed, 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)
    rows = docs.select("doc_id", "source", size_of().alias("size"), unit.alias("unit"))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        best = quality.where("doc_id IS NOT NULL AND weight > 0").groupBy("doc_id").agg(F.max("weight").cast("double").alias("weight"))
        rows = rows.join(best, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    key = -F.log("unit") / F.col("weight")
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    rows = cut(rows.withColumn("key", key).withColumn("bucket", bucket).select("doc_id", "source", "size", "key", "bucket"))

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("z"))
    goals = targets(sums.groupBy("source").agg(F.sum("z").alias("source_size")), most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double"))
    # The first bucket with which the running sum passes the rest of the budget.
    running = sums.withColumn("after", F.sum("z").over(Window.partitionBy("source").orderBy("bucket")))
    last = (
        running.alias("r")
        .join(goals.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where("after > rest")
        .groupBy("source")
        .agg(F.min_by(F.struct("bucket", (F.col("after") - F.col("z")).alias("offset")), "bucket").alias("last"))
    )
    plan = (
        goals.join(last.select(F.col("source").alias("s"), "last"), F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", F.coalesce("last.bucket", F.lit(BUCKETS)).alias("ends"), F.coalesce("last.offset", F.lit(0)).alias("offset"))
    )
    planned = _by_source(rows, cut(plan))
    result = ["doc_id", "size", "source_size", "target", "taken"]
    settled = planned.where("bucket != ends").withColumn("taken", F.expr("size * (epochs + if(bucket < ends, 1, 0))"))
    # Rows of one key and size are taken one by one, whichever: they are sorted as one, with their count.
    ending = planned.where("bucket = ends").groupBy("source", "key", "doc_id", "size", "source_size", "target", "epochs", "rest", "offset").agg(F.count("*").alias("rows"))
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("offset") + F.sum(F.col("size") * F.col("rows")).over(in_order) - F.col("size") * F.col("rows")
    each = ending.withColumn("before", before).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    upto = F.col("before") + F.col("size") * F.col("nth") - F.col("size") / 2
    sorted_out = each.withColumn("taken", F.col("size") * (F.col("epochs") + (upto <= F.col("rest")).cast("int")))
    out = settled.select(*result).unionByName(sorted_out.select(*result))
    return out.withColumn("taken", F.col("taken").cast("long"))
