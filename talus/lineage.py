"""Cutting lineage and numbering rows, so that long plans survive lost executors and no task holds a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as named by ``spark.checkpoint.dir``.

    Where the setting is absent, a session on one machine uses a folder under its
    warehouse directory; any other is refused, as its executors share none.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return _sized(df.checkpoint())


def _sized(kept: DataFrame) -> DataFrame:
    """``kept``, a checkpoint, with the size that its plan was taken for, or an unknown one where that exceeds a long.

    A join is taken for the product of its sides, and a checkpoint hands that on: in
    rounds of joins the number of digits grows as a power of the rounds, until it
    fills the driver's memory.
    """
    session, execution = kept.sparkSession, kept._jdf.queryExecution()
    plan = execution.logical()
    if plan.stats().sizeInBytes() < 2**63:
        return kept
    none = session._jvm.scala.Option.empty()  # type: ignore[union-attr]
    bare = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), execution.sparkSession(), none, none)
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(execution.sparkSession(), bare), session)  # type: ignore[union-attr]


def numbered(df: DataFrame, by: list[str | Column], into: str) -> DataFrame:
    """``df`` with a number from 1 in order of ``by``, which no two rows share.

    Rows are dealt out by range, numbered in each part, and moved on by the sizes
    of the parts before: the driver sees one number a part.
    """
    dealt = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return dealt.withColumn(into, F.lit(1).cast("long")).drop("_part")
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return dealt.withColumn(into, place + offsets[F.col("_part")].cast("long")).drop("_part")
