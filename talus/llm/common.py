"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, numbered, shared_dir

__all__ = ["FEW", "cut", "discard", "fresh", "lowered", "meeting", "numbered", "scratch", "shared_dir", "small", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: As many keys are named to every task that reads documents; more are joined, which deals the documents out.
FEW = 250_000
#: Rows that a Python worker reads at once where they hold texts.
FEW_TEXTS = 512


def meeting(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` with or without (``how``: left_semi, left_anti) the rows that ``keys`` (doc_id, text_hash; bounded lineage) name."""
    named = keys.select(F.col("doc_id").alias("_named_id"), F.col("text_hash").alias("_named_hash"))
    same = docs["doc_id"].eqNullSafe(named["_named_id"]) & (F.xxhash64(docs["text"]) == named["_named_hash"])
    return docs.join(F.broadcast(named) if keys.count() <= FEW else named, same, how)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder, with its file system's scheme."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")  # type: ignore[union-attr]
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path below the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that hold few texts; what a batch took is given back, as workers go on to other stages."""
    for batch in batches:
        for lo in range(0, batch.num_rows, FEW_TEXTS):
            yield batch.slice(lo, FEW_TEXTS)
        del batch
        pa.default_memory_pool().release_unused()


def text_of(column: str = "text") -> Column:
    """The text, null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def lowered(text: str) -> str:
    """SQL for ``text`` with A-Z lower-cased and every other character kept.

    ``lower`` works on bytes where all characters are ASCII; ``translate`` goes
    character by character and is kept for the rest.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"if(length({text}) = octet_length({text}), lower({text}), translate({text}, '{upper}', '{upper.lower()}'))"


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
