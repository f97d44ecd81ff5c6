"""A corpus cleaned, deduplicated, decontaminated, scrubbed and mixed: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs.  All but the last keep the columns of documents, and
any others that the table has, whatever their names.  Every stage passes an empty
table on as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import decontaminate, mixing, nearcopies, secrets, toxicity
from talus.llm.common import cut, discard, fresh, meeting, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fit to the labelled ones among them, doesn't reject.

    Null and empty texts are judged as texts without words; rows that repeat are
    judged alike and stay repeated; a null doc_id is judged as any other.
    """
    suffix = "_".join(["", *(fresh(docs, n) for n in ("held_out", "score", "predicted"))])  # longer than any such name there is
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=docs.columns, suffix=suffix)
    return scored.where(F.col(f"predicted{suffix}") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that word shingles of five with a similarity of 0.8 or more link.

    The least doc_id of a group stays, null last.  Texts without words, null ones
    too, are one group; of rows that repeat doc_id and text one stays.
    """
    return nearcopies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark passage.

    Null and empty texts have no words and stay; rows that repeat go or stay
    together; a null doc_id is judged by its text as any other.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return meeting(docs, cut(found.select("doc_id", "text_hash").distinct()), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts.

    A null text stays null, rows that repeat stay repeated, and n_chars is counted
    anew.
    """
    return secrets.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken.

    A null text has size 0; a null source is a source; rows that repeat are taken
    each; a null doc_id draws its key from the text.
    """
    return mixing.mix(docs, table(spark, sf_dir, "labels").select("doc_id", (1 + F.col("quality")).alias("weight")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
]

#: Hashes, trained models and decoded layers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over ``documents``; a row for each document that the mix was offered.

    Nulls, ties, repeated rows and extra columns are as the stages say; an empty
    table gives no rows.
    """
    docs, base = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            discard(spark, f"{base}/{k - 1}")  # nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)
