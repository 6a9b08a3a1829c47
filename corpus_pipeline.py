"""A corpus pipeline over `documents`: each stage works on all that the one before it kept.

Defined cases, in every stage: an empty table gives an empty one; a null text counts as the empty one, which is neither
toxic nor a near copy nor a leak; long texts are read whole; null doc_ids are rows of their own, and doc_id may be of any
type with an order (toxicity, dedup, decontamination, bpe); further columns pass through, whatever their names.
Ties and repeated rows are said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalfold.llm import bpe, minhash, toxicity, winnow
from signalfold.llm.bloom_dedup import BloomDedup
from signalfold.llm.queries import vocabulary
from signalfold.llm.store import materialize, table


#: Rows that the JVM hands to a Python worker at once: texts are long, and the usual 10,000 of them are held several times over.
BATCH_ROWS = 1024


def _small_batches(spark: SparkSession) -> None:
    """Bound the batches of the Python stages in this session, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, learnt from `labels`, calls toxic go; equal texts are judged alike. Without labels all stay."""
    _small_batches(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space stays: the longest, then that of the least
    doc_id, a null one last, and one of wholly equal rows. All empty texts are one group."""
    return BloomDedup(docs).deduplicate()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8 or more stays: the one of the least
    doc_id, with all rows that repeat it. Rows without words or without a doc_id stay."""
    _small_batches(spark)
    return minhash.deduplicate(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go, equal rows alike. Without items all stay."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, with digests of the ids and of the decoded text, beside all columns but the text; a
    column named like a result is replaced."""
    _small_batches(spark)
    return bpe.tokenize(docs, vocabulary(), keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: The model of the first stage is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
