"""A corpus from raw documents to token ids, in five stages.

Every stage takes all that the one before it kept.  All but the last return the columns
of `documents`; the last returns what op1 returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm import bpe, decontaminate, linededup, minhash, toxicity
from loomnote.llm.queries import ranks_path, table
from loomnote.llm.shared import Tables, fresh, quoted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learned from the labels of these documents.

    Null and empty texts, rows without an id and repeated rows are judged by their own text
    alone; an empty table, or one without labels, loses nothing.
    """
    return toxicity.remove_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; n_chars follows the text.

    A document stays, with an empty text, even if each of its lines is a repetition.  Null
    texts and rows without an id stay as they are; rows that share an id are read as one.
    """
    columns = docs.columns
    left = linededup.dedup_lines(spark, docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*quoted(columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Null and empty texts and rows without an id stay.  Rows that share an id stay or go
    together.
    """
    name = fresh(docs.columns, "copy_doc")
    gone = minhash.near_duplicates(spark, docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of ten words with a benchmark item.

    Null and empty texts and rows without an id stay; rows that share an id go together.
    """
    return decontaminate.remove_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of the texts left, as digests, with the check that they decode.

    One row for each row: a null text has no ids, and ids may be null or repeated.
    """
    return bpe.round_trip(spark, docs, ranks_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("tokenization", tokenize),
]
#: Compression lengths and merge ranks have no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's rows written and read again before the next."""
    tables = Tables(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = tables.write(docs, f"stage-{number}")
            if number:
                tables.drop(f"stage-{number - 1}")
    return tables.finish(docs)
