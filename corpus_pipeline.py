"""The corpus pipeline: operators of ``tarmac.llm`` applied in turn to ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bm25_leaks, jaccard_tiles, piece_fst, pii_crf, pu_toxicity
from tarmac.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: train on the stage's own documents and ``labels``; documents scored toxic go."""
    return pu_toxicity.without_toxic(docs, pu_toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near copies stays, the one with the smallest id."""
    return jaccard_tiles.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold an item of ``benchmark`` go."""
    return bm25_leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every span found is replaced by its kind; ``n_chars`` follows the new text."""
    clean = pii_crf.redact(docs, pii_crf.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the piece ids of every document, and whether decoding gives its text back."""
    import public_tokenizers

    return piece_fst.encode(docs, str(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("personal_data", personal_data), ("pieces", pieces)]

#: Trained classifiers, a CRF and a transducer's path have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
