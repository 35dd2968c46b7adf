"""From documents to packed training sequences, in stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it
as Parquet and gives it, read again, to the next. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tieout.llm.frames import read, stored
from tieout.llm.language_id import keep_identified
from tieout.llm.ngram_join import keep_first
from tieout.llm.packing import pack_texts
from tieout.llm.toxicity import keep_civil


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic passages that score 0.3 or more."""
    return keep_civil(docs, read(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return keep_identified(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of five-word shingles at 0.8 or more connect."""
    return keep_first(docs, k=5, p=80, q=100)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, n_tokens, bin_id, bin_length, bin_offset."""
    return pack_texts(docs)


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("ngram_jaccard_join", ngram_jaccard_join), ("best_fit_packing", best_fit_packing)]

#: Learnt models and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
