"""Queries of the corpus operators over the generated tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tieout.llm.byte_bpe import op2_byte_bpe
from tieout.llm.fingerprint import op9_fingerprints
from tieout.llm.frames import read
from tieout.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tieout.llm.language_id import op7_language_id
from tieout.llm.ngram_join import op4_ngram_jaccard_join
from tieout.llm.packing import op5_best_fit_packing
from tieout.llm.pair_bpe import op13_pair_bpe
from tieout.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from tieout.llm.quality import op10_quality
from tieout.llm.token_count import op1_token_counts
from tieout.llm.toxicity import op6_toxicity
from tieout.llm.vector_forest import op3_vector_forest
from tieout.llm.warc import OP8_SQL, op8_warc


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_token_counts(read(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_byte_bpe(read(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_vector_forest(read(spark, sf_dir, "embeddings"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_ngram_jaccard_join(read(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_best_fit_packing(read(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_language_id(read(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_warc(read(spark, sf_dir, "pages"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_fingerprints(read(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_hard_negatives(read(spark, sf_dir, "embeddings"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_prefix_trie(read(spark, sf_dir, "conversations"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_pair_bpe(read(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_token_counts": _op1,
        "op2_byte_bpe": _op2,
        "op3_vector_forest": _op3,
        "op4_ngram_jaccard_join": _op4,
        "op5_best_fit_packing": _op5,
        "op6_toxicity": _op6,
        "op7_language_id": _op7,
        "op8_warc": _op8,
        "op9_fingerprints": _op9,
        "op10_quality": _op10,
        "op11_hard_negatives": _op11,
        "op12_prefix_trie": _op12,
        "op13_pair_bpe": _op13,
        "pipeline": _pipeline,
    }


#: All pairs in double precision; components by the smallest id that reaches a row. For small tables only.
OP3_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id
), component AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN component c ON c.id = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_vector_forest": OP3_SQL, "op8_warc": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_prefix_trie": OP12_SQL}
