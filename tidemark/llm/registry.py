"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import lines, mixing
from tidemark.llm.embedding import near_vectors
from tidemark.llm.packing import pack
from tidemark.llm.quality import classify_quality
from tidemark.llm.runtime import prepare, table
from tidemark.llm.secrets import report
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.tokens import count_tokens
from tidemark.llm.toxicity import classify_toxicity
from tidemark.llm.urls import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return operator(table(spark, sf_dir, name))

    return query


def _labelled(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

    return query


EMBEDDING_ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM parts
"""

QUERIES: dict[str, Query] = {
    "op1_source_mixing": _over("documents", mixing.mix_sources),
    "op2_embedding_neardup": _over("embeddings", near_vectors),
    "op3_token_counts": _over("documents", count_tokens),
    "op4_toxicity": _labelled(classify_toxicity),
    "op5_quality_rules": _over("documents", lines.judge),
    "op6_url_filter": _over("pages", judge_urls),
    "op7_quality_classifier": _labelled(classify_quality),
    "op8_packing": _over("documents", pack),
    "op9_simhash_neardup": _over("documents", lambda d: near_duplicates(d).drop("text_key")),
    "op10_secret_scan": _over("documents", report),
}

ORACLES: dict[str, str] = {"op1_source_mixing": mixing.ORACLE, "op2_embedding_neardup": EMBEDDING_ORACLE, "op5_quality_rules": lines.ORACLE}
