"""The named queries of the core library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ensembles, matrices, models, nested, scoring, texts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p1_found": nested.p1_found,
    "p1_documents": nested.p1_documents,
    "p1_pairs": nested.p1_pairs,
    "p1_article_documents": nested.p1_article_documents,
    "p1_article_pairs": nested.p1_article_pairs,
    "p1_article_mentions": nested.p1_article_mentions,
    **scoring.QUERIES,
    **ensembles.QUERIES,
    **texts.QUERIES,
    **models.QUERIES,
    **matrices.QUERIES,
}
ORACLE: dict[str, str] = {"p1_found": nested.P1_SQL, **nested.P1_TABLES_SQL, **nested.ARTICLE_SQL, **scoring.ORACLE, **ensembles.ORACLE, **texts.ORACLE, **models.ORACLE, **matrices.ORACLE}
