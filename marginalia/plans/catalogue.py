"""All registered queries of the core library with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans import corpus_queries, event_queries, file_queries, latex_queries, narrative_queries, review_queries, rule_queries, spelling_queries, table_queries, tag_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return rule_queries.QUERIES | corpus_queries.QUERIES | event_queries.QUERIES | review_queries.QUERIES | table_queries.QUERIES | latex_queries.QUERIES | file_queries.QUERIES | spelling_queries.QUERIES | tag_queries.QUERIES | narrative_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return rule_queries.ORACLES | corpus_queries.ORACLES | event_queries.ORACLES | review_queries.ORACLES | table_queries.ORACLES | latex_queries.ORACLES | file_queries.ORACLES | spelling_queries.ORACLES | tag_queries.ORACLES | narrative_queries.ORACLES
