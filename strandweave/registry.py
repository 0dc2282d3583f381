"""All registered queries by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.plans import cut_queries, file_queries, interval_queries, job_queries, pair_queries, robust_queries, sequence_sql, signal_queries, similarity_queries, text_queries, window_queries

MODULES = (robust_queries, interval_queries, window_queries, similarity_queries, text_queries, job_queries, signal_queries, pair_queries, cut_queries, file_queries, sequence_sql)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLES.items()}
