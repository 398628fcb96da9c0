"""Queries of the engine's operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpora, documents, evaluation, graph, knowledge, search, service

ALL = {**search.QUERIES, **graph.QUERIES, **evaluation.QUERIES, **service.QUERIES, **documents.QUERIES, **corpora.QUERIES, **knowledge.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
