"""Queries of this package: name, function and, where SQL can express it, SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("sharding", "jaccard", "repeats", "toxicity", "secrets", "mixing", "nearest", "tokenfiles",
           "tokencounts", "decontaminate", "negatives", "exactdups", "prefixtrie")


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"conceptframe.llm.{name}")
        queries[module.NAME] = module.query
        if module.SQL is not None:
            sql[module.NAME] = module.SQL
    return queries, sql
