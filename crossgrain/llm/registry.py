"""Queries of this subpackage and their oracle SQL; each operator module adds its own."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("quality_rules", "quality_classifier", "secret_scan", "warc", "simhash", "byte_bpe", "license_scan", "decontaminate", "chat_quotes", "substring_dedup")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {}
    for m in MODULES:
        found |= importlib.import_module(f"crossgrain.llm.{m}").QUERIES
    return found | ({"pipeline": corpus_pipeline.run} if corpus_pipeline.STAGES else {})


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"crossgrain.llm.{m}"), "ORACLE_SQL", {})
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
