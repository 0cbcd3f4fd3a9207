"""The training-data queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q01_training_order", "q02_decontaminate", "q03_chat", "q04_fingerprints", "q05_packing", "q06_shards", "q07_quality", "q08_toxicity", "q09_lines", "q10_neardup", "q11_language", "q12_variants", "q13_phrases")


def _modules() -> list:
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if getattr(m, "SQL", None)}
