"""The corpus operators' queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_windows, hard_negatives, line_dedup, mixing, ordinal, packing, parsing, quality_rules, secret_scan, sentencepieces, simhash, spelling, url_filter

_ALL = {
    "op1_sentencepieces": sentencepieces,
    "op2_url_filter": url_filter,
    "op3_quality_rules": quality_rules,
    "op4_mixing": mixing,
    "op5_secret_scan": secret_scan,
    "op6_ordinal": ordinal,
    "op7_parsing": parsing,
    "op8_simhash": simhash,
    "op9_line_dedup": line_dedup,
    "op10_chat_windows": chat_windows,
    "op11_spelling": spelling,
    "op12_hard_negatives": hard_negatives,
    "op13_packing": packing,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _ALL.items() if getattr(module, "SQL", None)}
