"""The queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("codes", "decontaminate", "fingerprint", "html_extract", "language", "language_model", "near_dedup", "packing", "suffix_dedup", "toxicity", "url_filter", "warc", "whitening")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"engramark.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f"engramark.llm.{m}").SQL.items()}
