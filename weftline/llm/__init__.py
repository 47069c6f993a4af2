"""Corpus operators for training-data pipelines; nothing else in the library imports this package."""

from importlib import import_module

MODULES = ("line_dedup", "quality", "decontaminate", "packing", "ngram_join", "warc", "katz", "suffix_dedup", "embedding_dedup", "quote_linking", "token_store", "prefix_tries", "spelling")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in getattr(import_module(f"{__name__}.{m}"), "ORACLE_SQL", {}).items()}
