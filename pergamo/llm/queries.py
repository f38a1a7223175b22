"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("token_counts", "mixing", "exact_dedup", "language_id", "vector_dedup", "substring_dedup", "bpe_codec", "simhash_dedup", "url_filter", "line_dedup", "spelling_variants", "doc_fingerprints", "hard_negatives")
_modules = [import_module(f"pergamo.llm.{m}") for m in MODULES]
QUERIES = {k: v for m in _modules for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _modules for k, v in getattr(m, "ORACLE", {}).items()}
