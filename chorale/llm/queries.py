"""The queries of this package and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, language_id, licenses, mixing, secrets, simhash, substring_dedup, token_counts

MODULES = (mixing, substring_dedup, simhash, chat_format, licenses, decontaminate, token_counts, language_id, exact_dedup, secrets)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
