"""All queries of the training-data operators, with their oracle SQL."""

from __future__ import annotations

import importlib

#: Modules of this package that define QUERIES and SQL.
MODULES = ("bpe", "simhash", "lines", "chat", "urls", "decontaminate", "quality", "pii", "substrings", "embeddings")


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").SQL
    return found
