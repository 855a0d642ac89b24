"""All queries of the subpackage."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

from forumlens.llm.common import BOOK

MODULES = ["pieces", "rules", "tokens", "neardup", "language", "quality", "urls", "sharding", "pii", "decontamination",
           "whitening", "search", "merkle"]


def _filled():
    for name in MODULES:
        import_module(f"forumlens.llm.{name}")
    return BOOK


def queries() -> dict:
    return dict(_filled().queries) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    extra = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return dict(_filled().sql) | extra
