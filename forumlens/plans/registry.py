"""All registered queries."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["a_sources", "b_schema", "c_text", "d_survey", "e_duplicates", "f_joins", "g_profiles", "h_windows",
            "i_sampling", "j_agreement", "k_models", "l_streams"]
FLAGSHIP = "f05_month_funnel"


def _books():
    return [import_module(f"forumlens.plans.{name}").BOOK for name in FAMILIES]


def queries() -> dict:
    return {name: run for book in _books() for name, run in book.queries.items()}


def oracle_sql() -> dict:
    return {name: sql for book in _books() for name, sql in book.sql.items()}
