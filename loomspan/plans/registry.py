"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib
import importlib.util

from loomspan.plans.base import QUERIES, SQL

MODULES = ("q_text", "q_prune", "q_data", "q_eval", "q_learned", "q_stream")
for _m in MODULES:
    importlib.import_module(f"loomspan.plans.{_m}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
