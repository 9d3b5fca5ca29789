"""All core queries, gathered from the plan modules."""

from __future__ import annotations

from strandwork.plans import contract_plans, corpus_plans, evaluation_plans, sampling_plans, store_plans  # noqa: F401  (they register queries)
from strandwork.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
