"""Registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import result_plans, scoring_plans, similarity_plans, text_plans, training_plans

MODULES = (text_plans, similarity_plans, scoring_plans, result_plans, training_plans)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
