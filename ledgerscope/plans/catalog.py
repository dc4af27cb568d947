"""Imports every query module so that all ids are registered."""

from __future__ import annotations

from ledgerscope.plans import q_core, q_features, q_forecast, q_misc, q_models, q_shocked, q_windows  # noqa: F401
from ledgerscope.plans.registry import entries


def queries():
    return {k: e.build for k, e in entries().items()}


def oracle_sql():
    return {k: e.sql for k, e in entries().items() if e.sql is not None}
