"""Registered queries, one per operator, over whole driver tables."""

from __future__ import annotations

import importlib

MODULES = ["mining", "columns", "reports", "ranking", "samples", "store", "fitting", "streams"]


def load_all():
    """Import all query modules and return (queries, SQL)."""
    for name in MODULES:
        importlib.import_module(f"starfold.plans.{name}")
    from starfold.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
