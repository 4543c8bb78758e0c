"""All queries of the engine's own operators and, by the same names, their SQL for comparison."""

from __future__ import annotations

from importlib import import_module

from tidemark.plans.registry import ORACLES, QUERIES

for _part in ("signals", "backtest", "market", "store", "research", "validation", "rotation", "learned", "desk", "reading", "sweeps", "provider", "admission"):
    import_module(f"tidemark.plans.{_part}")

__all__ = ["ORACLES", "QUERIES"]
