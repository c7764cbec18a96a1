"""Registered queries: the operators applied to the given tables, each with a SQL twin where one exists."""

from __future__ import annotations

import importlib

MODULES = ("relational", "cells", "profiles", "drift", "facts", "briefs", "sources")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
