"""All registered queries of this subpackage."""

from __future__ import annotations

import importlib

from statloom.llm.base import REGISTRY

MODULES = ("toxicity", "ngram_join", "pii", "decontaminate", "suffix_dedup", "licenses", "quality", "fm_dedup", "extraction", "mixing", "ranked_search", "filter_audit", "line_runs")


def load_all() -> dict:
    for name in MODULES:
        importlib.import_module(f"statloom.llm.{name}")
    return REGISTRY
