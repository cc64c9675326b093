"""All registered queries by name."""

from __future__ import annotations

import importlib

from pulsegrid.plans.base import QUERIES, Query

MODULES = ("metrics", "labels", "logs", "detection", "models", "experiments", "streams", "files")


def registered() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"pulsegrid.plans.{name}")
    return dict(QUERIES)
