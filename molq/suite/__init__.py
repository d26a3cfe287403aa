"""All registered queries. ``load_all`` imports every family module once."""

from __future__ import annotations

import importlib

from molq.suite.base import REGISTRY, Query

FAMILIES = ("contract", "accounting", "sources", "joins", "cooccurrence", "profiles",
            "ranking", "tidy", "spatial", "modelling", "streaming")


def load_all() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"molq.suite.{family}")
    return REGISTRY
