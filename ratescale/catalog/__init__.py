"""Registered queries: each reads the given tables through the views and names its SQL twin."""

from __future__ import annotations

import importlib

FAMILIES = (
    "cleaning", "reliability", "evaluation", "analyses", "splitting", "agreement", "corpus", "experiments", "participants", "storage", "jobs",
)


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"ratescale.catalog.{family}")
