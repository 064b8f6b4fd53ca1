"""Composite jobs over the given tables, registered by name."""

import importlib

MODULES = ("text", "features", "corpora", "scoring", "training", "metrics", "rows", "files", "streams")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"faqloom.plans.{name}")
