"""One registered query per operator; importing the modules fills the registry."""

import importlib

from tidegrid.queries import registry

MODULES = ("ingest", "grids", "gaps", "outliers", "featuring", "statistics", "relations", "scoring")


def load():
    for m in MODULES:
        importlib.import_module(f"tidegrid.queries.{m}")
    return registry
