"""Named queries over the shared tables."""

import importlib

_MODULES = ["masking", "detection", "restoring", "policies", "auditing", "editing", "library", "ingesting", "streams", "stored"]


def load():
    """Import every query module and return the registry."""
    for name in _MODULES:
        importlib.import_module(f"cloakframe.workload.{name}")
    return importlib.import_module("cloakframe.workload.registry")
