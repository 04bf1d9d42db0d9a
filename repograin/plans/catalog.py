"""All query modules."""

import importlib

MODULES = ["markers", "documents", "sources", "status", "frameworks", "code", "domains", "purpose", "context", "delivery"]

for _name in MODULES:
    importlib.import_module(f"repograin.plans.{_name}")
