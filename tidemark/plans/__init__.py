"""Every registered query, by theme."""

from __future__ import annotations

import importlib

THEMES = ["sources", "checks", "joins", "aggregates", "windows", "topk", "sets", "scalars", "streams", "scoring",
          "models", "hooks"]


def _loaded():
    from . import registry

    for theme in THEMES:
        try:
            importlib.import_module(f"{__name__}.{theme}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{theme}":
                raise
    return registry


def queries():
    return dict(_loaded().QUERIES)


def oracle_sql():
    return dict(_loaded().ORACLE)
