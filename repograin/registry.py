"""Name -> operator registry.

An operator is a plain function ``DataFrame(s) -> DataFrame``. Registering it
by name is the plug-in surface: a caller may add or look up operators without
touching this package.
"""

from __future__ import annotations

from collections.abc import Callable

_OPERATORS: dict[str, Callable] = {}


def operator(name: str) -> Callable[[Callable], Callable]:
    """Register the decorated function under ``name``."""

    def wrap(fn: Callable) -> Callable:
        if name in _OPERATORS:
            raise ValueError(f"operator {name!r} is registered twice")
        _OPERATORS[name] = fn
        return fn

    return wrap


def operators() -> dict[str, Callable]:
    return dict(_OPERATORS)
