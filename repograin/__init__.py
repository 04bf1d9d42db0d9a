"""Codebase intelligence as DataFrame operators over tables of source files."""

from repograin.registry import operator, operators

__all__ = ["operator", "operators"]
