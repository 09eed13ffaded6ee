"""Correction plug-ins and step sequences as data.

A plug-in is a named function of a DataFrame (column expressions or a grouped
kernel). Parameters are matched against its signature; code is not shipped as
text.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

KINDS = ("analysis", "development")


class Registry:
    """Named analysis and development functions."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str], Callable[..., DataFrame]] = {}

    def register(self, name: str, kind: str = "development"):
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")

        def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if (name, kind) in self._known:
                raise ValueError(f"{kind} plug-in {name} exists")
            self._known[name, kind] = fn
            return fn

        return add

    def names(self, kind: str) -> list[str]:
        return sorted(n for n, k in self._known if k == kind)

    def run(self, name: str, kind: str, df: DataFrame, params: dict[str, Any]) -> DataFrame:
        """Call a plug-in with the parameters it takes; others are ignored,
        missing required ones are an error."""
        if (name, kind) not in self._known:
            raise KeyError(f"no {kind} plug-in {name}")
        fn = self._known[name, kind]
        wanted = list(inspect.signature(fn).parameters.values())[1:]
        if any(p.kind is p.VAR_KEYWORD for p in wanted):
            return fn(df, **params)
        missing = [p.name for p in wanted if p.default is p.empty and p.name not in params]
        if missing:
            raise TypeError(f"plug-in {name} needs {', '.join(missing)}")
        return fn(df, **{p.name: params[p.name] for p in wanted if p.name in params})


def run_sequence(registry: Registry, sequence: Sequence[tuple[str, dict]], df: DataFrame, kind: str = "development") -> DataFrame:
    """Apply plug-ins in the order given: ``[(name, params), ...]``."""
    for name, params in sequence:
        df = registry.run(name, kind, df, params)
    return df
