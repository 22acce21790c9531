"""Named factors, filters and patterns; parameters are checked against the callable."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    name: str
    fn: Callable[..., Any]
    category: str = ""
    score: str | None = None
    tags: tuple[str, ...] = field(default_factory=tuple)

    @property
    def defaults(self) -> dict[str, Any]:
        sig = inspect.signature(self.fn)
        return {k: p.default for k, p in sig.parameters.items() if p.default is not inspect.Parameter.empty}

    def check(self, params: Mapping[str, Any]) -> None:
        known = inspect.signature(self.fn).parameters
        unknown = [k for k in params if k not in known]
        if unknown:
            raise TypeError(f"{self.name}: unknown parameters {unknown}")


class Registry:
    def __init__(self, kind: str):
        self.kind = kind
        self.items: dict[str, Entry] = {}

    def register(self, name: str, category: str = "", score: str | None = None, tags: tuple[str, ...] = ()):
        def add(fn):
            self.items[name] = Entry(name, fn, category, score, tags)
            return fn
        return add

    def get(self, name: str) -> Entry:
        if name not in self.items:
            raise KeyError(f"unknown {self.kind} {name!r}")
        return self.items[name]

    def names(self, category: str | None = None) -> list[str]:
        return sorted(n for n, e in self.items.items() if category is None or e.category == category)


FACTORS = Registry("factor")
FILTERS = Registry("filter")


def add_factor(df: DataFrame, name: str, params: Mapping[str, Any] | None = None, as_name: str | None = None,
               on_unknown: str = "raise") -> DataFrame:
    """Add ``factor_<name>`` (0-100 score per row), keeping only it and the input columns."""
    out = as_name or f"factor_{name}"
    if name not in FACTORS.items and on_unknown == "neutral":
        return df.withColumn(out, F.lit(50.0))
    entry = FACTORS.get(name)
    entry.check(params or {})
    scored = entry.fn(df, **(params or {}))
    return scored.select(*df.columns, F.col(entry.score or name).alias(out))
