"""Names for stages, repair modules and sources, so that configurations can choose them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[DataFrame], DataFrame]
Source = Callable[[SparkSession, str], DataFrame]


class Registry:
    """A mapping of names to functions; an unknown or a doubled name is an error."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def add(self, name: str, function: Callable) -> Callable:
        if name in self._known:
            raise ValueError(f"{self.kind} {name} is there already")
        self._known[name] = function
        return function

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise ValueError(f"unknown {self.kind} {name}; there are {', '.join(sorted(self._known))}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


stages, sources = Registry("stage"), Registry("source")


def run_stages(df: DataFrame, names: Sequence[str], *, skip: Sequence[str] = (), first: str | None = None, last: str | None = None) -> DataFrame:
    """Applies stages in order, from ``first`` to ``last``; all names are looked up before the first runs."""
    names = list(names)
    low, high = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    if low > high:
        raise ValueError("the first stage comes after the last")
    for function in [stages.get(n) for n in names[low : high + 1] if n not in skip]:
        df = df.transform(function)
    return df
