"""Ordered lists of named DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[..., DataFrame]


class StepRegistry:
    """Named steps from several groups; the first group that knows a name handles it."""

    def __init__(self) -> None:
        self._groups: list[dict[str, Step]] = []

    def register(self, **steps: Step) -> StepRegistry:
        self._groups.append(dict(steps))
        return self

    def find(self, name: str) -> Step:
        for group in self._groups:
            if name in group:
                return group[name]
        raise KeyError(f'Could not find a processor for: "{name}". You may need to register one.')

    def run(self, rows: DataFrame, items: list[tuple]) -> DataFrame:
        """Apply (name, argument, ...) items in order, as one plan.

        All names are looked up first, so an unknown name fails before anything runs.
        """
        found = [(self.find(name), args) for name, *args in items]
        for step, args in found:
            rows = rows.transform(step, *args)
        return rows
