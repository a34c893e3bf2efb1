"""Named steps from a table to a table, and what they would do."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """Steps in order; every step is lazy, so that the whole is planned as one query."""

    steps: list[tuple[str, Step]] = field(default_factory=list)

    def then(self, name: str, step: Step) -> Pipeline:
        return Pipeline([*self.steps, (name, step)])

    def only(self, *names: str) -> Pipeline:
        return Pipeline([s for s in self.steps if s[0] in names])

    def skip(self, *names: str) -> Pipeline:
        return Pipeline([s for s in self.steps if s[0] not in names])

    def run(self, rows: DataFrame) -> DataFrame:
        for _, step in self.steps:
            rows = rows.transform(step)
        return rows

    def explain(self, rows: DataFrame) -> str:
        """The steps' names and the plan of the whole; nothing is run."""
        plan = self.run(rows)._jdf.queryExecution().toString()
        return "\n".join(name for name, _ in self.steps) + "\n\n" + plan
