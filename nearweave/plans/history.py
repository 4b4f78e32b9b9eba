"""What each round did: the progress that a build reports.

A row for each round of a descent and each epoch of a forest (rows of the graph, and how many of them are new), and for
each level of a partition (vectors in blocks that are split, and the number of those blocks), with its seconds.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class History:
    rows: list[tuple[str, int, int, int, int, float]] = field(default_factory=list)
    _begun: float = field(default_factory=time.monotonic)

    def add(self, phase: str, epoch: int, turn: int, rows: int, changes: int) -> None:
        now = time.monotonic()
        self.rows.append((phase, epoch, turn, rows, changes, now - self._begun))
        self._begun = now

    def level(self, epoch: int, level: int, sizes: dict[str, int]) -> None:
        """A level of a partition: how many vectors lie in blocks that are split, and how many such blocks there are."""
        self.add("partition", epoch, level, sum(sizes.values()), len(sizes))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "phase string, epoch int, iter int, rows long, changes long, seconds double")
