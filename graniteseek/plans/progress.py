"""Progress events of a run, counted by its stages while they are written.

A stage's rows pass an observation (`DataFrame.observe`) on their way to where they are stored, so its event costs no
second scan and no job.  Events come in order, each when its stage is stored; a callback hears of them at once.  Counts
are those of all queries of the run; the figures for each query are `run_stats`.  Spark repeats a lost stage, and then an
observation can count rows twice: events are for people who wait, not for accounts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation


@dataclass
class Progress:
    """Collects the events of a run: (name, counts)."""

    tell: Callable[[str, dict[str, int]], None] | None = None
    events: list[tuple[str, dict[str, int]]] = field(default_factory=list)
    _waiting: list[tuple[str, Observation]] = field(default_factory=list)

    def say(self, event: str, **counts: int) -> None:
        self.events.append((event, counts))
        if self.tell:
            self.tell(event, counts)

    def watch(self, rows: DataFrame, event: str, **counts: Column) -> DataFrame:
        """The rows; once they are stored, `stored` makes an event of these counts of them."""
        seen = Observation()
        self._waiting.append((event, seen))
        return rows.observe(seen, *(c.alias(n) for n, c in counts.items()))

    def stored(self, rows: DataFrame) -> DataFrame:
        """The rows, which have just been stored with all that was watched on their way."""
        waiting, self._waiting = self._waiting, []
        for event, seen in waiting:
            self.say(event, **seen.get)
        return rows
