"""Cycles at intervals over a stored table, beside those who read it."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from ..operators import dream
from ..sources.graph_table import GraphTable

LEAST_SECONDS, SECONDS = 60, 1800


def once(table: GraphTable, as_of: str, keep: int = 2, **how) -> dream.Cycle:
    """One cycle over the current version, merged as the next; the last ``keep`` versions stay for readers."""
    cycle = dream.run_cycle(table.read(), as_of, **how)
    table.merge(cycle.changed, cycle.deleted)
    table.vacuum(keep)
    return cycle


def maintain(table: GraphTable, seconds: float = SECONDS, least: float = LEAST_SECONDS, clock: Callable[[], datetime.datetime] = datetime.datetime.now, **how):
    """A started query that runs a cycle each ``seconds`` (``least`` at least), the first one after an interval; stop it by its ``stop``.

    A cycle that another merge has overtaken is left out, the next one sees what that has written.
    Readers see a version from before a cycle or from after it.
    """
    from ..sources.graph_table import ConcurrentMerge

    started = []

    def run(_, batch_id: int) -> None:
        if not started:  # the trigger fires at once, a cycle waits first
            started.append(batch_id)
            return
        try:
            once(table, clock().strftime("%Y-%m-%d %H:%M:%S"), **how)
        except ConcurrentMerge:
            pass

    ticks = table.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(run).trigger(processingTime=f"{max(least, seconds)} seconds").start()
