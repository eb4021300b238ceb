"""Progress of long work on a terminal or in a log."""

from __future__ import annotations

import sys
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Without a terminal, a line after every so many items.
EVERY = 25


class Progress:
    """Counts items: a bar that is drawn over itself on a terminal, else a line now and then."""

    def __init__(self, total: int, label: str = "", out=None, terminal: bool | None = None):
        self.total, self.label, self.done = total, label, 0
        self.out = sys.stderr if out is None else out
        self.terminal = self.out.isatty() if terminal is None else terminal

    def add(self, n: int = 1) -> None:
        before, self.done = self.done, self.done + n
        if self.terminal:
            filled = 20 * min(self.done, self.total) // max(1, self.total)
            self.out.write(f"\r{self.label} [{'#' * filled:<20}] {self.done}/{self.total}" + ("\n" if self.done >= self.total else ""))
            self.out.flush()
        elif before // EVERY < self.done // EVERY or self.done >= self.total > before:
            self.out.write(f"{self.label} {self.done}/{self.total}\n".lstrip())


@contextmanager
def stage_progress(spark: SparkSession, label: str, out=None, seconds: float = 2.0):
    """While the block runs, reports the tasks of the running stages as Spark tracks them."""
    out = sys.stderr if out is None else out
    over = threading.Event()

    def watch():
        tracker = spark.sparkContext.statusTracker()
        while not over.wait(seconds):
            stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
            if stages:
                out.write(f"{label}: {sum(s.numCompletedTasks for s in stages)}/{sum(s.numTasks for s in stages)} tasks\n")

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
