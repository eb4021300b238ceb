"""The run ledger: one row per command, with status, duration and advisory locks."""

from __future__ import annotations

import fcntl
import os
import signal
import time
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.operators.pending import upsert
from argentum.schemas import SCHEMAS, empty

#: The commands whose last run is reported, in order.
COMMANDS = ["scan", "faces", "embed", "classify", "dedupe", "fix-dates", "prune", "locations"]


def utc_text() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")


def status(runs: DataFrame, locked: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per tracked command: never run, its last status, or crashed if it runs without its lock."""
    spark = runs.sparkSession
    known = spark.createDataFrame([(i, c, c in locked) for i, c in enumerate(COMMANDS)], "pos int, command string, locked boolean")
    rows = known.join(runs.select("command", "status", "started_at", "duration_ms"), "command", "left")
    state = F.when((F.col("status") == "running") & ~F.col("locked"), "crashed").otherwise(F.coalesce("status", F.lit("never")))
    return rows.select("pos", "command", state.alias("state"), "started_at", "duration_ms").orderBy("pos")


def has_problem(states: DataFrame) -> DataFrame:
    """One row: whether any command failed or crashed."""
    return states.agg(F.coalesce(F.bool_or(F.col("state").isin("failed", "crashed")), F.lit(False)).alias("has_problem"))


def finished(runs: DataFrame, command: str, started: str, state: str, ms: int | None, summary: str | None) -> DataFrame:
    """The ledger with the command's row replaced."""
    row = (command, started, None if state == "running" else utc_text(), state, ms, summary)
    return upsert(runs, runs.sparkSession.createDataFrame([row], SCHEMAS["pipeline_runs"]), ["command"])


class Locks:
    """Exclusive advisory locks in a folder of the driver, one for each command."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def path(self, command: str) -> str:
        return os.path.join(self.folder, f"{command}.lock")

    @contextmanager
    def hold(self, command: str):
        with open(self.path(command), "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                raise RuntimeError(f"{command} is already running") from None
            yield

    def is_locked(self, command: str) -> bool:
        if not os.path.exists(self.path(command)):
            return False
        with open(self.path(command)) as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                return False
            except BlockingIOError:
                return True

    def clear_legacy(self, folder: str) -> list[str]:
        """Delete lock files of an older layout that nobody holds."""
        gone = []
        for n in sorted(os.listdir(folder)):
            if n.endswith(".lock"):
                with open(os.path.join(folder, n)) as f:
                    try:
                        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    except BlockingIOError:
                        continue
                os.unlink(os.path.join(folder, n))
                gone.append(n)
        return gone


class Ledger:
    """Reads and writes the ledger of a library."""

    def __init__(self, spark: SparkSession, read, write, locks: Locks):
        self.spark, self.read, self.write, self.locks = spark, read, write, locks

    @contextmanager
    def track(self, command: str):
        """Record a run: running, then success with a summary, failed, or interrupted."""
        with self.locks.hold(command):
            started, began, note = utc_text(), time.monotonic(), {}
            self.write(finished(self.read(), command, started, "running", None, None))
            try:
                yield note
            except BaseException as e:
                state = "interrupted" if isinstance(e, KeyboardInterrupt) else "failed"
                self.write(finished(self.read(), command, started, state, int((time.monotonic() - began) * 1000), str(e)[:200]))
                raise
            self.write(finished(self.read(), command, started, "success", int((time.monotonic() - began) * 1000), note.get("summary")))

    def status(self) -> DataFrame:
        return status(self.read(), [c for c in COMMANDS if self.locks.is_locked(c)])


def interrupt_as_exception() -> None:
    """A first interrupt unwinds running commands, so that ``track`` records them."""
    signal.signal(signal.SIGINT, signal.default_int_handler)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return empty(spark, "pipeline_runs")
