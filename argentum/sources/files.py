"""Reading files from the path: seeking sources, digests in blocks, and bounds on the time a read may take."""

from __future__ import annotations

import hashlib
import os
import threading
from collections.abc import Callable
from contextlib import contextmanager

#: Seconds for a file's status; seconds to read a file: a floor, and a rate in megabytes a second.
STAT_S, FLOOR_S, RATE_MB = 5, 20, 20
BLOCK = 1 << 20


def read_budget(size: int, rate_mb: int = RATE_MB, floor_s: float = FLOOR_S) -> float:
    """Seconds that reading a file of this size may take; a rate of 0 means the default."""
    return max(floor_s, size / ((rate_mb or RATE_MB) * 1_000_000))


def within(seconds: float, work: Callable, *args):
    """The result of ``work(*args, late)``, or TimeoutError after so many seconds; ``late`` is an event that is set then.

    Work that hangs in the system is left behind in its thread, so the caller goes on.
    """
    got: list = []
    late = threading.Event()

    def run():
        try:
            got.append((work(*args, late), None))
        except Exception as e:
            got.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        late.set()
        raise TimeoutError(f"no answer within {seconds:g} s")
    value, error = got[0]
    if error is not None:
        raise error
    return value


class FileSource:
    """Bytes of an open file at any place, without reading the rest."""

    def __init__(self, fd: int):
        self.fd, self.size = fd, os.fstat(fd).st_size

    def read(self, at: int, n: int) -> bytes:
        parts = []
        while n > 0 and (part := os.pread(self.fd, n, at)):
            parts.append(part)
            at, n = at + len(part), n - len(part)
        return b"".join(parts)


@contextmanager
def opened(path: str):
    fd = os.open(path, os.O_RDONLY)
    try:
        yield FileSource(fd)
    finally:
        os.close(fd)


def digest(path: str, late: threading.Event) -> tuple[str, bytes]:
    """(SHA-256, first bytes) of a file, read in blocks until it is late."""
    state, head = hashlib.sha256(), b""
    with open(path, "rb", buffering=0) as f:
        while block := f.read(BLOCK):
            if late.is_set():
                raise TimeoutError
            head = head or block[:64]
            state.update(block)
    return state.hexdigest(), head
