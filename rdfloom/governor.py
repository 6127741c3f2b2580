"""Room for queries: each reserves memory by an estimate of its result and waits until there is some."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from rdfloom.config import Settings
from rdfloom.errors import Busy

#: Bytes that a value of a result is taken to need while a query runs.
VALUE_BYTES = 36


def reservation(rows: int, width: int, settings: Settings) -> int:
    """MB for a result of so many rows and variables, within the settings' bounds."""
    need = -(-rows * width * VALUE_BYTES // (1 << 20))
    return max(settings.memory_mb_least, min(settings.memory_mb, need))


class Governor:
    """At most max_concurrent queries, and at most memory_mb reserved, at a time."""

    def __init__(self, settings: Settings):
        self.settings, self.free, self.running = settings, max(settings.memory_mb, settings.memory_mb_least), 0
        self._changed = threading.Condition()

    @contextmanager
    def room(self, mb: int) -> Iterator[None]:
        """Held while a query runs; Busy if there is no room in time."""
        mb = min(mb, max(self.settings.memory_mb, self.settings.memory_mb_least))
        until = time.monotonic() + self.settings.queue_timeout
        with self._changed:
            while self.running >= max(1, self.settings.max_concurrent) or self.free < mb:
                if not self._changed.wait(max(0.0, until - time.monotonic())) and time.monotonic() >= until:
                    raise Busy
            self.running += 1
            self.free -= mb
        try:
            yield
        finally:
            with self._changed:
                self.running -= 1
                self.free += mb
                self._changed.notify_all()
