"""One writer at a time: a lease in a file of the shared folder, and a guard against runs that overlap."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from cellarflow.runtime import exists, hadoop_path, newest_number, put_new, read_text


class FileLease:
    """A lease that its holder renews; after ttl seconds without that another may take it.

    Taking it creates the next numbered file of a folder, which only one of several takers can do. The number is the fence:
    whoever holds a smaller one has lost. The holder's renewals go into a file beside its number; one that cannot be read, for it
    is being written, counts as a renewal.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: float = 60.0, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.ttl, self.clock, self.owner = spark, path, ttl, clock, uuid.uuid4().hex
        self.fence = 0

    def _holder(self) -> tuple[int, str | None, float]:
        """The newest number, its owner and until when it is held."""
        n = newest_number(self.spark, self.path)
        if not n:
            return 0, None, 0.0
        held = json.loads(read_text(self.spark, f"{self.path}/{n}.json"))
        try:
            until = float(read_text(self.spark, f"{self.path}/{n}.until")) if exists(self.spark, f"{self.path}/{n}.until") else held["until"]
        except Exception:  # noqa: BLE001 - the holder is writing it
            until = self.clock() + self.ttl
        return n, held["owner"], until

    def _until(self, at: float) -> None:
        fs, path = hadoop_path(self.spark, f"{self.path}/{self.fence}.until")
        stream = fs.create(path, True)
        stream.write(bytearray(repr(at).encode()))
        stream.close()

    def acquire(self) -> bool:
        n, owner, until = self._holder()
        if owner == self.owner and n == self.fence and until > self.clock():
            self._until(self.clock() + self.ttl)
            return True
        if until > self.clock():
            return False
        if put_new(self.spark, f"{self.path}/{n + 1}.json", json.dumps({"owner": self.owner, "until": self.clock() + self.ttl})):
            self.fence = n + 1
            return True
        return False

    def lost(self) -> bool:
        n, owner, until = self._holder()
        return owner != self.owner or n != self.fence or until <= self.clock()

    def release(self) -> None:
        if not self.lost():
            self._until(0.0)


class RunGuard:
    """Lets one run through at a time; a call within debounce seconds of the last start is passed over."""

    def __init__(self, run: Callable[[], None], debounce: float = 0.0, clock: Callable[[], float] = time.monotonic) -> None:
        self._run, self._debounce, self._clock, self._lock, self._started = run, debounce, clock, threading.Lock(), None
        self.last_error: Exception | None = None

    def trigger(self) -> bool:
        """Whether this call ran; an error of the run is kept in last_error and never leaves."""
        if not self._lock.acquire(blocking=False):
            return False
        try:
            now = self._clock()
            if self._started is not None and now - self._started < self._debounce:
                return False
            self._started = now
            try:
                self._run()
                self.last_error = None
            except Exception as e:  # noqa: BLE001
                self.last_error = e
            return True
        finally:
            self._lock.release()
