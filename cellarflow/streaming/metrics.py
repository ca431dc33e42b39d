"""Counts and times of streams and batches, kept by a listener and given as text that monitors can read."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds, in seconds, of the buckets that batch times are counted in.
BOUNDS = (0.1, 0.5, 1.0, 5.0, 15.0, 60.0, 300.0)


class Metrics(StreamingQueryListener):
    """Counters, gauges and one histogram; add it with spark.streams.addListener, or feed it by count and time."""

    def __init__(self) -> None:
        super().__init__()
        self._lock = threading.Lock()
        self.counters: dict[str, float] = defaultdict(float)
        self.gauges: dict[str, float] = {}
        self.times: dict[str, list[float]] = {}

    def count(self, name: str, n: float = 1) -> None:
        with self._lock:
            self.counters[name] += n

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self.gauges[name] = value

    def time(self, name: str, seconds: float) -> None:
        """Counts a duration in its bucket; the last two entries are the number of durations and their sum."""
        with self._lock:
            row = self.times.setdefault(name, [0.0] * (len(BOUNDS) + 2))
            for i, bound in enumerate(BOUNDS):
                row[i] += seconds <= bound
            row[-2] += 1
            row[-1] += seconds

    def onQueryStarted(self, event) -> None:
        self.count("streams_started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.count("stream_batches")
        self.count("stream_rows", p.numInputRows)
        self.gauge("stream_last_batch", p.batchId)
        self.time("stream_batch_seconds", p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        self.count("stream_idle")

    def onQueryTerminated(self, event) -> None:
        self.count("streams_failed" if event.exception else "streams_ended")

    def text(self, prefix: str = "cellarflow") -> str:
        """One metric a line: name and value, with the bucket's bound in braces."""
        with self._lock:
            lines = [f"{prefix}_{n} {v:g}" for n, v in sorted({**self.counters, **self.gauges}.items())]
            for n, row in sorted(self.times.items()):
                lines += [f'{prefix}_{n}_bucket{{le="{b:g}"}} {v:g}' for b, v in zip(BOUNDS, row)]
                lines += [f'{prefix}_{n}_bucket{{le="+Inf"}} {row[-2]:g}', f"{prefix}_{n}_count {row[-2]:g}", f"{prefix}_{n}_sum {row[-1]:g}"]
        return "\n".join(lines) + "\n"
