"""Event sources: files that land in a folder, and a table read by a (time, id) cursor; a registry of kinds."""

from __future__ import annotations

import heapq
import json
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RAW_EVENTS = "event_id string, idempotency_key string, user_id string, item_id string, event_type string, quantity string, occurred_at string"
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(kind: str, factory: Callable[..., DataFrame]) -> None:
    if kind in REGISTRY:
        raise ValueError(f"event source {kind} is registered already")
    REGISTRY[kind] = factory


def open_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    if kind not in REGISTRY:
        raise ValueError(f"no event source {kind}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind](spark, **options)


def files(spark: SparkSession, *, path: str, files_per_batch: int = 100, schema: str = RAW_EVENTS) -> DataFrame:
    """A stream over JSON files, each an object, an array or one object a line; the checkpoint remembers what was read.

    At most files_per_batch new files enter a batch, which bounds a backlog. Files that cannot be parsed give rows of nulls,
    which normalising rejects.
    """
    return spark.readStream.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", files_per_batch).json(path)


def parquet(spark: SparkSession, *, path: str, schema: str | T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class _Page(InputPartition):
    def __init__(self, path: str, after: list, upto: list) -> None:
        self.path, self.after, self.upto = path, after, upto


class _CursorReader(DataSourceStreamReader):
    """Offsets are (t, event_id) of the last row of a page, so equal times are split in the order of ids.

    A look for the next page finds the ends of up to AHEAD pages, so the keys behind the cursor are scanned once for so many; of
    the rows only those files and row groups are read whose times meet the page, each file in a task of its own. A page
    is given out when it is full, or window seconds after its first row was seen.
    """

    AHEAD = 200

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.size, self.schema = options["path"], int(options.get("page", 100)), schema
        self.window, self.clock = float(options.get("window", 0)), time.monotonic
        self.now, self.ends, self.waiting = [-(1 << 62), ""], [], None

    def _where(self, kind, after: list, upto: list | None):
        import pyarrow as pa
        import pyarrow.compute as pc

        at = lambda us: pa.scalar(us, pa.int64()).cast(pa.timestamp("us")).cast(kind)
        where = pc.field("event_id").is_valid() & pc.field("occurred_at").is_valid()
        if after[0] > -(1 << 62):
            where &= pc.field("occurred_at") >= at(after[0])
        return where if upto is None else where & (pc.field("occurred_at") <= at(upto[0]))

    def _scan(self, path: str, columns: list[str], after: list, upto: list | None = None):
        """Batches of the rows after one key and up to another, with their times in microseconds."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        table = ds.dataset(path, format="parquet")
        for batch in table.to_batches(columns=columns, filter=self._where(table.schema.field("occurred_at").type, after, upto)):
            yield batch, pc.cast(pc.cast(batch.column("occurred_at"), pa.timestamp("us")), pa.int64())

    def initialOffset(self) -> dict:
        return {"at": json.dumps([-(1 << 62), ""])}

    def latestOffset(self) -> dict:
        if not self.ends:
            most, keys = self.size * self.AHEAD, []
            for batch, t in self._scan(self.path, ["occurred_at", "event_id"], self.now):
                new = (k for k in map(list, zip(t.to_pylist(), batch.column("event_id").to_pylist(), strict=True)) if k > self.now)
                keys = heapq.nsmallest(most, [*keys, *heapq.nsmallest(most, new)])  # never more than twice AHEAD pages held
            self.ends = [keys[i] for i in range(self.size - 1, len(keys), self.size)]
            if not self.ends and keys:  # a page that is not full waits for its window
                self.waiting = self.clock() if self.waiting is None else self.waiting
                if self.clock() - self.waiting >= self.window:
                    self.ends = [keys[-1]]
        if self.ends:
            self.now, self.waiting = self.ends.pop(0), None
        return {"at": json.dumps(self.now)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        import pyarrow.dataset as ds

        after, upto = json.loads(start["at"]), json.loads(end["at"])
        if upto > self.now:
            self.now, self.ends = upto, []
        table = ds.dataset(self.path, format="parquet")
        files = table.get_fragments(filter=self._where(table.schema.field("occurred_at").type, after, upto))
        return [_Page(f.path, after, upto) for f in files] or [_Page(self.path, upto, upto)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        names = [f.name for f in self.schema]
        for batch, t in self._scan(partition.path, names, partition.after, partition.upto):
            for row, at in zip(batch.to_pylist(), t.to_pylist(), strict=True):
                if partition.after < [at, row["event_id"]] <= partition.upto:
                    when = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=at)
                    yield tuple(when if n == "occurred_at" else row.get(n) for n in names)

    def commit(self, end: dict) -> None:
        pass


class CursorSource(DataSource):
    """Pages of a parquet event table by (occurred_at, event_id); options path, page and window."""

    @classmethod
    def name(cls) -> str:
        return "event_cursor"

    def schema(self) -> str:
        return "event_id string, user_id string, item_id string, event_type string, quantity int, occurred_at timestamp"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _CursorReader(dict(self.options), schema)


def cursor(spark: SparkSession, *, path: str, page: int = 100, window: float = 0.0) -> DataFrame:
    """A stream of pages of a table that only grows at its end in (occurred_at, event_id); earlier rows are not seen.

    A batch comes after page events or window seconds, whichever is first.
    """
    spark.dataSource.register(CursorSource)
    return spark.readStream.format("event_cursor").option("path", path).option("page", page).option("window", window).load()


for _kind, _f in {"files": files, "parquet": parquet, "cursor": cursor}.items():
    register(_kind, _f)
