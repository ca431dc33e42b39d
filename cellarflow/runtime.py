"""Session helpers: the shared folder, written intermediate tables, size checks before a broadcast."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 16 << 20
#: Whether the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()
_LOCK, _WRITING, _BEFORE = threading.Lock(), [], []


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once per application, so that it needs no installation there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.suffix or not root.is_dir():  # already running from a sent archive
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="cellarflow-code-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where it is unset and Spark runs in this one process a temporary folder is made; on a cluster
    without the setting this raises, for a machine's own folder would not be seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(shared_dir, "_own", None) or "file://" + tempfile.mkdtemp(prefix="cellarflow-")
        shared_dir._own = found  # type: ignore[attr-defined]
    return found.rstrip("/")


_RUN = uuid.uuid4().hex


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below this process's part of the shared folder."""
    return f"{shared_dir(spark)}/cellarflow/{_RUN}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables that this process has written; results that still read them are lost."""
    delete_path(spark, f"{shared_dir(spark)}/cellarflow/{_RUN}")


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """CLEANUP while at least one thread is in here, then what was set before the first came."""
    with _LOCK:
        if not _WRITING:
            _BEFORE[:] = [spark.conf.get(CLEANUP, None)]
            spark.conf.set(CLEANUP, "true")
        _WRITING.append(1)
    try:
        yield
    finally:
        with _LOCK:
            _WRITING.pop()
            if not _WRITING:
                spark.conf.unset(CLEANUP) if _BEFORE[0] is None else spark.conf.set(CLEANUP, _BEFORE[0])


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.

    The shuffle files of the write go as soon as it is done; else they would stay until the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_path(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = hadoop_path(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its whole text; False if it is there already.

    The text is written beside and then linked (local file systems) or renamed without overwriting (others), so no reader
    ever meets a part of it, a crash leaves at most a stray .tmp file, and of two writers just one gets True.
    """
    fs, at = hadoop_path(spark, path)
    sc = spark.sparkContext
    beside = sc._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() == "file":
            os.link(beside.toUri().getPath(), at.toUri().getPath())
            return True
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = sc._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), sc._jsc.hadoopConfiguration()).rename(beside, at, options)
        return True
    except Exception as e:  # noqa: BLE001 - py4j wraps Java's exceptions
        if fs.exists(at):
            return False
        raise e
    finally:
        fs.delete(beside, False)


def newest_number(spark: SparkSession, folder: str) -> int:
    """The largest n of the files 1.json .. n.json of a folder, 0 if there is none; numbers without gaps, found by bisection
    instead of a listing."""
    there = lambda n: exists(spark, f"{folder}/{n}.json")
    low, high = 0, 1
    while there(high):
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if there(middle) else (low, middle)
    return low


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """A broadcast hint only where a known number of rows proves that the side is small; else Spark joins by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
