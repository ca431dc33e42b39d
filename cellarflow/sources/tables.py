"""Tables at rest: parquet stores with versioned replacement, JDBC, manifests, artifacts and keyset pages."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarflow.runtime import delete_path, exists, hadoop_path, newest_number, put_new, read_text
from cellarflow.schemas import RECOMMENDATIONS

ARTIFACT_VERSION = 1
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")
_WRITES = re.compile(r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|call|copy)\b")


def table_name(name: str) -> str:
    """The name, if it is a plain table name, with or without a schema."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no table name")
    return name


def read_only(query: str) -> str:
    """The query, if it is a single SELECT."""
    text = query.strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", text) or ";" in text or "--" in text or "/*" in text or _WRITES.search(text):
        raise ValueError("only a single SELECT may be given")
    return text


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A scan that reads just the columns and row groups asked for."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, *, table: str | None = None, query: str | None = None, **options: str) -> DataFrame:
    """A table or a read-only query of a database; filters, columns and limits are pushed down by Spark."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return (reader.option("query", read_only(query)) if query else reader.option("dbtable", table_name(table or ""))).load()


def write_jdbc(df: DataFrame, url: str, table: str, *, append: bool = False, batch: int = 1000, **options: str) -> None:
    """Replaces the rows of a table (truncated, its definition kept) or appends to them."""
    df.write.format("jdbc").option("url", url).option("dbtable", table_name(table)).option("batchsize", batch).option("truncate", True).options(**options).mode("append" if append else "overwrite").save()


def replace_users_jdbc(rows: DataFrame, ids: DataFrame, url: str, table: str, **options: str) -> None:
    """Replaces the rows of the users in ids in a database table: all of it in one transaction, or nothing.

    Executors write the ids and the new rows into two tables beside it, in parallel; then one connection deletes and inserts
    by those tables and commits. options go to the writer (createTableColumnTypes for databases that cannot compare
    long texts); user and password also to the connection.
    """
    spark, wanted = rows.sparkSession, replace_ids(ids, rows)
    jvm = spark.sparkContext._jvm
    quote = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    stem = f"{table_name(table)}_{uuid.uuid4().hex[:8]}"
    types = options.pop("createTableColumnTypes", None)
    columns = ", ".join(quote(c) for c in rows.columns)
    typed = lambda names: {"createTableColumnTypes": ", ".join(t for t in types.split(", ") if t.split()[0] in names)} if types else {}
    props = jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            props.setProperty(name, options[name])
    write_jdbc(wanted, url, f"{stem}_ids", **typed(wanted.columns), **options)
    write_jdbc(rows, url, f"{stem}_rows", **typed(rows.columns), **options)
    link = jvm.java.sql.DriverManager.getConnection(url, props)
    link.setAutoCommit(False)
    run = link.createStatement().executeUpdate
    user = quote("user_id")
    try:
        run(f"delete from {table} where {user} in (select {user} from {stem}_ids)")
        run(f"insert into {table} ({columns}) select {columns} from {stem}_rows")
        link.commit()
    except Exception:
        link.rollback()
        raise
    finally:
        for part in ("ids", "rows"):
            run(f"drop table {stem}_{part}")
        link.commit()
        link.close()


def replace_ids(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The different ids to replace; rows of users not among them, or rows without any ids, raise."""
    wanted = ids.select(F.col("user_id").cast("string").alias("user_id")).where("user_id is not null").distinct()
    if "user_id" not in rows.columns:
        raise ValueError("rows need a user_id")
    if not rows.join(wanted, "user_id", "left_anti").isEmpty():
        raise ValueError("rows hold users that are not to be replaced")
    return wanted


def replace_users(existing: DataFrame, ids: DataFrame, rows: DataFrame) -> DataFrame:
    """existing without the users in ids, and the new rows."""
    return existing.join(ids.select("user_id").distinct(), "user_id", "left_anti").unionByName(rows.select(*existing.columns))


def keyset_page(events: DataFrame, cursor: tuple[int, str] | None, size: int) -> DataFrame:
    """The next size rows after the cursor (t, event_id) in that order; a heap per partition, not a sort."""
    rows = events.where("t is not null and event_id is not null")
    if cursor is not None:
        t, e = (F.lit(c) for c in cursor)
        rows = rows.where((F.col("t") > t) | ((F.col("t") == t) & (F.col("event_id") > e)))
    return rows.orderBy("t", "event_id").limit(size)


def count_after(events: DataFrame, cursor: tuple[int, str] | None, most: int = 10_000) -> int:
    """How many rows wait behind the cursor, counted to a bound for a health report."""
    rows = events.where("t is not null and event_id is not null")
    if cursor is not None:
        t, e = (F.lit(c) for c in cursor)
        rows = rows.where((F.col("t") > t) | ((F.col("t") == t) & (F.col("event_id") > e)))
    return rows.limit(most).count()


class Store:
    """A folder with input tables and versioned outputs.

    An output is written into a new folder and becomes current by a numbered file of its own, <name>.versions/<n>.json,
    that appears whole or not at all; the largest number is the current one. A reader never sees half a table or none,
    and a table can be replaced from rows that were read from it. Folders of older versions stay, for frames may still read
    them; vacuum deletes those behind the newest few.

    Recommendations lie in buckets by a hash of the user. A version names the folder of each bucket, so replacing some users
    writes their buckets only, and the others are shared with the version before. A replacement counts only as the version
    after the one it was computed from; where another writer was faster it is computed anew.
    """

    def __init__(self, spark: SparkSession, root: str, *, input_root: str | None = None, buckets: int = 64, attempts: int = 20) -> None:
        self.spark, self.root, self.input_root, self.buckets, self.attempts = spark, root.rstrip("/"), (input_root or root).rstrip("/"), buckets, attempts

    def read_input(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """events, and users and items where they are there; missing events raise."""
        at = lambda name: f"{self.input_root}/{name}.parquet"
        if not exists(self.spark, at("events")):
            raise FileNotFoundError(at("events"))
        optional = [self.spark.read.parquet(at(n)) if exists(self.spark, at(n)) else None for n in ("users", "items")]
        return self.spark.read.parquet(at("events")), optional[0], optional[1]

    def changed_at(self, name: str = "events") -> int | None:
        """The modification time of an input table in milliseconds; None if it is not there."""
        fs, at = hadoop_path(self.spark, f"{self.input_root}/{name}.parquet")
        return fs.getFileStatus(at).getModificationTime() if fs.exists(at) else None

    # versions

    def version(self, name: str) -> tuple[int, dict | None]:
        """The number and content of the current version of an output; (0, None) before the first."""
        n = newest_number(self.spark, f"{self.root}/{name}.versions")
        return n, json.loads(read_text(self.spark, f"{self.root}/{name}.versions/{n}.json")) if n else None

    def publish(self, name: str, make: Callable[[dict | None], dict]) -> dict:
        """Makes what make(current version) gives the next version; computed anew where another writer came in between."""
        for _ in range(self.attempts):
            n, current = self.version(name)
            entry = make(current)
            if put_new(self.spark, f"{self.root}/{name}.versions/{n + 1}.json", json.dumps(entry)):
                return entry
        raise RuntimeError(f"{name}: other writers were faster {self.attempts} times")

    def vacuum(self, keep: int = 3) -> int:
        """Deletes the folders of outputs that none of the newest versions names; returns how many. Frames that still read
        older versions, and writers that have not published yet, must be done."""
        used: set[str] = set()
        for name in ("recommendations", "items_snapshot", "artifact"):
            n = newest_number(self.spark, f"{self.root}/{name}.versions")
            for i in range(max(1, n - keep + 1), n + 1):
                entry = json.loads(read_text(self.spark, f"{self.root}/{name}.versions/{i}.json"))
                used |= {p.split("/")[0] for p in [entry.get("path", ""), *entry.get("buckets", {}).values()]}
        fs, at = hadoop_path(self.spark, self.root)
        old = [p for p in (x.getPath() for x in fs.listStatus(at)) if re.fullmatch(r"(recommendations|items_snapshot|artifact)-[0-9a-f]{32}", p.getName()) and p.getName() not in used]
        for p in old:
            fs.delete(p, True)
        return len(old)

    # recommendations

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")

    def _write_buckets(self, rows: DataFrame) -> tuple[dict[str, str], dict[str, int]]:
        """The folder and the number of users of each bucket that has rows. Sorted by user and rank, so that a look-up
        skips nearly all row groups; a bucket is spread over several tasks where there is much of it."""
        version = f"recommendations-{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType) for f in RECOMMENDATIONS]
        placed = rows.select(*columns, self._bucket().alias("bucket"), F.pmod(F.hash("user_id"), F.lit(16)).alias("_spread"))
        spread = placed.repartition("bucket", "_spread").sortWithinPartitions("bucket", "user_id", "rank").drop("_spread")
        spread.write.partitionBy("bucket").parquet(f"{self.root}/{version}")
        written = self.spark.read.schema("user_id string, bucket int").parquet(f"{self.root}/{version}")
        users = {str(r["bucket"]): r["n"] for r in written.groupBy("bucket").agg(F.countDistinct("user_id").alias("n")).collect()}  # a row per bucket
        return {b: f"{version}/bucket={b}" for b in users}, users

    def write_recommendations(self, rows: DataFrame) -> DataFrame:
        """Replaces the whole table."""
        buckets, users = self._write_buckets(rows)
        entry = self.publish("recommendations", lambda old: {"of": self.buckets, "buckets": buckets, "users": users, "batch": (old or {}).get("batch")})
        return self._rows(entry["buckets"].values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in folders]
        return self.spark.read.schema(RECOMMENDATIONS).parquet(*paths) if paths else self.spark.createDataFrame([], RECOMMENDATIONS)

    def read_recommendations(self, users: DataFrame | None = None) -> DataFrame:
        """All rows, or those of some users, of whose buckets only; an empty frame of the fixed schema before the first run."""
        entry = self.version("recommendations")[1]
        if entry is None:
            return self._rows([])
        if users is None:
            return self._rows(entry["buckets"].values())
        self.buckets = entry["of"]
        wanted = users.select("user_id").distinct()
        touched = {str(r[0]) for r in wanted.select(self._bucket()).distinct().collect()}  # at most as many as there are buckets
        return self._rows(p for b, p in entry["buckets"].items() if b in touched).join(wanted, "user_id", "left_semi")

    def count_users(self) -> int:
        """How many users the table has; kept with the version, nothing is read."""
        return sum(((self.version("recommendations")[1] or {}).get("users") or {}).values())

    def last_batch(self) -> int | None:
        """The number of the last micro-batch that the current version holds, whatever runs came after it."""
        return (self.version("recommendations")[1] or {}).get("batch")

    def replace_for_users(self, ids: DataFrame, rows: DataFrame, *, batch: int | None = None) -> int:
        """Replaces the rows of the users in ids; returns how many users the table then has. Only their buckets are read and
        written. batch is kept with the version, and a batch not above the last one is passed over."""
        wanted = replace_ids(ids, rows)

        def make(old: dict | None) -> dict:
            old = old or {"of": self.buckets, "buckets": {}, "users": {}, "batch": None}
            if batch is not None and old["batch"] is not None and old["batch"] >= batch:
                return old
            self.buckets = old["of"]
            touched = {str(r[0]) for r in wanted.select(self._bucket()).distinct().collect()}
            before = self._rows(p for b, p in old["buckets"].items() if b in touched)
            buckets, users = self._write_buckets(replace_users(before, wanted, rows))
            rest = lambda m: {b: x for b, x in m.items() if b not in touched}
            return {"of": self.buckets, "buckets": rest(old["buckets"]) | buckets, "users": rest(old["users"]) | users, "batch": old["batch"] if batch is None else batch}

        return sum(self.publish("recommendations", make)["users"].values())

    # items, manifests, artifacts

    def write_snapshot(self, items: DataFrame) -> None:
        path = f"items_snapshot-{uuid.uuid4().hex}"
        items.write.parquet(f"{self.root}/{path}")
        self.publish("items_snapshot", lambda old: {"path": path})

    def read_snapshot(self) -> DataFrame | None:
        entry = self.version("items_snapshot")[1]
        return self.spark.read.parquet(f"{self.root}/{entry['path']}") if entry else None

    def write_manifest(self, manifest: Mapping) -> None:
        """One file per run, named by time and mode; the newest by generated_at (UTC where it names no zone) is the current one."""
        at = datetime.fromisoformat(str(manifest["generated_at"]))
        stamp = (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y%m%d%H%M%S%f")
        mode = re.sub(r"\W", "", str(manifest.get("mode", "full")))
        put_new(self.spark, f"{self.root}/manifests/{stamp}-{mode}-{uuid.uuid4().hex[:8]}.json", json.dumps(dict(manifest)))

    def manifests(self, n: int = 1, mode: str | None = None) -> list[dict]:
        """The n newest manifests, of a mode if one is given, newest first; the names tell which, so only n files are opened."""
        fs, at = hadoop_path(self.spark, f"{self.root}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        named = sorted((x for x in names if x.endswith(".json") and mode in (None, x.split("-")[1])), reverse=True)
        return [json.loads(read_text(self.spark, f"{self.root}/manifests/{x}")) for x in named[:n]]

    def failed(self, batch: int, error: str) -> int:
        """Puts a failure of a micro-batch on record; returns how many there are of it, in this run and before."""
        folder = f"{self.root}/failures/{batch}"
        while not put_new(self.spark, f"{folder}/{(n := newest_number(self.spark, folder) + 1)}.json", json.dumps({"error": error[:500]})):
            pass
        return n

    def newest_incremental(self) -> dict | None:
        return next(iter(self.manifests(1, "incremental")), None)

    def write_artifact(self, tables: Mapping[str, DataFrame], meta: Mapping) -> None:
        """Tables and a description of a fitted state, current as one; nothing pickled."""
        path = f"artifact-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{path}/{table_name(name)}")
        self.publish("artifact", lambda old: {"path": path, "meta": {"version": ARTIFACT_VERSION, "tables": list(tables), **meta}})

    def read_artifact(self) -> tuple[dict, dict[str, DataFrame]]:
        entry = self.version("artifact")[1]
        if entry is None:
            raise FileNotFoundError(f"{self.root}/artifact.versions")
        meta = entry["meta"]
        if meta.get("version") != ARTIFACT_VERSION:
            raise ValueError(f"artifact version {meta.get('version')!r} cannot be read")
        return meta, {n: self.spark.read.parquet(f"{self.root}/{entry['path']}/{n}") for n in meta["tables"]}
