"""Session stores in SQLite files, as a data source of rows by table.

A store that every machine sees as a file is read where it lies: each table is cut into ranges of row ids, and each range is a
task. Conditions on the kind and the table of rows go to the source, so what asks for sessions reads no messages. Stores that
only Spark's file systems reach come as bytes instead, up to 2 GB each, to a task that opens a copy in a folder of its own.
Either way a store is read as it was last checkpointed; its write-ahead log isn't.
"""

import json
import os
import sqlite3
import stat
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from ..operators.periods import Recency

# What is asked of each kind of store, within a bound on the sessions' start.
QUERIES = {
    "opencode": {
        "session": "SELECT id, parent_id, directory, title, time_created, time_updated, model, tokens_input, tokens_output, tokens_cache_read, tokens_cache_write FROM session WHERE time_created >= {since_ms} ORDER BY time_created",
        "message": "SELECT id, session_id, time_created, data FROM message WHERE session_id IN (SELECT id FROM session WHERE time_created >= {since_ms})",
        "part": "SELECT id, message_id, time_created, data FROM part WHERE message_id IN (SELECT m.id FROM message m JOIN session s ON s.id = m.session_id WHERE s.time_created >= {since_ms})",
    },
    "hermes": {
        "session": "SELECT * FROM sessions WHERE archived = 0 AND started_at >= {since_s} ORDER BY started_at",
        "every": "SELECT id, source FROM sessions",
        "message": "SELECT id, session_id, role, content, tool_call_id, tool_calls, reasoning_content, timestamp FROM messages WHERE active = 1 AND session_id IN (SELECT id FROM sessions WHERE archived = 0 AND started_at >= {since_s})",
    },
}
MARKER = {"hermes": "compression_locks"}


#: Rows of a table that one task reads, and of an Arrow batch.
ROWS_A_TASK, ROWS_A_BATCH = 50_000, 1_000
NAMES = ["path", "kind", "table", "row"]
ROWS = "path string, kind string, table string, row string"


def _open(name: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(name)}?mode=ro&immutable=1", uri=True)


def _kind(db: sqlite3.Connection) -> str:
    names = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    return "hermes" if MARKER["hermes"] in names else "opencode"


def _asked(kind: str, table: str, since: float) -> tuple[str, str, str]:
    """What is asked of a table, its name in the store, and the condition that a range of its rows adds."""
    query = QUERIES[kind][table].format(since_ms=int(since * 1000), since_s=since)
    name = query.partition(" FROM ")[2].split()[0]
    return query, name, f"{name}.rowid BETWEEN ? AND ?"


def _ranged(query: str, condition: str) -> str:
    query, order, by = query.partition(" ORDER BY ")
    head, tail = query.split(" FROM ", 1)
    return f"{head} FROM {tail}{' AND ' if ' WHERE ' in tail else ' WHERE '}{condition}{order}{by}"


def _batches(path: str, kind: str, table: str, cursor) -> Iterator[pa.RecordBatch]:
    names = [c[0] for c in cursor.description]
    while rows := cursor.fetchmany(ROWS_A_BATCH):
        data = [json.dumps({n: x.decode(errors="replace") if isinstance(x, bytes) else x for n, x in zip(names, row)}) for row in rows]
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(rows), pa.string()) for x in (path, kind, table)] + [pa.array(data, pa.string())], NAMES)


def _broken(path: str, e: Exception) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (path, "broken", "error", json.dumps(str(e)))], NAMES)


@dataclass
class _Range(InputPartition):
    """Rows of a table from one id to another, or what is wrong with the store."""

    name: str
    kind: str
    table: str
    first: int = 0
    last: int = 0
    error: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.names, self.since = json.loads(options["paths"]), float(options["since"])
        self.rows = int(options.get("rows", ROWS_A_TASK))
        self.only: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute[0] in NAMES:
                continue  # none is ever null
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in ("kind", "table"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only.get(column, values) & values
            else:
                yield f

    def _holds(self, kind: str, table: str) -> bool:
        return kind in self.only.get("kind", {kind}) and table in self.only.get("table", {table})

    def partitions(self):
        out = []
        for name in self.names:
            try:
                db = _open(name)
                try:
                    kind = _kind(db)
                    for table in QUERIES[kind]:
                        if self._holds(kind, table):
                            own = _asked(kind, table, self.since)[1]
                            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {own}").fetchone()
                            out += [_Range(name, kind, table, at, min(high, at + self.rows - 1)) for at in range(low, high + 1, self.rows)] if low is not None else []
                finally:
                    db.close()
            except sqlite3.Error as e:
                if self._holds("broken", "error"):
                    out.append(_Range(name, "broken", "error", error=str(e)))
        return out or [None]

    def read(self, partition):
        if partition is None:
            return
        path = f"file://{quote(partition.name)}"
        if partition.error is not None:
            yield _broken(path, ValueError(partition.error))
            return
        db = _open(partition.name)
        try:
            query, _, condition = _asked(partition.kind, partition.table, self.since)
            yield from _batches(path, partition.kind, partition.table, db.execute(_ranged(query, condition), (partition.first, partition.last)))
        except sqlite3.Error as e:
            if self._holds("broken", "error"):
                yield _broken(path, e)
        finally:
            db.close()


class SqliteStores(DataSource):
    """Format `session_stores`: rows (JSON) of the tables of SQLite files. Options: paths (a JSON list of files), since (seconds),
    rows (row ids a task)."""

    @classmethod
    def name(cls):
        return "session_stores"

    def schema(self):
        return ROWS

    def reader(self, schema):
        return _Reader(self.options)


def _files(path: str) -> list[str] | None:
    """The stores at a path that every machine sees as files; None for other file systems."""
    if "://" in path and not path.startswith("file://"):
        return None
    path = unquote(urlparse(path).path) if path.startswith("file:") else path
    if stat.S_ISDIR(os.stat(path).st_mode):
        return sorted(os.path.join(folder, n) for folder, _, names in os.walk(path) for n in names if n.endswith((".db", ".sqlite")))
    return [path]


def store_rows(spark: SparkSession, path: str, recency: Recency = Recency(), rows: int = ROWS_A_TASK) -> DataFrame:
    """path, kind, table and row (JSON) of every .db and .sqlite file under a path. What is broken is a row of kind `broken`."""
    since = recency.cutoff.timestamp() if recency.cutoff else 0.0
    names = _files(path)
    if names is None:
        return _bytes_rows(spark, path, since)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteStores)
    return spark.read.format("session_stores").option("paths", json.dumps(names)).option("since", str(since)).option("rows", str(rows)).load()


def _bytes_rows(spark: SparkSession, path: str, since: float) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not path.endswith((".db", ".sqlite")):
        reader = reader.option("pathGlobFilter", "*.{db,sqlite}")

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                with tempfile.TemporaryDirectory() as folder:
                    copy = os.path.join(folder, "store.db")
                    with open(copy, "wb") as f:
                        f.write(batch.column(1)[k].as_buffer())
                    db = sqlite3.connect(copy)
                    try:
                        kind = _kind(db)
                        for table in QUERIES[kind]:
                            yield from _batches(name, kind, table, db.execute(_asked(kind, table, since)[0]))
                    except sqlite3.Error as e:
                        yield _broken(name, e)
                    finally:
                        db.close()

    return reader.load(path).select("path", "content").mapInArrow(read, ROWS)


def table_of(rows: DataFrame, kind: str, table: str, schema: str) -> DataFrame:
    """One table of the stores of a kind, typed; file is the store's path."""
    found = rows.where((F.col("kind") == kind) & (F.col("table") == table))
    return found.select(F.col("path").alias("file"), F.from_json("row", schema).alias("r")).select("file", "r.*")
