"""Watching folders: a stream of changed session files, taken in anew in batches.

Spark's file stream never reads a file again that has grown, so the source here lists files and their modification times
and gives those whose time has changed. What it gave is kept as a log of changes in numbered files, of which the stream's offset
is the last number, so an offset is as small with a million files as with one; now and then the log is made one file of all
that is known. A file comes when it has been quiet for the debounce, so one that is being written comes once, after its last
change. Stores (SQLite) are looked at once an interval.
"""

import hashlib
import json
import os
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.roots import session_files


STORES = (".db", ".sqlite")
#: Files taken in by one change of the vault, and so held by the driver, at most.
FILES_A_CHANGE = 1_000
#: Changes after which the log is compacted.
COMPACTED = 100


class ChangeLog:
    """Numbered files of lines [path, time], the time null where a file went. Number k with all that is known at k ends in `.all`."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _name(self, number: int, whole: bool = False) -> str:
        return os.path.join(self.folder, f"{number:012d}{'.all' if whole else ''}")

    def write(self, number: int, rows: list[tuple[str, float | None]], whole: bool = False) -> None:
        """Whole or not at all; a number that was written and never came to count is written again."""
        aside = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        with open(aside, "w", encoding="utf-8", errors="surrogateescape") as f:
            f.writelines(json.dumps(row) + "\n" for row in rows)
            f.flush()
            os.fsync(f.fileno())
        os.replace(aside, self._name(number, whole))

    def read(self, number: int, whole: bool = False) -> list[tuple[str, float | None]]:
        with open(self._name(number, whole), encoding="utf-8", errors="surrogateescape") as f:
            return [tuple(json.loads(line)) for line in f]

    def known(self, upto: int) -> dict[str, float]:
        """Files and their times as of a number."""
        found = (int(n.removesuffix(".all")) for n in os.listdir(self.folder) if n.endswith(".all") and not n.startswith("."))
        base = max((n for n in found if n <= upto), default=0)
        out = dict(self.read(base, whole=True)) if base else {}
        for number in range(base + 1, upto + 1):
            out.update(self.read(number))
        return {name: at for name, at in out.items() if at is not None}

    def compact(self, upto: int) -> None:
        """Keep what is known at a number in one file, and drop the changes before it."""
        self.write(upto, sorted(self.known(upto).items()), whole=True)
        for name in os.listdir(self.folder):
            if not name.startswith(".") and (int(name.removesuffix(".all")) < upto or name == os.path.basename(self._name(upto))):
                os.unlink(os.path.join(self.folder, name))


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.paths, self.log = json.loads(options["paths"]), ChangeLog(options["log"])
        self.debounce, self.interval = float(options.get("debounce", "0")), float(options.get("interval", "0"))
        self.polled = 0.0  # after a new start stores are looked at at once
        self.known, self.at = {}, 0

    def initialOffset(self):
        return {"n": 0}

    def _list(self) -> dict[str, float]:
        return {name: at for path in self.paths for name, at in session_files(path).items()}

    def read(self, start):
        if self.at != start["n"]:
            self.known, self.at = self.log.known(start["n"]), start["n"]
        now, files = time.time(), self._list()
        poll = now - self.polled >= self.interval
        self.polled = now if poll else self.polled
        due = lambda name, at: poll if name.endswith(STORES) else now - at >= self.debounce
        changed = sorted((name, at) for name, at in files.items() if self.known.get(name) != at and due(name, at))
        gone = [(name, None) for name in self.known.keys() - files.keys()]
        if not changed and not gone:
            return iter(()), start
        self.log.write(start["n"] + 1, changed + gone)
        self.known.update(changed)
        for name, _ in gone:
            del self.known[name]
        self.at = start["n"] + 1
        return iter(changed), {"n": self.at}

    def readBetweenOffsets(self, start, end):
        rows = {}
        for number in range(start["n"] + 1, end["n"] + 1):
            rows.update(self.log.read(number))
        return iter(sorted((name, at) for name, at in rows.items() if at is not None))

    def commit(self, end):
        if end["n"] and end["n"] % COMPACTED == 0:
            self.log.compact(end["n"])


class SessionChanges(DataSource):
    """Format `session_changes`: path and mtime of session files that are new or have changed. Options: paths (a JSON list), log (a
    folder on the driver's machine, where the watched files are too), debounce and interval (seconds)."""

    @classmethod
    def name(cls):
        return "session_changes"

    def schema(self):
        return "path string, mtime double"

    def simpleStreamReader(self, schema):
        return _Changes(self.options)


def changes(spark: SparkSession, paths: list[str], log: str, debounce: float = 0.0, interval: float = 0.0) -> DataFrame:
    spark.dataSource.register(SessionChanges)
    reader = spark.readStream.format("session_changes").option("paths", json.dumps(paths)).option("log", log)
    return reader.option("debounce", str(debounce)).option("interval", str(interval)).load()


def _local(folder: str) -> str | None:
    if "://" in folder and not folder.startswith("file://"):
        return None
    return unquote(urlparse(folder).path) if folder.startswith("file:") else folder


def take_in(vault, report=print):
    """A batch function: the changed files are taken in together, FILES_A_CHANGE at a time, stores by themselves. If that
    fails each file is taken in by itself, and one that fails is told, recorded as an erratum, and stops no other."""

    def alone(paths: list[str]) -> None:
        for path in paths:
            try:
                vault.ingest(path)
            except Exception as e:  # noqa: BLE001
                report(f"{path}: {e}")
                try:
                    vault.note(path, str(e))
                except Exception as more:  # noqa: BLE001
                    report(f"{path} can't be noted: {more}")

    def together(paths: list[str]) -> None:
        try:
            if paths:
                vault.ingest(paths)
        except Exception:  # noqa: BLE001
            alone(paths)

    def batch(rows: DataFrame, number: int) -> None:
        files: list[str] = []
        for row in rows.select("path").distinct().orderBy("path").toLocalIterator():
            if row.path.endswith(STORES):
                alone([row.path])
                continue
            files.append(row.path)
            if len(files) == FILES_A_CHANGE:
                together(files)
                files = []
        together(files)

    return batch


def watch(
    vault, paths: list[str], checkpoint: str, debounce_ms: int = 1500, once: bool = False, report=print, interval_s: float = 60.0, log: str | None = None
):
    """Start the stream; with once, take in what has changed since the last time, at once, and stop. The log of changes lies in
    a folder of this machine: the one named, or beside the checkpoint, or, if that is on another file system, in the home."""
    log = log or _local(f"{checkpoint.rstrip('/')}-changes")
    log = log or os.path.expanduser(f"~/.cache/colloquy/{hashlib.sha256(checkpoint.encode()).hexdigest()}")
    rows = changes(vault.spark, paths, log) if once else changes(vault.spark, paths, log, debounce_ms / 1000, interval_s)
    stream = rows.writeStream.foreachBatch(take_in(vault, report)).option("checkpointLocation", checkpoint)
    if not once:
        return stream.trigger(processingTime=f"{max(1, min(debounce_ms, 500))} milliseconds").start()
    query = stream.trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    return query
