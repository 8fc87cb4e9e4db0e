"""Tables under one path that change by whole segments, safely among several writers.

A segment is a set of folders under a name that nobody else has. A manifest names the segments in order, newest last; it is
written aside, then renamed to its number, which succeeds for one writer only. Who comes second reads the newer manifest and
tries again on top of it. What a writer leaves behind that dies half way is in no manifest, so nothing reads it, and vacuuming
removes it once it is old. The file system has to refuse renaming to a name that is taken; local disks and HDFS do, object
stores only through a committer of theirs.
"""

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import SparkSession

from .errors import NotFound

#: How often a change is tried on top of what other writers have published, and the longest wait before it (seconds).
TRIES, LONGEST_WAIT = 60, 2.0


class Conflict(Exception):
    """What a change was made from has been replaced meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.place("x").getFileSystem(self._hadoop)

    def place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        return [name for name, _ in self.listing(folder)]

    def listing(self, folder: str) -> list[tuple[str, float]]:
        """Names in a folder and when they were changed."""
        if not self._fs.exists(self.place(folder)):
            return []
        return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in self._fs.listStatus(self.place(folder))]

    def remove(self, name: str) -> bool:
        return bool(self._fs.delete(self.place(name), True))

    @staticmethod
    def new_segment() -> str:
        return f"seg={uuid.uuid4().hex}"

    # Small files ---------------------------------------------------------------------------------------------------------

    def read(self, name: str) -> dict | None:
        """A JSON file's contents; None if there is no such file."""
        if not self._fs.exists(self.place(name)):
            return None
        stream = self._fs.open(self.place(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, contents: dict, replace: bool = False) -> bool:
        """Make a JSON file, whole or not at all. Without `replace` nothing happens if the file is there; returns whether it was
        made. It is written under a name that begins with a dot, which no listing counts."""
        folder, _, last = name.rpartition("/")
        aside, data = f"{folder}/.{last}.{uuid.uuid4().hex}", json.dumps(contents).encode()
        if self._fs.getScheme() == "file" and not replace:
            # a local rename replaces what is there, a link doesn't
            local = lambda n: unquote(self.place(n).toUri().getRawPath())
            os.makedirs(local(folder), exist_ok=True)
            with open(local(aside), "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(local(aside), local(name))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(local(aside))
        stream = self._fs.create(self.place(aside), False)
        stream.write(bytearray(data))
        stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.place(name).toUri(), self._hadoop)
        try:
            files.rename(self.place(aside), self.place(name), how)
            return True
        except Exception as e:  # noqa: BLE001
            self._fs.delete(self.place(aside), False)
            if "FileAlreadyExists" in str(e) and not replace:
                return False
            raise

    # Manifests -----------------------------------------------------------------------------------------------------------

    def latest(self) -> int | None:
        return max((int(n.split(".")[0]) for n in self.names("manifests") if n.endswith(".json") and not n.startswith(".")), default=None)

    def manifest(self) -> dict:
        for _ in range(TRIES):
            number = self.latest()
            if number is None:
                raise NotFound(f"no vault at {self.path}")
            found = self.read(f"manifests/{number:08d}.json")
            if found is not None:  # else vacuumed just now, so there is a newer one
                return found
        raise NotFound(f"no manifest can be read at {self.path}")

    def publish(self, manifest: dict) -> bool:
        """Publish a manifest under its version; False if another writer has that number already."""
        return self.write(f"manifests/{manifest['version']:08d}.json", manifest)

    def change(self, make: Callable[[dict], dict | None]) -> dict | None:
        """Publish what `make` makes of the latest manifest. If another writer is faster, `make` is asked again for the newer
        one; if it gives None, nothing is published."""
        for n in range(TRIES):
            before = self.manifest()
            after = make(before)
            if after is None:
                return None
            after = after | {"version": before["version"] + 1}
            if self.publish(after):
                return after
            time.sleep(random.uniform(0, min(LONGEST_WAIT, 0.01 * 2**n)))
        raise Conflict(f"{TRIES} other changes came first at {self.path}")
