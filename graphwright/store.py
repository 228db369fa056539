"""The folder that holds a graph: versions, a pointer that is swapped by rename, a write lock, facts
about the last sync. Works on any file system that Spark reaches."""

from __future__ import annotations

import json
import os
import socket
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: How long a sync waits for the lock, how often it looks, what a caller is told to wait.
WAIT_MS, LOOK_MS, RETRY_MS = 1000, 50, 1000
_writing: dict[str, threading.Lock] = {}
_guard = threading.Lock()


class Busy(RuntimeError):
    """Another sync is writing."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _read(self, name: str) -> str | None:
        fs, where = self._at(name)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Whole or not at all: a new file is renamed over the old one."""
        jvm = self.spark.sparkContext._jvm
        fs, new = self._at(f"{name}.new")
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(option, 1)
        over[0] = option.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, self._at(name)[1], over)

    def current(self) -> str | None:
        return self._read("CURRENT")

    def publish(self, version: str) -> None:
        """Points readers at version; the one before stays for those who still read it, older ones go."""
        before = self.current()
        self._write("CURRENT", version)
        fs, where = self._at()
        for entry in fs.listStatus(where):
            name = entry.getPath().getName()
            if name.startswith("v-") and name not in (version, before):
                fs.delete(entry.getPath(), True)

    def table(self, name: str) -> DataFrame:
        if (version := self.current()) is None:
            raise FileNotFoundError("the graph is not initialised; run sync")
        return self.spark.read.parquet(f"{self.path}/{version}/{name}")

    def metadata(self) -> dict:
        return json.loads(self._read("METADATA") or "{}")

    def note(self, **values: object) -> None:
        """Sets keys of the metadata, each with the time of its change."""
        now = int(time.time() * 1000)
        self._write("METADATA", json.dumps(self.metadata() | {k: {"value": v, "updated_at": now} for k, v in values.items()}))

    def _claim(self) -> bool:
        fs, where = self._at("LOCK")
        jvm = self.spark.sparkContext._jvm
        try:
            stream = fs.create(where, False)
        except Exception as e:  # noqa: BLE001  a lock file is there, or is being made
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            held = self._read("LOCK")
            owner = json.loads(held) if held else None
            age = time.time() * 1000 - (fs.getFileStatus(where).getModificationTime() if fs.exists(where) else 0)
            if owner is None and age > WAIT_MS or owner and owner["host"] == socket.gethostname() and not _alive(owner["pid"]):
                fs.delete(where, False)
            return False
        del jvm
        stream.write(bytearray(json.dumps({"pid": os.getpid(), "host": socket.gethostname()}).encode()))
        stream.close()
        return True

    @contextmanager
    def writing(self) -> Iterator[None]:
        """One writer at a time: at once among threads, within WAIT_MS among processes."""
        with _guard:
            mine = _writing.setdefault(self.path, threading.Lock())
        if not mine.acquire(blocking=False):
            raise Busy("a sync of this process is running")
        try:
            until = time.monotonic() + WAIT_MS / 1000
            while not self._claim():
                if time.monotonic() > until:
                    raise Busy("another process is syncing")
                time.sleep(LOOK_MS / 1000)
            try:
                yield
            finally:
                fs, where = self._at("LOCK")
                fs.delete(where, False)
        finally:
            mine.release()

    def clean(self) -> bool:
        fs, where = self._at()
        return fs.delete(where, True)


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True
