"""Commits in a shared folder: unique data folders, made visible by a marker that only one writer can create.

A writer writes any data below ``stage()``, a folder that nobody else uses, and then publishes it under the next number.
The marker names the data folder; it is written aside in full and then moved to its place without overwriting, which the
file system does for one writer at most. A run that dies before leaves data that no marker names and that no reader
sees; a run that finds its number taken gets ``Conflict`` and has changed nothing.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_MARKER = re.compile(r"(\d{8})\.commit")


class Conflict(RuntimeError):
    """Another writer published this number first; its work stands, this one's is not visible."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._at()):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at())]
        return sorted(int(m[1]) for m in map(_MARKER.fullmatch, names) if m)

    def folder(self, number: int) -> str:
        """The data folder that a commit names."""
        stream = self._fs.open(self._at(f"{number:08d}.commit"))
        try:
            name = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return f"{self.path}/{name}"

    def folders(self) -> list[str]:
        return [self.folder(n) for n in self.numbers()]

    def stage(self) -> str:
        return f"{self.path}/data-{uuid.uuid4().hex}"

    def publish(self, staged: str, number: int) -> int:
        """Make a staged folder the commit of this number, or raise Conflict."""
        marker, aside = self._at(f"{number:08d}.commit"), self._at(f"_marker-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(staged.rsplit("/", 1)[-1].encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # the local file system's rename checks first and moves later
                files, file = self._jvm.java.nio.file.Files, self._jvm.java.io.File
                files.createLink(file(marker.toUri().getPath()).toPath(), file(aside.toUri().getPath()).toPath())
            else:
                renames = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(marker.toUri(), self._conf).rename(aside, marker, renames)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"{self.path}: commit {number} is another writer's") from None
            raise
        finally:
            self._fs.delete(aside, False)
        return number

    def sweep(self) -> int:
        """Delete data that no commit names; only for times without a running writer. Gives the number of folders."""
        if not self._fs.exists(self._at()):
            return 0
        kept = {f.rsplit("/", 1)[-1] for f in self.folders()}
        dead = [x.getPath() for x in self._fs.listStatus(self._at()) if x.getPath().getName().startswith(("data-", "_marker-")) and x.getPath().getName() not in kept]
        for p in dead:
            self._fs.delete(p, True)
        return len(dead)
