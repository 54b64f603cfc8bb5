"""File-system calls on any storage Spark can reach (HDFS, object stores, local), through Hadoop's own classes."""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession


class SharedFiles:
    """Listing files and giving written folders their names."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def remove(self, path: str) -> None:
        """Remove a folder that this job has written and nobody reads any more."""
        self._fs(path).delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        """Names in a directory; empty only if the directory does not exist, any other failure is raised."""
        try:
            return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileNotFoundException":
                return []
            raise

    def publish_folder(self, part: str, path: str) -> None:
        """Give a completely written folder its name; FileExistsError (and the folder goes) if another has it."""
        self._rename_new(part, path)

    def _rename_new(self, part: str, path: str) -> None:
        none = SparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs(path).getUri(), self.conf)
        try:
            context.rename(self._path(part), self._path(path), none)
        except Py4JJavaError as e:
            self._fs(part).delete(self._path(part), True)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise FileExistsError(path) from e
            raise

    def fingerprint(self, *paths: str) -> str:
        """Digest of the names, sizes and modification times of all files under the paths that exist."""
        seen = []
        pending = [self._path(p) for p in paths if self.exists(p)]
        while pending:
            fs = pending[-1].getFileSystem(self.conf)
            for s in fs.listStatus(pending.pop()):
                if s.isDirectory():
                    pending.append(s.getPath())
                else:
                    seen.append((s.getPath().toUri().getPath(), s.getLen(), s.getModificationTime()))
        return hashlib.sha1(repr(sorted(seen)).encode()).hexdigest()[:12]
