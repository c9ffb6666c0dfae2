"""Whole files through Hadoop's FileSystem, so that a store can be in any place Spark can write to."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import StorageError


class Appender:
    def __init__(self, stream):
        self._stream = stream
        self._syncs = stream.hasCapability("hsync")

    def write(self, data: bytes) -> None:
        self._stream.write(bytearray(data))

    def sync(self) -> bool:
        """Brings the file's bytes to disk; False if that takes closing it."""
        if self._syncs:
            self._stream.hsync()
        return self._syncs

    def close(self) -> None:
        self._stream.close()


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def is_file(self, name: str = "") -> bool:
        return self.exists(name) and self.fs.getFileStatus(self._path(name)).isFile()

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def make(self, folder: str) -> None:
        self.fs.mkdirs(self._path(folder))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Writes a new file and brings it to disk."""
        stream = self.fs.create(self._path(name), True)
        stream.write(bytearray(data))
        stream.hsync()
        stream.close()

    def move(self, name: str, target: str) -> None:
        """Gives a file or folder another name, under which there is nothing yet."""
        if self.exists(target) or not self.fs.rename(self._path(name), self._path(target)):
            raise StorageError(f"{target} can't be put in place")

    def replace(self, name: str, data: bytes) -> None:
        """Puts a file in the place of another; either is there whole."""
        folder, _, base = name.rpartition("/")
        self.write(f"{folder}/.{base}.new", data)
        self.delete(name)
        self.fs.rename(self._path(f"{folder}/.{base}.new"), self._path(name))

    def appender(self, name: str) -> Appender:
        """A new file that is written bit by bit."""
        fs = self.fs
        if self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.ChecksumFileSystem").isInstance(fs):
            fs = fs.getRawFileSystem()  # its checksums are written by whole chunks, so a sync would leave a tail behind
        return Appender(fs.create(self._path(name), True))

    def publish(self, name: str, data: bytes) -> None:
        """Makes a file appear whole or not at all; fails if it exists."""
        if self.exists(name):
            raise StorageError(f"{name} exists: another writer uses this store")
        folder, _, base = name.rpartition("/")
        hidden = f"{folder}/.{base}" if folder else f".{base}"
        self.write(hidden, data)
        if not self.fs.rename(self._path(hidden), self._path(name)):
            raise StorageError(f"{name} can't be published")
