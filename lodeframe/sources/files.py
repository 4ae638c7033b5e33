"""Files by Hadoop's file systems: a dataset folder may be local, or in any store that Spark's configuration reaches."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

CHUNK = 1 << 20
#: Compressions, and the codecs that read and write them.
CODECS = {"gzip": "GzipCodec", "bzip2": "BZip2Codec"}


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    size: int
    is_file: bool

    @property
    def stem(self) -> str:
        return self.name.rsplit(".", 1)[0] if "." in self.name[1:] else self.name


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def list(self, folder: str) -> list[Entry]:
        """A folder's entries by name; of a file the file itself; of nothing nothing."""
        fs, p = self._at(folder)
        if not fs.exists(p):
            return []
        found = [Entry(s.getPath().toString(), s.getPath().getName(), s.getLen(), s.isFile()) for s in fs.listStatus(p)]
        return sorted(found, key=lambda e: e.name)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def head(self, path: str, n: int) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    def read(self, path: str) -> bytes:
        return self.head(path, self.size(path))

    def write(self, path: str, parts: bytes | Iterable[bytes]) -> int:
        """Writes a new file, or over an old one, and returns its size."""
        fs, p = self._at(path)
        stream, n = fs.create(p, True), 0
        try:
            for part in [parts] if isinstance(parts, bytes) else parts:
                for lo in range(0, len(part), CHUNK):
                    stream.write(bytearray(part[lo : lo + CHUNK]))
                n += len(part)
        finally:
            stream.close()
        return n

    def copy(self, source: str, target: str, compression: str | None = None, skip: int = 0) -> None:
        """A copy, without the content's first `skip` bytes. Nothing passes through Python."""
        (fs1, p1), (fs2, p2) = self._at(source), self._at(target)
        reader, writer = fs1.open(p1), fs2.create(p2, True)
        if skip and compression:
            codec = getattr(self.jvm.org.apache.hadoop.io.compress, CODECS[compression])()
            codec.setConf(self.conf)
            reader, writer = codec.createInputStream(reader), codec.createOutputStream(writer)
        if skip:
            reader.readNBytes(skip)
        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(reader, writer, CHUNK, True)

    def publish(self, path: str, raw: bytes) -> None:
        """Writes beside the path and renames, so that no reader sees half a file."""
        self.write(path + ".tmp", raw)
        fs, p = self._at(path)
        fs.delete(p, False)
        fs.rename(self.jvm.org.apache.hadoop.fs.Path(path + ".tmp"), p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
