"""Immutable, versioned datasets: Parquet under data/<version>, a manifest under manifests/<version>.json, written last."""

from __future__ import annotations

import csv
import json
import os
import secrets
import tempfile
import time
import urllib.request
from collections.abc import Iterator
from functools import cached_property
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .. import types
from ..errors import CatalogError, IngestError
from ..operators.relational import storable
from . import ingest
from .files import CHUNK, Files
from .sniff import BOM, HEAD, clean, clean_all, head, sniff

#: Rows that a file holds at most.
ROWS_PER_FILE = 5_000_000
SUFFIXES = {"gzip": ".gz", "bzip2": ".bz2", None: ".csv"}
#: Suffixes by which Spark would decompress a file.
PACKED = (".gz", ".bz2", ".zst", ".deflate", ".snappy", ".lz4")


class Catalog:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self._folder, self.files = spark, folder, Files(spark)
        self.views: dict[str, DataFrame] = {}

    @cached_property
    def folder(self) -> str:
        """The folder given (any path that driver and executors share), or a temporary one if there is but one machine."""
        if self._folder:
            return str(self._folder).rstrip("/")
        if not self.spark.sparkContext.master.startswith("local"):
            raise CatalogError("a cluster needs a dataset folder that driver and executors share")
        return "file://" + tempfile.mkdtemp(prefix="lodeframe-")

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    # reading

    def list(self) -> list[dict]:
        found = [json.loads(self.files.read(e.path)) for e in self.files.list(self._path("manifests")) if e.name.endswith(".json")]
        return sorted(found, key=lambda m: m["created_timestamp"])

    def manifest(self, name: str, version: str | None = None) -> dict:
        own = [m for m in self.list() if m["name"].lower() == name.lower() and version in (None, m["id"])]
        if not own:
            raise CatalogError(f"no dataset {name}{f'@v{version}' if version else ''}")
        return own[-1]

    def dataset(self, name: str, version: str | None = None) -> DataFrame:
        if version is None and name.lower() in self.views:
            return self.views[name.lower()]
        return self._read(self.manifest(name, version)["id"])

    def _read(self, version: str) -> DataFrame:
        """Pages are held against the checksums that they were written with."""
        return self.spark.read.option("parquet.page.verify-checksum.enabled", "true").parquet(self._path("data", version))

    # writing

    def view(self, name: str, df: DataFrame) -> None:
        """A name for a DataFrame (say, over Parquet files) that is not copied."""
        self.views[name.lower()] = types.normalised(df)

    def add(self, name: str, df: DataFrame, size_raw: int = 0, kinds: list[tuple[str, bool]] | None = None) -> dict:
        df = storable(types.normalised(df))
        version = secrets.token_hex(9)
        path = self._path("data", version)
        df.write.option("compression", "snappy").option("parquet.page.write-checksum.enabled", "true").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
        schema = [{"name": f.name, "dtype": kinds[i][0] if kinds else types.logical(f.dataType), "nullable": kinds[i][1] if kinds else f.nullable} for i, f in enumerate(df.schema)]
        files = [e for e in self.files.list(path) if e.name.startswith("part-")]
        m = {"id": version, "name": clean(name, "dataset"), "created_timestamp": time.time_ns(), "nrows": self._read(version).count(), "size_raw": size_raw, "size_on_disk": sum(e.size for e in files), "schema": schema, "stripes": [e.name for e in files]}
        self.files.publish(self._path("manifests", f"{version}.json"), json.dumps(m).encode())
        self.views.pop(m["name"], None)
        return m

    def remove(self, name: str, version: str | None = None) -> None:
        m = self.manifest(name, version)
        self.files.remove(self._path("manifests", f"{m['id']}.json"))
        self.files.remove(self._path("data", m["id"]))

    def drop(self) -> None:
        self.files.remove(self.folder)

    # loading

    def stage(self, source: str | bytes | os.PathLike) -> str:
        """The file under the suffix that its content asks for, without a byte order mark."""
        path = None if isinstance(source, bytes) else str(source)
        raw = source[:HEAD] if path is None else self.files.head(path, HEAD)
        compression, sample = head(raw)
        suffix, skip = SUFFIXES[compression], len(BOM) if sample.startswith(BOM) else 0
        if path is not None and not skip and (path.endswith(suffix) or compression is None and not path.endswith(PACKED)):
            return path
        out = self._path("staging", secrets.token_hex(9) + suffix)
        if path is None:
            self.files.write(out, source)
            if not skip:
                return out
            path, out = out, self._path("staging", secrets.token_hex(9) + suffix)
        self.files.copy(path, out, compression, skip)
        if isinstance(source, bytes):
            self.files.remove(path)
        return out

    def load(self, source: str | bytes | os.PathLike, name: str, schema: StructType | None = None) -> dict:
        """A delimited file (path or bytes; gzip and bzip2 too) as a new version of a dataset. With a schema nothing is
        inferred; its names must be the header's."""
        path = self.stage(source)
        raw = self.files.head(path, HEAD)
        fmt = sniff(raw)
        text = head(raw)[1].decode("utf-8", "replace")
        lines = [x for x in text.splitlines(keepends=True) if x.strip("\r\n")]
        if not lines:
            raise IngestError("the file is empty")
        header = lines[0].rstrip("\r\n").split("\t") if fmt.delimiter == "\t" else next(csv.reader(lines, delimiter=fmt.delimiter))
        texts = ingest.read_texts(self.spark, path, fmt, header)
        if schema is not None:
            if [f.name for f in schema] != clean_all(header):
                raise IngestError("the header doesn't match the schema")
            kinds = [(types.logical(f.dataType), f.nullable) for f in schema]
        else:
            kinds = ingest.infer(texts)
        try:
            return self.add(name, ingest.typed(texts, [k for k, _ in kinds]), self.files.size(path), kinds)
        finally:
            if path.startswith(self._path("staging")):
                self.files.remove(path)

    def load_map(self, name: str, columns: dict[str, list[str]]) -> dict:
        texts = ingest.from_map(self.spark, columns)
        kinds = ingest.infer(texts)
        return self.add(name, ingest.typed(texts, [k for k, _ in kinds]), 0, kinds)

    def load_folder(self, folder: str) -> list[dict]:
        return [self.load(e.path, e.stem) for e in self.files.list(str(folder)) if e.is_file]

    def load_url(self, name: str, url: str) -> dict:
        """What an http or https address gives, copied piece by piece to the staging folder and loaded."""
        scheme = urlparse(url).scheme
        if scheme in ("s3", "s3a"):
            raise IngestError("object stores are read through Spark: use view() with spark.read")
        if scheme not in ("http", "https"):
            raise IngestError(f"unsupported scheme: {scheme!r}")
        path = self._path("staging", secrets.token_hex(9))
        with urllib.request.urlopen(url) as r:  # noqa: S310  the scheme is checked
            self.files.write(path, iter_chunks(r))
        try:
            return self.load(path, name)
        finally:
            self.files.remove(path)

    def keep_raw(self, name: str, raw: bytes) -> dict:
        """Bytes kept as they are, not registered."""
        version = secrets.token_hex(9)
        self.files.write(self._path("raw", version), raw)
        return {"id": version, "name": clean(name, "dataset"), "created_timestamp": time.time_ns(), "nrows": 0, "size_raw": len(raw), "size_on_disk": len(raw), "schema": [], "stripes": []}


def iter_chunks(reader) -> Iterator[bytes]:
    while part := reader.read(CHUNK):
        yield part
