"""Mounted roots as a data source: listings in tasks, and bytes of the assets that are asked for."""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

EXTENSIONS = ("jpg", "jpeg", "png", "webp")
SCHEMA = "backend string, path string, abs_path string, size long, mtime double, ctime double, error string"
#: Bytes of one batch of contents, but for a single larger file.
BATCH_BYTES = 16 << 20


class Share(InputPartition):
    """The first-level entries of a root whose names fall to one share; the first share also tells that a root can't be read."""

    def __init__(self, backend: str, root: str, share: int, shares: int, after: int = -1, until: int | None = None):
        self.backend, self.root, self.share, self.shares, self.after, self.until = backend, root, share, shares, after, until


class _Options:
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.shares = int(options.get("shares", 4))
        self.extensions = tuple(options.get("extensions", ",".join(EXTENSIONS)).lower().split(","))
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.settle_ns = int(1e9 * float(options.get("settleseconds", options.get("settleSeconds", 1))))

    def partitions(self, after: int = -1, until: int | None = None) -> list[Share]:
        return [Share(backend, root, k, self.shares, after, until) for backend, root in sorted(self.roots.items()) for k in range(self.shares)]

    def list(self, part: Share) -> Iterator[tuple]:
        try:
            entries = sorted(os.scandir(part.root), key=lambda e: e.name)
        except OSError as e:
            if part.share == 0:
                yield (part.backend, None, part.root, None, None, None, str(e))
            return
        for entry in entries:
            if zlib.crc32(entry.name.encode("utf-8", "surrogateescape")) % part.shares == part.share:
                yield from self._files(part, entry.path)

    def _files(self, part: Share, path: str) -> Iterator[tuple]:
        folders = [path]
        while folders:
            path = folders.pop()
            try:
                if os.path.isdir(path):
                    if self.recursive and not os.path.islink(path):
                        folders += sorted((e.path for e in os.scandir(path)), reverse=True)
                    continue
                if path.rsplit(".", 1)[-1].lower() not in self.extensions or "." not in os.path.basename(path):
                    continue
                found = os.stat(path)
            except OSError as e:  # a file or folder that went or can't be read
                yield (part.backend, os.path.relpath(path, part.root), path, None, None, None, str(e))
                continue
            if part.until is None or part.after < found.st_mtime_ns <= part.until:
                yield (part.backend, os.path.relpath(path, part.root).replace(os.sep, "/"), path, found.st_size, found.st_mtime, found.st_ctime, None)


class RootsSource(DataSource):
    """``catalogue_roots``: option ``roots`` is JSON of backend name -> mounted folder.

    Each root is listed by ``shares`` tasks (of its first-level entries), so the
    driver lists nothing. Roots, folders and files that can't be read are rows
    with ``error``. As a stream it gives, batch by batch, files by the time of
    their last change, so a changed file comes again; changes younger than
    ``settleSeconds`` wait for the next batch.
    """

    @classmethod
    def name(cls) -> str:
        return "catalogue_roots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RootsReader:
        return RootsReader(dict(self.options))

    def streamReader(self, schema) -> RootsStream:
        return RootsStream(dict(self.options))


class RootsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.listing = _Options(options)

    def partitions(self) -> list[Share]:
        return self.listing.partitions()

    def read(self, partition: Share) -> Iterator[tuple]:
        yield from self.listing.list(partition)


class RootsStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.listing = _Options(options)

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - self.listing.settle_ns}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.listing.partitions(start["ns"], end["ns"])

    def read(self, partition: Share) -> Iterator[tuple]:
        yield from self.listing.list(partition)


def _options(roots: dict[str, str], **options) -> dict[str, str]:
    return {"roots": json.dumps(roots)} | {k: str(v) for k, v in options.items()}


def list_roots(spark: SparkSession, roots: dict[str, str], **options) -> tuple[DataFrame, DataFrame]:
    """``(assets, errors)``: backend, path, abs_path, size, mtime, ctime; and backend, path, abs_path, error."""
    spark.dataSource.register(RootsSource)
    found = spark.read.format("catalogue_roots").options(**_options(roots, **options)).load()
    return found.where("error IS NULL").drop("error"), found.where("error IS NOT NULL").select("backend", "path", "abs_path", "error")


def root_stream(spark: SparkSession, roots: dict[str, str], **options) -> DataFrame:
    """The same rows as a stream; see ``RootsSource``."""
    spark.dataSource.register(RootsSource)
    return spark.readStream.format("catalogue_roots").options(**_options(roots, **options)).load()


def asset_bytes(assets: DataFrame, ids: DataFrame, key: str = "photo_id") -> DataFrame:
    """``key, content, error`` of the assets whose key is in ``ids`` (first column): no other file is opened.

    ``assets``: key and abs_path. An asset that can't be read has its error, an
    id that no asset has the error ``unknown``.
    """
    asked = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    kind = dict(assets.dtypes)[key]
    rows = asked.join(assets.select(key, "abs_path"), key, "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = ([], [], []), 0
            for name, path in zip(batch.column(0), batch.column(1).to_pylist()):
                content = error = None
                try:
                    if path is None:
                        error = "unknown"
                    else:
                        with open(path, "rb") as f:
                            content = f.read()
                except OSError as e:
                    error = str(e)
                for column, value in zip(out, (name, content, error)):
                    column.append(value)
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield _batch(out, batch.schema.field(0).type, key)
                    out, size = ([], [], []), 0
            if out[0]:
                yield _batch(out, batch.schema.field(0).type, key)

    return rows.mapInArrow(read, f"`{key}` {kind}, content binary, error string")


def _batch(columns: tuple[list, list, list], kind: pa.DataType, key: str) -> pa.RecordBatch:
    names = pa.array([x.as_py() for x in columns[0]], kind)
    return pa.RecordBatch.from_arrays([names, pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.string())], names=[key, "content", "error"])
