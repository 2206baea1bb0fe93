"""A data source for wide day matrices (survey A01-A04): CSV rows of ids and one column a day, read in long form.

``spark.read.format("wide_days")`` with ``path`` (a file or a folder of files with one header each, on a file system
that all nodes mount) and optionally ``days`` (only the last so many day columns). Partitions are byte ranges of the
files: a range starts at its first full line and ends with the line that its last byte is in, so a line is never
gathered with others and a large file is read by many tasks. Equality filters on id columns are pushed into the
reader, which looks at a line's ids before it parses its days; rows come as Arrow batches (ids, ``d``, ``sales``).
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

RANGE_BYTES, BATCH = 32 << 20, 1 << 16


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int


def _files(path: str) -> list[str]:
    path = path.removeprefix("file:")
    if not os.path.isdir(path):
        return [path]
    return sorted(f"{path}/{f}" for f in os.listdir(path) if not f.startswith(("_", ".")) and os.path.getsize(f"{path}/{f}"))


def _header(path: str) -> list[str]:
    with open(path, encoding="utf-8", newline="") as f:
        return next(csv.reader(f), [])


def _is_day(name: str) -> bool:
    return name.startswith("d_") and name[2:].isdigit()


def _lines(path: str, start: int, stop: int) -> Iterator[str]:
    """The lines, but the header, that begin in bytes [start, stop)."""
    with open(path, "rb") as f:
        f.seek(max(start - 1, 0))
        f.readline()  # the header, or the rest of the line before (whole if ``start`` begins a line)
        while f.tell() < stop and (line := f.readline()):
            if line.strip():
                yield line.decode()


class WideDays(DataSource):
    """The source; see the module."""

    @classmethod
    def name(cls) -> str:
        return "wide_days"

    def schema(self) -> StructType:
        ids = [c for c in _header(_files(self.options["path"])[0]) if not _is_day(c)]
        return StructType([StructField(c, StringType()) for c in ids] + [StructField("d", StringType()), StructField("sales", IntegerType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WideReader(self.options, schema)


class WideReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.files, self.schema = _files(options["path"]), schema
        self.days = int(options["days"]) if options.get("days") else None
        self.size = int(options.get("range_bytes", RANGE_BYTES))
        self.wanted: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - the data source API's name
        ids = {f.name for f in self.schema.fields[:-2]}
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ids and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(p, at, min(at + self.size, os.path.getsize(p)))
                for p in self.files for at in range(0, os.path.getsize(p), self.size)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        header = _header(partition.path)
        at = {c: i for i, c in enumerate(header)}
        last = max((int(c[2:]) for c in header if _is_day(c)), default=0)
        days = sorted((c for c in header if _is_day(c) and (not self.days or int(c[2:]) > last - self.days)), key=lambda c: int(c[2:]))
        ids = [f.name for f in self.schema.fields[:-2]]
        names, rows = [f.name for f in self.schema.fields], []
        types = [pa.string()] * (len(names) - 1) + [pa.int32()]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for cells in csv.reader(_lines(partition.path, partition.start, partition.stop)):
            if any(cells[at[c]] != v for c, v in self.wanted.items()):
                continue
            own = [cells[at[c]] or None for c in ids]
            rows += [(*own, d, int(cells[at[d]]) if cells[at[d]] else None) for d in days]
            if len(rows) >= BATCH:
                yield batch()
                rows.clear()
        yield batch()


def read_wide_days(spark: SparkSession, path: str, days: int | None = None, **options):
    """A01-A03 in one scan: the long form of the wide matrix at ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader with pushFilters needs it
    spark.dataSource.register(WideDays)
    reader = spark.read.format("wide_days").option("path", path)
    for name, value in {"days": days, **options}.items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()
