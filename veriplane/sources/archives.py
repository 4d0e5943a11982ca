"""A data source over CSV members of ZIP archives, read without extracting."""

from __future__ import annotations

import csv
import fnmatch
import io
import re
import zipfile
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


BATCH_ROWS = 10_000


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, or a shared one such as hdfs or s3), and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _matching(path: str) -> list[str]:
    """The files that a path with wildcards in its last part names."""
    system, inner = _place(path)
    folder, _, name = inner.rpartition("/")
    found = system.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True))
    prefix = path[: len(path) - len(inner)] if "://" in path else ""
    return sorted(prefix + f.path for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, name))


class ZipMember(InputPartition):
    def __init__(self, path: str, member: str):
        self.path, self.member = path, member


class ZipCsvReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.fieldNames()
        self.width = len(self.names)
        self.path, self.pattern = options["path"], options.get("member", r"\.csv$")
        self.header = options.get("header", "true") == "true"

    def partitions(self):
        """One partition per matching member; decoys that merely describe the file are left out by the pattern."""
        out = []
        for path in _matching(self.path):
            system, inner = _place(path)
            with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
                out += [ZipMember(path, m) for m in sorted(archive.namelist()) if re.search(self.pattern, m) and "fileheader" not in m.lower()]
        return out

    def read(self, partition):
        system, inner = _place(partition.path)
        width = self.width
        with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive, archive.open(partition.member) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=""))
            if self.header:
                next(rows, None)
            while batch := list(islice(rows, BATCH_ROWS)):
                columns = zip(*[(row + [None] * width)[:width] for row in batch])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=self.names)


class ZipCsvSource(DataSource):
    """``spark.read.format("zipcsv").schema(...).option("path", glob).option("member", regex)``."""

    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def schema(self) -> str:
        return ", ".join(f"_c{i} string" for i in range(int(self.options.get("width", "1"))))

    def reader(self, schema):
        return ZipCsvReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipCsvSource)
