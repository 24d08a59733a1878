"""Zip bundles as a data source: one partition for each archive member, read as a stream.

A bundle is opened where it lies, through the file system its path names, and only the
wanted member is read, row by row; no archive is ever one value of a row, so there is no
bound on its size. Any file system that pyarrow opens will do (local and shared folders, hdfs, s3)."""

from __future__ import annotations

import csv
import fnmatch
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS = 5_000


def archives(pattern: str) -> list[str]:
    """Paths that match: wildcards may stand in the last part; a folder means all its zips."""
    from pyarrow import fs
    if pattern.startswith("file:/") and not pattern.startswith("file:///"):
        pattern = "file:///" + pattern.removeprefix("file:").lstrip("/")
    head, _, last = pattern.rstrip("/").rpartition("/")
    scheme = pattern.partition("://")[0] + "://" if "://" in pattern else ""
    wild = any(c in last for c in "*?[")
    system, folder = fs.FileSystem.from_uri(head if wild else pattern)
    info = system.get_file_info(folder)
    if info.is_file:
        return [pattern]
    found = system.get_file_info(fs.FileSelector(folder, recursive=False)) if info.type == fs.FileType.Directory else []
    host = scheme + (pattern[len(scheme):].partition("/")[0] if scheme and not scheme.startswith("file") else "")
    return sorted(host + f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, last if wild else "*.zip"))


class Member(InputPartition):
    def __init__(self, path: str, member: str):
        self.path, self.member = path, member


class ZippedCsvReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern, self.member = options["path"], options["member"].lower()
        self.encoding = options.get("encoding", "latin-1")

    def partitions(self) -> list[InputPartition]:
        """Only names travel: the archives' directories are read in the tasks."""
        return [Member(p, self.member) for p in archives(self.pattern)] or [Member("", self.member)]

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        if not part.path:
            return
        system, path = fs.FileSystem.from_uri(part.path)
        with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as bundle:
            names = [n for n in bundle.namelist() if n.rsplit("/", 1)[-1].lower() == part.member]
            if not names:
                return
            with bundle.open(names[0]) as fh:
                sheet = csv.reader(io.TextIOWrapper(fh, encoding=self.encoding, newline=""))
                header = next(sheet, [])
                at = {k.lstrip("\ufeff"): i for i, k in enumerate(header) if k}  # of equal names the last
                keys, pick = pa.array([*at] * BATCH_ROWS, pa.string()), list(at.values())
                flat, n = [], 0
                for r in sheet:
                    if not r:
                        continue
                    if len(r) < len(header):
                        r += [None] * (len(header) - len(r))
                    flat += [r[i] for i in pick]
                    n += 1
                    if n == BATCH_ROWS:
                        yield _batch(part.path, keys, flat, n)
                        flat, n = [], 0
                if n:
                    yield _batch(part.path, keys, flat, n)


def _batch(path: str, keys: pa.Array, flat: list, n: int) -> pa.RecordBatch:
    """``n`` rows whose values stand one after the other."""
    wide = len(flat) // n
    ends = pa.array(range(0, n * wide + 1, wide) if wide else [0] * (n + 1), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.MapArray.from_arrays(ends, keys.slice(0, len(flat)), pa.array(flat, pa.string()))], ["path", "row"])


class ZippedCsv(DataSource):
    """``path`` (a zip, a folder of zips, or a pattern), ``member`` (without case), ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        return "path string, row map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return ZippedCsvReader(self.options)


def read_members(spark: SparkSession, pattern: str, member: str, encoding: str) -> DataFrame:
    spark.dataSource.register(ZippedCsv)
    return spark.read.format("zipped_csv").option("member", member).option("encoding", encoding).load(pattern)


def write_bundles(df: DataFrame, folder: str, member: str, by: str, encoding: str = "latin-1") -> int:
    """One zip for each task and value of ``by`` (``<value>-<task>.zip`` holding ``member``),
    written as a stream; returns how many. ``folder`` must be shared by the executors. A value of
    many rows is written, and later read, by several tasks, so their number follows the data."""
    cols = [c for c in df.columns if c != by]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task, value, out, text, made = TaskContext.get().partitionId(), None, None, None, []

        def close() -> None:
            if out:
                text.close()
                out[1].close()
                out[0].close()

        for b in batches:
            keys, sides = b.column(by).to_pylist(), [b.column(c).to_pylist() for c in cols]
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for lo, hi in zip(starts, starts[1:] + [len(keys)]):
                if out is None or keys[lo] != value:
                    close()
                    value = keys[lo]
                    made.append(f"{value}-{task}.zip")
                    raw = system.open_output_stream(f"{base}/{made[-1]}")
                    out = raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                    text = io.TextIOWrapper(out[1].open(member, "w", force_zip64=True), encoding=encoding, newline="")
                    sheet = csv.writer(text)
                    sheet.writerow(cols)
                sheet.writerows(zip(*(c[lo:hi] for c in sides)))  # a null is written as nothing
        close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["file"])

    return df.hint("rebalance", by).sortWithinPartitions(by).mapInArrow(write, "file string").count()
