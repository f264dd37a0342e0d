"""Zip archives of JSON lines as a data source: one partition a run of members, streamed line by line."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, place long, line string"
#: Lines that are handed over together, and the bytes at which a batch ends before that.
BATCH_LINES, BATCH_BYTES = 4096, 8 << 20
#: Members are put together until they unpack to so many bytes, so that a million small ones are not a million tasks.
PARTITION_BYTES = 64 << 20


def _opened(path: str):
    """A seekable file: through the file system that the path names, else a local (or shared, mounted) one."""
    scheme = path.split(":", 1)[0] if "://" in path or path.startswith("file:") else ""
    system, inside = (fs.FileSystem.from_uri(path) if scheme and scheme != "file" else (fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")))
    return system.open_input_file(inside)


class Members(InputPartition):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], pattern: str, most: int):
        self.paths, self.pattern, self.most = paths, pattern, most

    def partitions(self) -> list[Members]:
        """From each archive's directory alone (its end): no member is unpacked here."""
        out = []
        for path in self.paths:
            with _opened(path) as f, zipfile.ZipFile(f) as z:
                run, size = [], 0
                for i in z.infolist():
                    if i.is_dir() or not fnmatch.fnmatchcase(i.filename, self.pattern):
                        continue
                    if run and size + i.file_size > self.most:
                        out.append(Members(path, run))
                        run, size = [], 0
                    run.append(i.filename)
                    size += i.file_size
                if run:
                    out.append(Members(path, run))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.names:
            return
        with _opened(partition.path) as f, zipfile.ZipFile(f) as z:
            for name in partition.names:
                with z.open(name) as member:
                    lines, size = [], 0
                    for place, line in enumerate(io.TextIOWrapper(member, "utf-8", errors="replace", newline="\n")):
                        line = line.rstrip("\r\n")
                        if not line.strip():
                            continue
                        lines.append((place, line))
                        size += len(line)
                        if len(lines) == BATCH_LINES or size >= BATCH_BYTES:
                            yield _batch(partition.path, name, lines)
                            lines, size = [], 0
                    if lines:
                        yield _batch(partition.path, name, lines)


def _batch(path: str, name: str, lines: list[tuple[int, str]]) -> pa.RecordBatch:
    places, texts = zip(*lines, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array([name] * len(lines)), pa.array(places, pa.int64()), pa.array(texts)], ["archive", "member", "place", "line"])


class ArchiveSource(DataSource):
    """Options: paths (one a line), pattern of member names (default *.jsonl), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "ziplines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in (self.options.get("paths") or self.options.get("path", "")).split("\n") if p]
        return ArchiveReader(paths, self.options.get("pattern", "*.jsonl"), int(self.options.get("partitionbytes", PARTITION_BYTES)))


def _matching(spark: SparkSession, path: str) -> list[str]:
    if not set("*?[{") & set(path):
        return [path]
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in found or [])


def lines(spark: SparkSession, paths: str | list[str], pattern: str = "*.jsonl", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """archive, member, place (from 0), line: the lines that are not blank of all members whose name fits the pattern.

    The driver reads the archives' directories; tasks unpack members as streams, so neither an archive nor a member is ever
    held whole and each may be larger than memory or two gigabytes. An archive without a fitting member gives no rows. A
    lost task's members are read again. A path may be a pattern (*, ?, [, {) of archives. Bytes that are not UTF-8 become replacement characters.
    """
    spark.dataSource.register(ArchiveSource)
    wanted = [p for one in ([paths] if isinstance(paths, str) else paths) for p in _matching(spark, one)]
    return spark.read.format("ziplines").option("paths", "\n".join(wanted)).option("pattern", pattern).option("partitionBytes", partition_bytes).load()
