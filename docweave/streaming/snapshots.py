"""A stream of changes between snapshots: added, modified and removed files, replayable from its log.

A snapshot is a table of path and hash, written by a Spark job into the log folder: id=N, dealt to a fixed number of
buckets by a hash of the path, each a file in the order of its paths. A snapshot counts once its writer has committed.
The stream's offsets are snapshot numbers. Between two offsets each (snapshot, bucket) is an input partition, in which
two ordered files are merged row by row, so nothing of a snapshot passes through the driver and a task holds one
batch of either side. A query restarted from its checkpoint goes on behind the last snapshot that it finished.

    record(spark, snapshot(spark, ["content", "templates"], exclude="public"), log)
    changes(spark, log).writeStream...

Defined results: paths are distinct within a snapshot (of repeated ones the smallest hash counts), null paths are left
out, a null hash is a hash of its own; the first snapshot has no changes, or with initial=added adds everything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

BUCKETS = 64
CHANGE = "snapshot long, path string, change string, hash string"


def _folder(log: str, buckets: int) -> str:
    return f"{log.rstrip('/')}/buckets={buckets}"


def _numbers(log: str, buckets: int, done: bool) -> list[int]:
    """Numbers of the snapshots of a log; only those that are whole, if done."""
    system, root = fs.FileSystem.from_uri(_folder(log, buckets))
    found = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if "/id=" in f.path]
    if done and found:
        marks = system.get_file_info([f"{p}/_SUCCESS" for p in found])
        found = [p for p, m in zip(found, marks) if m.type == fs.FileType.File]
    return sorted(int(p.rpartition("=")[2]) for p in found)


def record(spark: SparkSession, files: DataFrame, log: str, buckets: int = BUCKETS) -> int:
    """Write the next snapshot of files (path, hash) and return its number. What an unfinished writer has left
    under that number goes. One recorder writes to a log at a time."""
    number = max(_numbers(log, buckets, True), default=0) + 1
    rows = files.filter("path IS NOT NULL").groupBy("path").agg(F.min("hash").alias("hash"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "path")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{_folder(log, buckets)}/id={number}")
    return number


@dataclass
class Span(InputPartition):
    number: int
    bucket: int


class ContentChanges(DataSource):
    """Options: log; buckets (as recorded); initial (none or added); keep (0: all; else as many snapshots before the last
    finished one as stay in the log)."""

    @classmethod
    def name(cls) -> str:
        return "content_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        o = self.options
        return ChangeReader(o.get("log") or "", int(o.get("buckets", BUCKETS)), o.get("initial", "none"), int(o.get("keep", 0)))


class ChangeReader(DataSourceStreamReader):
    def __init__(self, log: str, buckets: int, initial: str, keep: int):
        if not log or initial not in ("none", "added") or keep < 0:
            raise ValueError("a log is needed, and initial is none or added")
        self.log, self.buckets, self.initial, self.keep = log, buckets, initial, keep

    def initialOffset(self) -> dict:  # noqa: N802
        return {"snapshot": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"snapshot": max(_numbers(self.log, self.buckets, True), default=0)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first = max(start["snapshot"] + 1, 1 if self.initial == "added" else 2)
        return [Span(n, b) for n in range(first, end["snapshot"] + 1) for b in range(self.buckets)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        n = partition.number
        rows: list[tuple] = []
        for path, change, mark in difference(self._rows(n - 1, partition.bucket), self._rows(n, partition.bucket)):
            rows.append((n, path.decode(), change, mark))
            if len(rows) == 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _rows(self, number: int, bucket: int) -> Iterator[tuple[bytes, str | None]]:
        """(path, hash) of a bucket in the order of paths; nothing before the first snapshot."""
        system, root = fs.FileSystem.from_uri(_folder(self.log, self.buckets))
        folder = fs.FileSelector(f"{root}/id={number}/bucket={bucket}", allow_not_found=True)
        files = [f.path for f in system.get_file_info(folder) if f.path.endswith(".parquet")]
        if len(files) > 1:
            raise ValueError(f"bucket {bucket} of snapshot {number} is in {len(files)} files")
        for path in files:
            for batch in pq.ParquetFile(path, filesystem=system).iter_batches(4096, columns=["path", "hash"]):
                yield from zip((p.encode() for p in batch.column("path").to_pylist()), batch.column("hash").to_pylist())

    def commit(self, end: dict) -> None:
        if self.keep:
            system, root = fs.FileSystem.from_uri(_folder(self.log, self.buckets))
            for n in _numbers(self.log, self.buckets, True):
                if n < end["snapshot"] - self.keep + 1:
                    system.delete_dir(f"{root}/id={n}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["snapshot", "path", "change", "hash"])


def difference(old: Iterator[tuple], new: Iterator[tuple]) -> Iterator[tuple]:
    """(path, change, hash now) of two runs of (path, hash), either in the order of distinct paths."""
    a, b = next(old, None), next(new, None)
    while a or b:
        if b is None or a is not None and a[0] < b[0]:
            yield a[0], "removed", None
            a = next(old, None)
        elif a is None or b[0] < a[0]:
            yield b[0], "added", b[1]
            b = next(new, None)
        else:
            if a[1] != b[1]:
                yield b[0], "modified", b[1]
            a, b = next(old, None), next(new, None)


def changes(spark: SparkSession, log: str, **options) -> DataFrame:
    """The stream of changes (snapshot, path, change, hash) of a log."""
    spark.dataSource.register(ContentChanges)
    reader = spark.readStream.format("content_changes").option("log", log)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
