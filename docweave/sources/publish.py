"""Publication in two phases on any file system that Hadoop and Arrow open.

    root/versions/<version>/...    the files of a version, written by the tasks that hold them
    root/manifests/<version>       path, size, sha256 of each, a table whose commit says that all are there
    root/CURRENT                   the name of the version that readers see

Phase one writes files and manifest; a task that runs twice writes the same bytes again. Phase two puts a new pointer in
the place of the old one by a rename that replaces, which readers see whole or not at all. A crash before it leaves the old
version current, and sweep() removes what was left. Older versions stay for roll_back().
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.storage import stored

MANIFEST = "path string, size long, sha256 string"


class PublicationError(Exception):
    pass


class Folder:
    """Paths of a root and the few calls on Hadoop's file system that a publication takes."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = self.path(root)
        if path.getParent() is None:
            raise PublicationError("the root of a file system cannot be published to")
        self.fs = path.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self.path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.root}/{name}"))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readNBytes(1 << 16)).decode().strip()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """The new text appears whole or not at all: written beside, then renamed over the old one."""
        fresh = self.path(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        out = self.fs.create(fresh, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self.path(f"{self.root}/{name}")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kind, 1)
        options[0] = kind.getEnumConstants()[1]  # OVERWRITE
        context.rename(fresh, target, options)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


def unsafe(path: Column) -> Column:
    """Whether a path leaves its folder or names no file."""
    return path.isNull() | path.rlike(r"(^|/)(\.{0,2})(/|$)") | path.contains("\\")


def write_version(files: DataFrame, root: str) -> str:
    """Phase one: files (path, content) as a new version that nobody sees yet; its name."""
    spark = files.sparkSession
    folder, version = Folder(spark, root), f"v{len(Folder(spark, root).names('manifests')):08d}-{uuid.uuid4().hex[:12]}"
    base = f"{folder.root}/versions/{version}"
    wrong = files.filter(unsafe(F.col("path"))).select("path").first()
    if wrong:
        raise PublicationError(f"{wrong['path']!r} is no path below the published folder")

    def run(batches):
        system, where = fs.FileSystem.from_uri(base)
        made: set[str] = set()
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                parent = f"{where}/{path}".rpartition("/")[0]
                if parent not in made:  # stores without folders take this as done
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                data = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
                with system.open_output_stream(f"{where}/{path}") as f:
                    f.write(data)
                rows.append((path, data.size, hashlib.sha256(data).hexdigest()))
            if len(made) > 100_000:
                made.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.string()))], ["path", "size", "sha256"])

    written = files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, MANIFEST)
    listed = stored(written, "manifest", f"{folder.root}/manifests/{version}")
    twice = listed.groupBy("path").count().filter("count > 1").select("path").first()
    if twice:
        raise PublicationError(f"{twice['path']} is written twice")
    return version


def make_current(spark: SparkSession, root: str, version: str) -> None:
    """Phase two: the version takes the place of the current one."""
    folder = Folder(spark, root)
    if not folder.exists(f"manifests/{version}/_SUCCESS"):
        raise PublicationError(f"version {version} is not whole")
    folder.replace("CURRENT", version)


def publish(files: DataFrame, root: str, keep: int = 1) -> str:
    """Both phases, then the removal of all but the current and `keep` older versions. An error before the pointer
    changes leaves the old version current and nothing of the new one."""
    spark = files.sparkSession
    try:
        version = write_version(files, root)
    except Exception:
        sweep(spark, root, keep)
        raise
    make_current(spark, root, version)
    sweep(spark, root, keep)
    return version


def current(spark: SparkSession, root: str) -> str | None:
    return Folder(spark, root).read("CURRENT")


def whole_versions(spark: SparkSession, root: str) -> list[str]:
    folder = Folder(spark, root)
    return [v for v in folder.names("manifests") if folder.exists(f"manifests/{v}/_SUCCESS")]


def sweep(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Remove versions that never became current and those older than the `keep` before the current one. To be called
    when nobody else publishes to the root. The names of what went."""
    folder, now = Folder(spark, root), current(spark, root)
    known = sorted(set(folder.names("versions")) | set(folder.names("manifests")))
    before = [v for v in whole_versions(spark, root) if now and v < now]
    stay = {now, *(before[-keep:] if keep else [])}
    gone = [v for v in known if v not in stay]
    for v in gone:
        folder.remove(f"manifests/{v}")
        folder.remove(f"versions/{v}")
    return gone


def roll_back(spark: SparkSession, root: str) -> str:
    """Make the version before the current one current again."""
    now = current(spark, root)
    before = [v for v in whole_versions(spark, root) if now and v < now]
    if not before:
        raise PublicationError("there is no version to go back to")
    make_current(spark, root, before[-1])
    return before[-1]


def published(spark: SparkSession, root: str) -> DataFrame:
    """path, content of all files of the current version."""
    folder, now = Folder(spark, root), current(spark, root)
    if now is None:
        return spark.createDataFrame([], "path string, content binary")
    base = f"{folder.root}/versions/{now}/"
    listed = spark.read.schema(MANIFEST).parquet(f"{folder.root}/manifests/{now}")

    def run(batches):
        system, where = fs.FileSystem.from_uri(base)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(f"{where.rstrip('/')}/{path}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    return listed.select("path").mapInArrow(run, "path string, content binary")
