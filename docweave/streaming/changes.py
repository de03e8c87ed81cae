"""Change streams: files, snapshots, debounced sessions, coalesced builds, reload events."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.operators import manifest
from docweave.sources import markdown
from docweave.storage import stored

DEBOUNCE = "500 milliseconds"


def changed_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """A stream of new files (path, ts, length, root); modified and deleted ones need a difference of
    manifests (operators.manifest)."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return raw.select("path", F.col("modificationTime").alias("ts"), "length", F.lit(folder).alias("root"))


def snapshot(spark: SparkSession, folders: list[str], exclude: str | None = None) -> DataFrame:
    """path, hash of all files below the folders that are there, but for those below `exclude` (the output)."""
    every = spark.createDataFrame([], "path string, hash string")
    out = os.path.realpath(exclude).replace(os.sep, "/") if exclude else None
    for folder in folders:
        if os.path.isdir(folder):
            base = os.path.realpath(folder).replace(os.sep, "/")
            files = manifest.manifest(markdown.read_files(spark, base, "*", binary=True).select(F.concat(F.lit(f"{base}/"), "rel_path").alias("path"), "content"))
            every = every.unionByName(files if out is None else files.filter(~F.startswith("path", F.lit(f"{out}/"))))
    return every


def poll(spark: SparkSession, folders: list[str], last: DataFrame | None, exclude: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Changes (path, change: added, removed, modified) since the snapshot `last`, and the new snapshot, which
    is stored. New folders below the watched ones are seen; the first snapshot has no changes."""
    now = stored(snapshot(spark, folders, exclude), "snapshot")
    return manifest.difference(now if last is None else last, now), now


def sessions(events: DataFrame, key: str, gap: str = DEBOUNCE, delay: str | None = None) -> DataFrame:
    """Bursts of events of a key, ended by a pause of `gap`: key, start, end, n. With a delay the input
    is a stream and late events are dropped by its watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay:
        timed = timed.withWatermark("ts", delay)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def coalesced_builds(triggers: DataFrame, key: str, seconds: int) -> DataFrame:
    """A single builder that starts at most once in `seconds` and takes all triggers of that time as
    one, as a micro-batch trigger does: key, start, triggers. One row is one build."""
    timed = triggers.withColumn("at", F.col("ts").cast("timestamp"))
    out = timed.groupBy(key, F.window("at", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("triggers"))
    return out.select(key, F.col("w.start").alias("start"), "triggers")


def single_slot_builds(triggers: DataFrame, key: str, seconds: int) -> DataFrame:
    """The builds of a builder that takes `seconds` for each, never runs twice at once and remembers triggers
    that come while it works as one: key, start, triggers (that the build takes in). A build starts at once if the
    builder is idle, else when it has ended. The builder is a fold over the triggers of a key in time."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    long = F.lit(seconds * 1_000_000).cast("long")
    built = "array<struct<start: bigint, triggers: bigint>>"
    start = F.struct(F.array().cast(built).alias("done"), F.lit(None).cast("long").alias("start"), F.lit(0).cast("long").alias("n"))

    def step(acc, t):
        """`start` is that of the last build, running or to come; triggers up to it are its own."""
        own = acc["start"].isNotNull() & (t <= acc["start"])
        kept = F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["n"].alias("triggers"))))
        done = F.when(own | acc["start"].isNull(), acc["done"]).otherwise(kept)
        begins = F.when(own, acc["start"]).when(acc["start"].isNull(), t).otherwise(F.greatest(t, acc["start"] + long))
        return F.struct(done.alias("done"), begins.alias("start"), F.when(own, acc["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"))

    end = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["n"].alias("triggers"))))
    folded = triggers.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(at)), start, step, end).alias("b"))
    return folded.select(key, F.explode("b").alias("b")).select(key, F.timestamp_micros("b.start").alias("start"), "b.triggers")


def rebuild_on_change(changes: DataFrame, build: Callable[[DataFrame, int], None], reload: Callable[[int], None], checkpoint: str, trigger: dict | None = None, failed: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """One build for each micro-batch (batches never overlap); reload is called only after a build that
    succeeded. A failed build ends neither the stream nor the next one: it is logged and told to `failed`, and as
    builds take all files anew, the next one has its changes too."""

    def step(batch: DataFrame, epoch: int) -> None:
        try:
            build(batch, epoch)
        except Exception as e:  # noqa: BLE001
            logging.getLogger(__name__).exception("build of batch %d failed", epoch)
            if failed:
                failed(epoch, e)
            return
        reload(epoch)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
