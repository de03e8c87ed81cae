"""Tables in the shared folder of the cluster, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows, that may be broadcast after it has been counted.
BROADCAST_ROWS = 400_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); one of our own only where it is unset and all
    executors are on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """The folder of all tables that this application stores."""
    return f"{scratch_root(spark)}/docweave/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all that this application has stored. Results that have not been written yet read from it, so this is for
    the end of a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str, path: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. Parquet
    readers hold up to 4096 rows of a file at once, so tables of large values need few rows in a file."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else df as it is (shuffled join). df should be stored()."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Tasks for each core where rows cost much more than their bytes.
WAVES = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by a hash of its keys to a few tasks for each core. For rows that cost much more than their bytes: those of
    a small file would otherwise all be in one task."""
    return df.repartition(WAVES * df.sparkSession.sparkContext.defaultParallelism, *keys)


def in_ranges(df: DataFrame, key: str) -> DataFrame:
    """As dealt(), in sorted ranges of a key, so that a task's rows lie near each other."""
    return df.repartitionByRange(WAVES * df.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key)
