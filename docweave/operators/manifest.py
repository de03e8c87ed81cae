"""Content manifests: hashes, fingerprints, differences between snapshots, cache hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(files: DataFrame, content: str = "content") -> DataFrame:
    """path, sha256."""
    return files.select("path", F.sha2(F.col(content), 256).alias("hash"))


def fingerprint(hashed: DataFrame, identity: str) -> DataFrame:
    """One row; a digest of the identity and of all paths and hashes in order. Paths are summed up in 64 Ki
    ranges (by the first four digits of their own digest) first, so the last step joins short digests only."""
    part = F.substring(F.sha2(F.col("path"), 256), 1, 4)
    line = F.concat_ws(":", "path", "hash")
    parts = hashed.groupBy(part.alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))
    return parts.agg(F.sha2(F.concat(F.lit(identity + "\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "\n")), 256).alias("fingerprint"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, modified) between two manifests."""
    a, b = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).filter("change IS NOT NULL")


def same_state(old: dict, mark: str) -> bool:
    """T5: whether the inputs are as the last build had them; anything else is a full rebuild."""
    return old.get("fingerprint") == mark and isinstance(old.get("files"), dict)
