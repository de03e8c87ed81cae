"""Exact deduplication with cuckoo-filter indexes of live digests.

The digest space is dealt over shards. A shard keeps a cuckoo filter (four slots in a bucket, 16-bit
fingerprints, two candidate buckets for each key) and, by bucket, the full keys behind the fingerprints.
A filter miss proves a digest new; a hit is verified against the bucketed keys, so false positives never
join two texts. When an insertion finds no place the filter is made anew, twice as large, from the stored
keys. Deletion removes key and fingerprint.

A key is the SHA-256 of the text together with its length in bytes.

Defined results: null counts as the empty text; equal texts form a group whose row with the largest
doc_id stays (a null doc_id is smaller than any other); of rows that repeat this doc_id all are marked
kept. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import small, stored

SLOTS, MOST_KICKS = 4, 200
#: Distinct digests that one shard should hold.
SHARD_KEYS = 200_000


class CuckooIndex:
    """Live keys (bytes that begin with a uniform digest) with a value each."""

    def __init__(self, buckets: int = 1024):
        self.resizes = 0
        self._empty(1 << max(1, (buckets - 1).bit_length()))

    def _empty(self, n: int) -> None:
        self.n = n
        self.filter = np.zeros((n, SLOTS), np.uint16)
        self.content: dict[int, dict[bytes, object]] = {}  # by first bucket: the keys and their values

    def _place(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0) and both buckets."""
        mark = int.from_bytes(key[:2], "little") % 65535 + 1
        first = int.from_bytes(key[2:10], "little") & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def may_hold(self, key: bytes) -> bool:
        mark, a, b = self._place(key)
        return mark in self.filter[a] or mark in self.filter[b]

    def get(self, key: bytes):
        """The value of a live key or None: the filter first, then the bucketed content."""
        return self.content.get(self._place(key)[1], {}).get(key) if self.may_hold(key) else None

    def put(self, key: bytes, value) -> None:
        """Insert a key or replace its value."""
        if self.may_hold(key):
            held = self.content.get(self._place(key)[1])
            if held and key in held:
                held[key] = value
                return
        while not self._insert(key):
            self._resize()
        self.content.setdefault(self._place(key)[1], {})[key] = value

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._place(key)
        held = self.content.get(a)
        if not held or key not in held:
            return False
        del held[key]
        for bucket in (a, b):
            at = np.flatnonzero(self.filter[bucket] == mark)
            if len(at):
                self.filter[bucket, at[0]] = 0
                return True
        raise AssertionError("a live key has no fingerprint")

    def _insert(self, key: bytes) -> bool:
        mark, a, b = self._place(key)
        for bucket in (a, b):
            free = np.flatnonzero(self.filter[bucket] == 0)
            if len(free):
                self.filter[bucket, free[0]] = mark
                return True
        bucket, moved = b, []
        for kick in range(MOST_KICKS):
            slot = (kick * 2654435761 >> 7) % SLOTS
            moved.append((bucket, slot))
            mark, self.filter[bucket, slot] = int(self.filter[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.filter[bucket] == 0)
            if len(free):
                self.filter[bucket, free[0]] = mark
                return True
        for bucket, slot in reversed(moved):  # undo, so that the resize sees the live keys only
            mark, self.filter[bucket, slot] = int(self.filter[bucket, slot]), mark
        return False

    def _resize(self) -> None:
        """Overflow: a larger filter from the stored keys."""
        live = list(self.items())
        n = self.n * 2
        while True:
            self.resizes += 1
            self._empty(n)
            if all(self._insert(k) for k, _ in live):
                break
            n *= 2
        for k, v in live:
            self.content.setdefault(self._place(k)[1], {})[k] = v

    def items(self):
        for held in self.content.values():
            yield from held.items()

    def __len__(self) -> int:
        return sum(map(len, self.content.values()))


def _merge(first: bool):
    """Rows (key, keep_id, group_size) to one row for each live key of the task, through an index; a first
    pass over rows of documents holds about SHARD_KEYS keys at a time."""

    def rows(index):
        live = list(index.items())
        for a in range(0, len(live), 10_000):
            part = live[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], ["key", "keep_id", "group_size"])

    def run(batches):
        index, n_live = CuckooIndex(), 0
        for b in batches:
            ids = b.column("doc_id" if first else "keep_id").to_pylist()
            sizes = [1] * len(ids) if first else b.column("group_size").to_pylist()
            for key, doc, n in zip(b.column("key").to_pylist(), ids, sizes):
                old = index.get(key)
                if old is None:
                    index.put(key, (doc, n))
                    n_live += 1
                else:
                    best = old[0] if doc is None or old[0] is not None and old[0] >= doc else doc
                    index.put(key, (best, old[1] + n))
            if first and n_live >= SHARD_KEYS:  # a first pass only sums up, so it may start anew
                yield from rows(index)
                index, n_live = CuckooIndex(), 0
        yield from rows(index)

    return run


KEYED = "key binary, keep_id long, group_size long"


def text_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the key of each text."""
    filled = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", F.concat(F.unhex(F.sha2(filled, 256)), F.unhex(F.lpad(F.hex(F.octet_length(filled)), 16, "0"))).alias("key"))


def exact_duplicates(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. Each task first merges its own rows, so
    a group of any size sends one row from a task to its shard."""
    keys = stored(text_keys(docs), "digests")
    if shards is None:
        shards = max(8, -(-keys.count() // SHARD_KEYS))
    local = keys.mapInArrow(_merge(True), KEYED)
    groups = local.repartition(shards, "key").mapInArrow(_merge(False), KEYED)
    several = stored(groups.filter("group_size > 1"), "duplicate-groups")
    joined = keys.join(small(several), "key", "left")
    sha = F.lower(F.hex(F.substring("key", 1, 32)))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), sha.alias("text_sha256"))


def retract(index: CuckooIndex, keys: list[bytes]) -> int:
    """Take digests of withdrawn texts out of a shard's index; how many were live."""
    return sum(index.delete(k) for k in keys)
