"""Hard negatives: for each anchor and positive the best rows of other labels within a window of scores.

Components become floor(scale * x), so a score is an inner product of whole numbers. Blocks of anchors are broadcast and
multiplied with blocks of candidates as dense float64 matrices, which is exact while every partial sum is below 2^53; rows
that could pass this bound are multiplied as Python integers, and scores beyond 64 bits stop at the largest number.

The first pass keeps the best `positives` rows of its label for each anchor, the second the best `negatives` rows of
other labels for each anchor and positive with low * positive <= 100 * negative <= high * positive. Either keeps a bounded
list for each anchor in a task, and lists of tasks are merged by a window. Every row is scored against every anchor
and nothing else is left out; a broadcast holds at most ANCHOR_BYTES, so more anchors mean more passes.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows
without an id; vectors of different lengths have no score; equal scores are ordered by vec_id, rows that repeat an id are
rows of their own (each an anchor, a positive or a negative). Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import arrow_map, one_array, stored

#: Bytes of the anchors in one broadcast with the lists that a task keeps for them; rows of a block of anchors and of candidates.
ANCHOR_BYTES, ANCHOR_ROWS, CANDIDATE_ROWS = 64 << 20, 1024, 2048
EXACT = 2.0**53
LARGEST = (1 << 63) - 1


def prepared(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """row, vec_id, label, whole (floor(scale * x) as doubles) of the rows that take part, stored."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", finite)
    whole = F.transform("embedding", lambda x: _floor(scale * x.cast("double")))
    rows = vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), whole.alias("whole"))
    # numbers are stored with the rows, so they hold in every later job
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "whole-vectors")


def _floor(x: Column) -> Column:
    """floor() as a double, as Spark's own ends at 64 bits."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


class Block:
    """Rows of one vector length, in the order of their ids."""

    def __init__(self, row, vec, label, matrix):
        order = np.lexsort((row, vec))
        self.row, self.vec, self.label, self.matrix = row[order], vec[order], label[order], matrix[order]
        self.most = float(np.abs(matrix).max(initial=0))

    def slices(self, rows: int) -> Iterator[Block]:
        for a in range(0, len(self.row), rows):
            yield Block(*(x[a : a + rows] for x in (self.row, self.vec, self.label, self.matrix)))


def blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    """One block for each vector length in the batch."""
    vectors = one_array(batch.column("whole"))
    ends = vectors.offsets.to_numpy()
    size, flat = np.diff(ends), vectors.values.to_numpy(zero_copy_only=False)
    row, vec, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        yield Block(row[which], vec[which], label[which], flat[ends[which][:, None] + np.arange(n)].reshape(len(which), n))


def scores(a: Block, b: Block) -> np.ndarray:
    """Whole inner products of all rows of a with all rows of b. Rows whose products could pass 2^53 are left out of the
    matrix product and multiplied as Python integers."""
    n = max(1, a.matrix.shape[1])
    if a.most * b.most * n < EXACT:
        return (a.matrix @ b.matrix.T).astype(np.int64)
    most = [np.abs(x.matrix).max(axis=1, initial=0) for x in (a, b)]
    narrow = [m < (EXACT / n) ** 0.5 for m in most]
    out = np.zeros((len(a.row), len(b.row)), np.int64)
    out[np.ix_(*narrow)] = (a.matrix[narrow[0]] @ b.matrix[narrow[1]].T).astype(np.int64)
    left, right = ([[int(v) for v in r] for r in x.matrix.tolist()] for x in (a, b))
    for i, j in zip(*np.nonzero(~(narrow[0][:, None] & narrow[1]))):
        out[i, j] = max(-LARGEST, min(LARGEST, sum(p * q for p, q in zip(left[i], right[j]))))
    return out


class Best:
    """The best k of the rows seen so far for each of n searches: higher scores first, then smaller ids and rows."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -LARGEST - 1)
        self.vec, self.row = np.zeros((n, k), np.int64), np.full((n, k), -1)

    def add(self, first: int, s: np.ndarray, fits: np.ndarray, b: Block) -> None:
        """s and fits: scores of searches first, first + 1, .. with the rows of b, and which of them count."""
        n, k = len(s), self.k
        least = self.score[first : first + n, -1]
        fits = fits & ((s > least[:, None]) | ((s == least[:, None]) & (b.vec <= self.vec[first : first + n, -1, None])) | (self.row[first : first + n, -1, None] < 0))
        if np.count_nonzero(fits) > 4 * k * n and s.shape[1] > k:
            inside = np.where(fits, s, -LARGEST - 1)
            fits &= s >= np.partition(inside, -k, axis=1)[:, -k, None]
        at, col = np.nonzero(fits)
        if not len(at):
            return
        own = np.flatnonzero(self.row[first : first + n].reshape(-1) >= 0)
        which = np.concatenate([own // k, at])
        score = np.concatenate([self.score[first : first + n].reshape(-1)[own], s[at, col]])
        vec = np.concatenate([self.vec[first : first + n].reshape(-1)[own], b.vec[col]])
        row = np.concatenate([self.row[first : first + n].reshape(-1)[own], b.row[col]])
        order = np.lexsort((row, vec, -score, which))
        which, score, vec, row = (x[order] for x in (which, score, vec, row))
        place = np.arange(len(which)) - np.searchsorted(which, which)
        keep = place < k
        for held, new in ((self.score, score), (self.vec, vec), (self.row, row)):
            held[first + which[keep], place[keep]] = new[keep]

    def found(self) -> tuple[np.ndarray, ...]:
        """search, score, vec, row of all that are held."""
        which, place = np.nonzero(self.row >= 0)
        return which, self.score[which, place], self.vec[which, place], self.row[which, place]


def _searches(candidates: DataFrame, sent, per_anchor: int, k: int, window: bool) -> DataFrame:
    """anchor, nth, score, vec_id, row: for each of per_anchor searches of every anchor sent, a task's best k."""

    def run(batches):
        held = sent.value
        anchors = [a for x in held for a in x.slices(ANCHOR_ROWS)] if not window else held
        best = [[Best(len(a.row), k) for _ in range(per_anchor)] for a in (x if not window else x[0] for x in anchors)]
        for batch in batches:
            for whole in blocks_of(batch):
                for b in whole.slices(CANDIDATE_ROWS):
                    for x, own in zip(anchors, best):
                        a, low, high = x if window else (x, None, None)
                        if a.matrix.shape[1] != b.matrix.shape[1]:
                            continue
                        s = scores(a, b)
                        same = a.label[:, None] == b.label
                        if not window:
                            own[0].add(0, s, same & (a.row[:, None] != b.row), b)
                            continue
                        other = ~same
                        for j in range(per_anchor):
                            own[j].add(0, s, other & (s >= low[:, j, None]) & (s <= high[:, j, None]), b)
        for x, own in zip(anchors, best):
            a = x[0] if window else x
            for j, o in enumerate(own):
                which, score, vec, row = o.found()
                if len(which):
                    yield pa.RecordBatch.from_arrays([pa.array(a.row[which]), pa.array(np.full(len(which), j, np.int32)), pa.array(score), pa.array(vec), pa.array(row)], ["anchor", "nth", "score", "vec_id", "row"])

    return candidates.mapInArrow(run, "anchor long, nth int, score long, vec_id long, row long")


def _best(parts: DataFrame, k: int) -> DataFrame:
    """The best k of all tasks' lists for each search, with their rank."""
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "vec_id", "row")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _windows(anchors: list[Block], found: pa.Table, positives: int, low: int, high: int) -> list[tuple[Block, np.ndarray, np.ndarray]]:
    """Each block of anchors with the least and the largest score that a negative may have for each positive."""
    at: dict[int, dict[int, int]] = {}
    for anchor, rank, score in zip(*(found[c].to_pylist() for c in ("anchor", "rank", "score"))):
        at.setdefault(anchor, {})[rank - 1] = score
    out = []
    for whole in anchors:
        for a in whole.slices(ANCHOR_ROWS):
            lows, highs = np.ones((len(a.row), positives), np.int64), np.zeros((len(a.row), positives), np.int64)
            for i, row in enumerate(a.row.tolist()):
                for j, score in at.get(row, {}).items():  # whole numbers, so no rounding
                    lows[i, j], highs[i, j] = max(-LARGEST, -(-low * score // 100)), min(LARGEST, high * score // 100)
            out.append((a, lows, highs))
    return out


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label).
    anchors: which rows are anchors; label: what rows are told apart by, the column itself if None."""
    spark = vectors.sparkSession
    rows = prepared(vectors, F.col("label") if label is None else label, scale)
    asked = rows.filter(anchors)
    needed = asked.agg(F.sum(8 * F.size("whole") + 24 * positives * (negatives + 1))).first()[0] or 0
    passes = max(1, -(-needed // anchor_bytes))
    asked = asked.withColumn("pass", F.pmod(F.xxhash64("row"), F.lit(passes)))
    out = None
    for p in range(passes):
        mine = asked.filter(F.col("pass") == p).drop("pass").toArrow()
        blocks = [b for batch in mine.combine_chunks().to_batches() for b in blocks_of(batch)]
        sent = spark.sparkContext.broadcast(blocks)
        near = stored(_best(_searches(rows, sent, 1, positives, False), positives), "positives")
        sent.unpersist()
        # positives of the anchors of one pass, as bounded as the anchors
        windows = _windows(blocks, near.select("anchor", "rank", "score").toArrow(), positives, low, high)
        sent = spark.sparkContext.broadcast(windows)
        hard = _best(_searches(rows, sent, positives, negatives, True), negatives)
        ids = rows.filter(anchors).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        near = near.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        each = hard.join(near, ["anchor", "nth"]).join(ids, "anchor")
        each = stored(each.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
        sent.unpersist()
        out = each if out is None else out.unionByName(each)
    return out
