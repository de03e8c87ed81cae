"""Periodic runs of words: the maximal stretches that repeat with a smallest period, by Lyndon arrays.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring
word extends keeping that period; those of at least max(min_length, min_exponent * q) words are reported. By the
runs theorem the Lyndon root of a run is the longest Lyndon word at its place under one of two orders, one the
reverse of the other, so each run shows as an edge from a suffix to the next smaller one (Ellert and Fischer,
"Linear Time Runs over General Ordered Alphabets", 2021). Both arrays come from one scan with a stack of previous
smaller suffixes, in which a comparison takes up what earlier ones have matched:

  - inside the stretch that the furthest comparison has matched, results are read off at the place it matched
  - for suffixes l < t of the stack the common prefixes of (l, t) and (t, r) give that of (l, r) unless equal
  - only from there on words are compared, and every equal pair moves the furthest match on

Words are only ever compared; no suffix array, no hashes of stretches. Before the scan a sieve leaves out what can
hold no run: a run's words occur min_exponent times in its row and its short word groups twice. It takes exact
names of groups of 1, 2, 4, 8 words by sorting, and changes no result.

Defined results: null, empty and wordless texts have no runs and an empty collapsed text; rows that repeat an id
each have their own result; null ids are kept. Extra columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import arrow_map, filled_text, slices

MIN_LENGTH, MIN_EXPONENT = 24, 3


def next_smaller_suffixes(x: list[int]) -> tuple[list[int], list[int]]:
    """For each i the start of the next suffix smaller than that of i (len(x) if none), and their common prefix.
    x[i : next[i]] is the longest Lyndon word at i. A suffix that is a prefix of another is the smaller one."""
    n = len(x)
    up, up_match = [n] * n, [0] * n  # next smaller suffix
    down, down_match = [-1] * n, [0] * n  # previous smaller suffix
    stack = [0] if n else []
    far = first = shift = 0  # x[first:far] equals what stands `shift` before it
    for r in range(1, n):
        t = stack[-1]
        k, open_end = 0, True
        while True:
            if open_end:  # k words are known to match
                if r + k < far and t >= first:
                    i, j = t - shift, r - shift
                    known = up_match[i] if up[i] == j else down_match[j] if down[j] == i else -1
                    if known >= k:
                        k, open_end = (known, False) if r + known < far else (far - r, True)
                if open_end:
                    a, b = t + k, r + k
                    while b < n and x[a] == x[b]:
                        a += 1
                        b += 1
                    k = b - r
                    if b >= far:
                        far, first, shift = b, r, r - t
                if r + k < n and x[t + k] < x[r + k]:
                    down[r], down_match[r] = t, k
                    break
            up[t], up_match[t] = r, k
            stack.pop()
            if not stack:
                break
            between = down_match[t]  # what t and the suffix below it have in common
            t = stack[-1]
            if between < k:
                down[r], down_match[r] = t, between
                break
            open_end = between == k
        stack.append(r)
    return up, up_match


def runs(x: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of x, by start, then period."""
    found = set()
    for order in (x, [-v for v in x]):
        up, match = (np.array(a, np.int64) for a in next_smaller_suffixes(order))
        at = np.arange(len(x))
        period = up - at
        # left of a run's first root stand fewer words than a period
        edge = np.flatnonzero((match > (min_exponent - 2) * period) & (up < len(x)))
        edge = edge[np.lexsort((edge, period[edge], up[edge] + match[edge]))]
        ends, periods = up[edge] + match[edge], period[edge]
        root = np.ones(len(edge), bool)  # of edges with one end and period the first
        root[1:] = (ends[1:] != ends[:-1]) | (periods[1:] != periods[:-1])
        for start, q, end in zip(edge[root].tolist(), periods[root].tolist(), ends[root].tolist()):
            while start and x[start - 1] == x[start - 1 + q]:
                start -= 1
            if end - start >= max(min_length, min_exponent * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda f: (f[0], f[2]))


def _joined(starts: np.ndarray, rows: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of at least `least` words that groups of `width` words with consecutive starts in one row cover."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(rows[starts]) != 0)) + 1
    first, last = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + width
    keep = last - first >= least
    return first[keep], last[keep]


def sieve(codes: np.ndarray, rows: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words in which all runs lie, each run in one of them. With L >= 3q and
    width <= 1 + min_length / 3 every group of a run has another one a period away in the run."""
    name = np.full(len(codes), -1, np.int64)
    starts, width, least = np.arange(len(codes)), 1, min_exponent
    key = rows * (int(codes.max(initial=0)) + 1) + codes
    while True:
        _, names, counts = np.unique(key, return_inverse=True, return_counts=True)
        often = counts[names] >= least
        starts, names = starts[often], names[often]
        first, last = _joined(starts, rows, width, min_length)
        if 2 * width > 1 + min_length // 3 or min_exponent < 3 or not len(first):
            return first, last
        inside = np.zeros(len(codes) + 1, np.int64)
        np.add.at(inside, first, 1)
        np.add.at(inside, last - width + 1, -1)
        inside = np.cumsum(inside)[:-1] > 0
        name[:] = -1
        name[starts] = names
        name[~inside] = -1
        starts = np.flatnonzero(name[: len(codes) - width] >= 0)
        starts = starts[(name[starts + width] >= 0) & (rows[starts] == rows[starts + width])]
        key = name[starts] * (len(counts) + 1) + name[starts + width]
        width, least = 2 * width, 2


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; word numbers from 0, by start, then period) and collapsed (the
    words joined by single spaces, without those that a run repeats after its first period) for every row."""

    def make():
        def f(batch):
            for part in slices(batch, 4 << 20):
                words = pc.ascii_split_whitespace(filled_text(part))
                rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
                words = words.flatten()
                real = pc.greater(pc.binary_length(words), 0)
                rows, words = rows[real.to_numpy(zero_copy_only=False)], words.filter(real)
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.searchsorted(rows, np.arange(part.num_rows), side="right")
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                found, gone = [[] for _ in range(part.num_rows)], np.zeros(len(codes) + 1, np.int64)
                for a, b in zip(*(s.tolist() for s in sieve(codes, rows, min_length, min_exponent))):
                    row = int(rows[a])
                    for start, length, q in runs(codes[a:b].tolist(), min_length, min_exponent):
                        found[row].append((a + start - int(begins[row]), length, q))
                        gone[a + start + q] += 1
                        gone[a + start + length] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=part.num_rows))]).astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string()))
                flat = [x for f in found for x in sorted(f, key=lambda x: (x[0], x[2]))]
                cols = list(zip(*flat)) if flat else [[]] * 3
                each = pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["start", "length", "period"])
                cuts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ends - begins, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), each), texts.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        return f

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest exact length/period; ties: smallest start, then period; null if there is none."""

    def better(best: Column, r: Column) -> Column:
        ours, theirs = r["length"] * best["period"], best["length"] * r["period"]
        earlier = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when(best.isNull() | (ours > theirs) | ((ours == theirs) & earlier), r).otherwise(best)

    return F.aggregate(found, F.get(found, 0), better)


def written(found: Column) -> Column:
    """start,length,period and a line feed for each run."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run with exponent_milli, and digests of all runs and of the collapsed text."""
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(written(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs in which every row with crc32(doc_id) = 0 modulo 10 ends periodically: with g the crc over 10 and n words,
    word i >= a = g % n becomes word a + (i - a) % p for p = 1 + (n - a) div (3 + g % 8). Rows without an id or
    without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, g = F.size("__words").cast("long"), F.floor(h / 10).cast("long")
    chosen = docs.withColumn("__words", F.when(h % 10 == 0, words))
    a = F.when(n > 0, g % n)
    p = 1 + F.expr("(size(__words) - __a) div (3 + __g % 8)")
    chosen = chosen.withColumn("__g", g).withColumn("__a", a).withColumn("__p", p)
    turned = F.transform("__words", lambda w, i: F.when(i < F.col("__a"), w).otherwise(F.get("__words", (F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int"))))
    return chosen.withColumn("text", F.when(F.size("__words") > 0, F.array_join(turned, " ")).otherwise(F.col("text"))).drop("__words", "__g", "__a", "__p")
