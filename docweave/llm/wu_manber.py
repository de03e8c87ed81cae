"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items become words (A-Z lower-cased; runs of digits, letters and non-ASCII), joined by
single spaces with one at either end. Each window of consecutive item words is a pattern; an item with
fewer words than a window is one pattern. Patterns of similar length share a matcher: a shift table on
blocks of BLOCK bytes skips positions where no pattern can end, blocks without a shift lead to the patterns
with this suffix block, and bytes are compared to confirm an occurrence.

The benchmark is taken in blocks of bounded size, each a broadcast of its own, so what a task holds does not grow
with it. Documents are read once: a task searches a batch of texts for one block after the other and merges the hits.

Defined results: null or wordless documents have no hits and are not contaminated; null or wordless items
match nothing; items that repeat an id count once; items without an id hit, but are not counted or listed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import arrow_map, filled_text, slices

BLOCK = 6
#: Bytes of benchmark text that one matcher holds.
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z and blanks all bytes that belong to no word.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


class Matcher:
    """Wu-Manber over patterns that all have at least `least` bytes."""

    def __init__(self, patterns: list[bytes]):
        self.least = m = min(map(len, patterns))
        self.block = b = min(BLOCK, m)
        self.default = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            head = p[:m]  # all patterns are judged by their first m bytes
            for end in range(b, m + 1):
                key = head[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            self.bucket[head[m - b :]].append(p)

    def search(self, text: bytes):
        """(start, pattern) of every occurrence."""
        shift, default, b, m, n = self.shift.get, self.default, self.block, self.least, len(text)
        at = m
        while at <= n:
            s = shift(text[at - b : at], default)
            if s:
                at += s
                continue
            start = at - m
            for p in self.bucket[text[at - b : at]]:
                if text.startswith(p, start):
                    yield start, p
            at += 1


class Windows:
    """The patterns of a block of items, with the items they belong to."""

    def __init__(self, items: list[tuple[object, str]], width: int):
        self.items: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            w = words(text or "")
            if w:
                for k in range(max(1, len(w) - width + 1)):
                    self.items[b" " + b" ".join(w[k : k + width]) + b" "].add(item)
        classes = defaultdict(list)
        for p in self.items:
            classes[len(p).bit_length()].append(p)
        self.matchers = [Matcher(ps) for ps in classes.values()]

    def hits(self, text: str) -> tuple[int, list[tuple[int, int]], set]:
        """Words of the text, word spans of the windows that occur, and the items they belong to."""
        w = words(text)
        line = b" " + b" ".join(w) + b" "
        spans, items, gaps = [], set(), None
        for matcher in self.matchers:
            for start, p in matcher.search(line):
                if gaps is None:
                    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
                first = bisect_right(gaps, start) - 1
                spans.append((first, first + p.count(b" ") - 1))
                items |= self.items[p]
        items.discard(None)
        return len(w), spans, items


def union_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


RESULT = "doc_id long, text_key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _summary(doc, key: int, n: int, spans, items, share: int) -> tuple:
    hit = sum(b - a for a, b in union_spans(spans))
    return doc, key, n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and share * hit >= n


def _table(rows: list[tuple]) -> tuple[list, list[str]]:
    cols = list(zip(*rows)) if rows else [[]] * 7
    types = [pa.int64()] * 5 + [pa.string(), pa.bool_()]
    return [pa.array(list(c), t) for c, t in zip(cols, types)], ["doc_id", "text_key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items in blocks of bounded size, one after the other."""
    held, size = [], 0
    for row in benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        held.append((row.item, row.text))
        size += len(row.text.encode())
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


#: Blocks whose matchers a task keeps; bytes of texts that are searched for one block after the other, if all matchers
#: are kept and if some are made again for each batch.
HELD_BLOCKS, PART_BYTES, BATCH_BYTES = 4, 8 << 20, 64 << 20


def searcher(benchmark: DataFrame, width: int, block_bytes: int):
    """A function to be called in a task, which gives one from texts to the hits of each (words, spans, items), and the
    bytes of a batch of texts. The first HELD_BLOCKS matchers are kept in the task, others are made again for each batch."""
    sent = [benchmark.sparkSession.sparkContext.broadcast(b) for b in item_blocks(benchmark, block_bytes)]

    def begin():
        kept = [Windows(b.value, width) for b in sent[:HELD_BLOCKS]] or [Windows([], width)]

        def search(texts: list[str]) -> list[tuple[int, list, set]]:
            found = [(n, union_spans(spans), set(items)) for n, spans, items in map(kept[0].hits, texts)]
            for k in range(1, len(sent)):
                windows = kept[k] if k < len(kept) else Windows(sent[k].value, width)
                for row, text in enumerate(texts):
                    _, spans, items = windows.hits(text)
                    if spans:
                        n, before, held = found[row]
                        found[row] = n, union_spans([*before, *spans]), held | items
            return found

        return search

    return begin, PART_BYTES if len(sent) <= HELD_BLOCKS else BATCH_BYTES


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, with all their columns, without the rows that contamination() calls contaminated; one pass, no join."""
    begin, most = searcher(benchmark, width, block_bytes)

    def make():
        search = begin()

        def f(batch):
            for part in slices(batch, most):
                hit = [(n, sum(b - a for a, b in spans)) for n, spans, _ in search(filled_text(part).to_pylist())]
                yield part.filter(pa.array([not h or share * h < n for n, h in hit], pa.bool_()))

        return f

    return arrow_map(docs, make, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words) for every
    row; text_key tells rows with one id apart."""
    begin, most = searcher(benchmark, width, block_bytes)

    def make():
        search = begin()

        def f(batch):
            for part in slices(batch, most):
                found = search(filled_text(part).to_pylist())
                rows = [_summary(d, k, *x, share) for d, k, x in zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), found)]
                yield pa.RecordBatch.from_arrays(*_table(rows))

        return f

    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), make, RESULT)
