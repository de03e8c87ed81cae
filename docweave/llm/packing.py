"""Packing of documents into sequences of at most `length` tokens: first-fit decreasing in random groups.

Every document becomes its token ids and an end id. While a document has `length` ids or more, full sequences are
cut off it; what is left of it is an item. Items are dealt at random to groups of about GROUP_TOKENS tokens, each
packed on its own: in order of falling size every item goes to the first bin with room for it, found by a
tournament tree whose nodes hold the largest room below them. Texts may be cut, so what first-fit leaves is mended:
items of the emptiest bins are cut into the room of the others, until at most one bin of a group is not full, and
that one is split at its binary digits, as a sequence whose length is a power of two needs no padding.

Ids are made once and stored in the shared folder, so a lost executor costs the tasks it ran. Only items travel, in
one shuffle; a group is bounded whatever ids, texts or sizes repeat, as groups are drawn by the row in the stored table.

Defined results: a null or empty text is a document of the end id alone; rows that repeat an id are documents of their
own; null ids are kept. Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import arrow_map, filled_text, slices, stored
from docweave.llm.token_ids import with_end, word_ids

LENGTH = 2048
#: Tokens of items in a group, about.
GROUP_TOKENS = 1 << 20


class Tournament:
    """Bins with room for `size` each; a node holds the largest room of the bins below it."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [size] * (2 * self.leaves)

    def first_with(self, size: int) -> int:
        """The first bin with room for size; one always has."""
        room, at = self.room, 1
        while at < self.leaves:
            at = 2 * at if room[2 * at] >= size else 2 * at + 1
        return at - self.leaves

    def take(self, bin: int, size: int) -> None:
        room, at = self.room, bin + self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most


def first_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """The numbers of the items in each bin; sizes are from 1 to length."""
    tree, bins = Tournament(max(1, len(sizes)), length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = tree.first_with(sizes[k])
        tree.take(b, sizes[k])
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def filled_up(bins: list[list[int]], sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (item, start, size), of which at most one is not full: the emptiest are taken apart and cut
    into the room of the fuller ones."""
    made = sorted(([(k, 0, sizes[k]) for k in b] for b in bins), key=lambda b: -sum(p[2] for p in b))
    room = [length - sum(p[2] for p in b) for b in made]
    a = 0
    while a < len(made) and not room[a]:
        a += 1
    while a < len(made) - 1:
        k, start, size = made[-1].pop()
        part = min(size, room[a])
        made[a].append((k, start, part))
        if part < size:
            made[-1].append((k, start + part, size - part))
        room[a] -= part
        if not made[-1]:
            made.pop()
        while a < len(made) and not room[a]:
            a += 1
    return made


def binary_parts(pieces: list[tuple[int, int, int]], length: int) -> list[list[tuple[int, int, int]]]:
    """A bin cut into sequences whose lengths are powers of two, the largest first; a full one stays."""
    total = sum(p[2] for p in pieces)
    if total == length:
        return [pieces]
    out, rest = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        want, part = total & 1 << bit, []
        while want:
            k, start, size = rest.pop()
            take = min(size, want)
            part.append((k, start, take))
            if take < size:
                rest.append((k, start + take, size - take))
            want -= take
        if part:
            out.append(part)
    return out


def packed_group(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, size) of the items of one group."""
    return [s for b in filled_up(first_fit_decreasing(sizes, length), sizes, length) for s in binary_parts(b, length)]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """One row for each full sequence that a document alone fills (with its CRC) and for what is left (with its ids):
    doc_id, start, length, doc_tokens, ids_crc32 or ids."""

    def make():
        words = word_ids(tokenizer)

        def f(batch):
            for part in slices(batch):
                ids, counts = with_end(*words.ids(filled_text(part)), end_id)
                rows, at = [], 0
                for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist()):
                    full = n // length * length
                    rows += [(doc, k, length, n, _crc(ids[at + k : at + k + length]), None) for k in range(0, full, length)]
                    if full < n:
                        rows.append((doc, full, n - full, n, None, ids[at + full : at + n].astype(words.kind).tobytes()))
                    at += n
                types = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

        return f

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


def packed(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    if length < 1:
        raise ValueError("a sequence holds one token at least")
    numbered = tokenised(docs, tokenizer, end_id, length).withColumn("row", F.monotonically_increasing_id())
    cut = stored(numbered, "cut-ids")
    items = cut.filter("ids IS NOT NULL")
    total = items.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    # full sequences are numbered by their rows, with odd numbers; sequences of groups have even ones
    full = cut.filter("ids_crc32 IS NOT NULL").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = items.withColumn("group", F.pmod(F.xxhash64(F.lit("packing"), "row"), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        sizes, group = table["length"].to_pylist(), table["group"][0].as_py()
        docs_, starts, totals, raw = (table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        out = []
        for number, sequence in enumerate(packed_group(sizes, length)):
            offset = 0
            for k, start, size in sequence:
                ids = np.frombuffer(raw[k], "<u2" if len(raw[k]) == 2 * sizes[k] else "<u4")[start : start + size]
                out.append((docs_[k], starts[k] + start, size, _crc(ids), totals[k], 2 * (group << 32 | number), offset))
                offset += size
        return pa.table([pa.array(list(c), pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return full.unionByName(dealt.groupBy("group").applyInArrow(pack, PIECE))
