"""Token ids in a compact binary form: canonical length-limited Huffman codes made from global counts.

A corpus is a folder with two tables, written by Spark's committed writers into the shared folder:

  code/    id, bits: the code length of every id that occurs (a canonical code is fixed by its lengths)
  blocks/  one row for each independent block, in the order of (part, block): how many documents begin
           and how many ids stand before it in its part, how many of its first ids belong to documents
           that began earlier, its documents' ids and lengths, its number of ids, the bit offset of every
           STEP-th id (checkpoints), and the bit stream

Documents are in ascending doc_id order over parts, and a long document may run over several blocks.
Decoding peeks at `limit` bits and looks symbol and length up in one table; all checkpoints of a block
are decoded side by side.

Defined results: null text counts as empty (a document of the end id alone); rows with the same doc_id
stand next to each other, ordered by text; null doc_ids come first; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import arrow_map, begin, filled_text, held, remove, scratch_path, slices, small, stored, tidy, trim

#: Ids in a block, ids between two checkpoints, most bits of a code.
BLOCK, STEP, LIMIT = 1 << 18, 512, 20
#: Blocks in a file; a reader holds all blocks of a file at once.
FILE_BLOCKS = 16


# --- tokenising -----------------------------------------------------------------------------------


#: Characters from which words are not kept, so that caches are bounded in bytes.
LONG_WORD = 100


class Cache:
    """Two generations: when the young one is full it becomes the old one; what is used again moves back."""

    def __init__(self, keep: int):
        self.keep, self.young, self.old = keep, {}, {}

    def find(self, keys: list[str]) -> tuple[list, list[int]]:
        """The values (None where missing) and the places of the missing ones."""
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        missing = []
        for k, v in enumerate(out):
            if v is None:
                v = old.get(keys[k])
                if v is None:
                    missing.append(k)
                else:
                    out[k] = young[keys[k]] = v
        return out, missing

    def turn(self) -> None:
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}


class WordIds:
    """Ids of white-space separated words, for vocabularies that drop white space and mark word ends. The
    library encodes each distinct letter run once (while the cache lasts); a word of letters and closing signs
    is put together from the two, as the vocabulary's pattern never joins them. Other words go to the library
    whole. Words are taken apart and put together by column, not one by one."""

    PLAIN = r"^(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[.,;:!?%*$#&|]*)\z"

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self.encode_batch = t.encode_batch_fast
        self.words, self.runs = Cache(keep // 4), Cache(keep)
        self.kind = np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(max(t.get_vocab().values()) + 1, bool)
        self.ends[[i for w, i in t.get_vocab().items() if w.endswith("</w>")]] = True

    def _letters(self, runs: list[str]) -> list[bytes]:
        """Ids of distinct lower-case letter runs, encoded together and cut at word ends."""
        out, missing = self.runs.find(runs)
        young = self.runs.young
        for a in range(0, len(missing), 500):
            part = [runs[k] for k in missing[a : a + 500]]
            ids = np.array(self.encode_batch([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not mark word ends")
            raw, at = ids.tobytes(), 0
            for k, w, end in zip(missing[a : a + 500], part, (ends * self.kind.itemsize).tolist()):
                out[k] = raw[at:end]
                if len(w) < LONG_WORD:
                    young[w] = out[k]
                at = end
        self.runs.turn()
        return out

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.encode_batch(words, add_special_tokens=False)]

    def _others(self, words: list[str]) -> list[bytes]:
        out, missing = self.words.find(words)
        for a in range(0, len(missing), 20_000):
            part = missing[a : a + 20_000]
            for k, ids in zip(part, self._whole([words[k] for k in part])):
                out[k] = ids
                if len(words[k]) < LONG_WORD:
                    self.words.young[words[k]] = ids
        self.words.turn()
        return out

    def _gather(self, pieces: list[bytes], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pairs of pieces, one pair after the other, and how many each pair has."""
        ids = np.frombuffer(b"".join(pieces), self.kind)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.kind.itemsize
        which = np.stack([first, second], 1).reshape(-1)
        flat, n = _spread(ids, sizes, which)
        return flat, n.reshape(-1, 2).sum(1)

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        words = pc.ascii_split_whitespace(text)
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        taken = pc.extract_regex(coded.dictionary, self.PLAIN)
        plain = taken.is_valid().to_numpy(zero_copy_only=False)
        taken = taken.filter(taken.is_valid())
        runs = pc.utf8_lower(pc.struct_field(taken, "run")).dictionary_encode()
        signs = pc.struct_field(taken, "signs").dictionary_encode()
        heads = self._letters(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        tails = [self._whole([s])[0] if s else b"" for s in signs.dictionary.to_pylist()]
        rest = self._others(coded.dictionary.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist())
        first, second = np.empty(len(plain), np.int64), np.full(len(plain), len(heads) + len(tails) + len(rest))
        first[plain], second[plain] = runs.indices.to_numpy(zero_copy_only=False), len(heads) + signs.indices.to_numpy(zero_copy_only=False)
        first[~plain] = len(heads) + len(tails) + np.arange(len(rest))
        flat, sizes = self._gather([*heads, *tails, *rest, b""], first, second)
        ids, n = _spread(flat, sizes, which)
        word_ends = np.cumsum(per_text)
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[word_ends] - total[word_ends - per_text]


def _spread(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat holds runs of the given sizes; those numbered `which`, one after the other, and their sizes."""
    if not len(which):
        return flat[:0], np.zeros(0, np.int64)
    n = sizes[which]
    ends = np.cumsum(n)
    shift = (np.cumsum(sizes) - sizes)[which] - (ends - n)
    return flat[np.arange(int(ends[-1])) + np.repeat(shift, n)], n


def word_ids(path: str) -> WordIds:
    """One for each worker process, so caches outlive a task."""
    return held(("words", path), lambda: WordIds(path))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text's ids."""
    return np.insert(ids.astype(np.uint32), np.cumsum(counts), end_id), counts + 1


# --- the code -------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with at most `limit` bits (package-merge); counts are positive."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit in {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.float64)[order]
    merged, levels = weights, []
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        merged = both[rank]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: ids and their lengths."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = np.asarray(ids, np.int64)[order], np.asarray(bits, np.int64)[order]
        self.limit = int(self.bits.max(initial=1))
        space = 1 << (self.limit - self.bits)
        self.first = np.cumsum(space) - space  # left-aligned codes
        size = int(self.ids.max(initial=0)) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.code[self.ids] = (self.first >> (self.limit - self.bits)).astype(np.uint64)
        self.length[self.ids] = self.bits.astype(np.uint64)
        self.symbol_at = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream and the bit offset of every STEP-th id."""
        n, code = self.length[ids], self.code[ids]
        ends = np.cumsum(n, dtype=np.uint64)
        starts = ends - n
        word, inside = (starts >> np.uint64(5)).astype(np.int64), starts & np.uint64(31)
        placed = code << (np.uint64(64) - inside - n)
        size = (int(ends[-1]) + 31) // 32 + 2 if len(ends) else 2
        out = np.bincount(word, weights=(placed >> np.uint64(32)).astype(np.float64), minlength=size)
        out += np.bincount(word + 1, weights=(placed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
        return out.astype(np.uint64).astype(">u4").tobytes(), starts[::STEP].astype(np.uint32)

    def decode(self, stream: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        if self.symbol_at is None:
            space = 1 << (self.limit - self.bits)
            fill = (1 << self.limit) - int(space.sum())
            self.symbol_at = np.concatenate([np.repeat(self.ids, space), np.zeros(fill, np.int64)]).astype(np.uint32)
            self.bits_at = np.concatenate([np.repeat(self.bits, space), np.ones(fill, np.int64)]).astype(np.uint8)
        words = np.frombuffer(stream, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        lanes = len(checkpoints)
        out = np.zeros((STEP, lanes), np.uint32)
        at = checkpoints.astype(np.int64)
        last, top = len(pairs) - 1, 64 - self.limit
        for k in range(min(STEP, n)):
            peek = (pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> np.uint64(top)
            out[k] = self.symbol_at[peek]
            at += self.bits_at[peek]
        return out.T.reshape(-1)[:n]


# --- writing and reading --------------------------------------------------------------------------


def raw_ids(batch: pa.RecordBatch):
    """The ids of raw blocks, which have two bytes each where the vocabulary allows it."""
    for raw, n in zip(batch.column("ids"), batch.column("n_ids").to_pylist()):
        data = raw.as_buffer()
        yield np.frombuffer(data, "<u4" if data.size == 4 * n else "<u2")


def id_counts(blocks: DataFrame) -> DataFrame:
    """id, n over blocks of raw ids: one dense count in each task, then summed."""

    def run(batches):
        begin()
        tidy()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in raw_ids(batch):
                here = np.bincount(ids, minlength=len(total))
                here[: len(total)] += total
                total = here
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return blocks.select("ids", "n_ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


PLACE = "part int, block int, first_doc long, first_id long, carried long, doc_ids array<long>, doc_sizes array<long>, n_ids long, "
BLOCKS = PLACE + "checkpoints binary, stream binary"


def _cut(tokenizer: str, end_id: int):
    """Raw blocks of one ordered partition."""

    def run(batches):
        from pyspark import TaskContext

        begin()
        words, task = word_ids(tokenizer), TaskContext.get().partitionId()
        tidy()
        held, lead, docs, sizes, first, block, written = np.zeros(0, np.uint32), 0, [], [], 0, 0, 0

        def row(n):
            """The first n ids of held, with the documents that begin among them."""
            nonlocal held, lead, docs, sizes, first, block, written
            ids, held = held[:n], held[n:]
            ends = lead + np.cumsum(sizes, dtype=np.int64) if sizes else np.zeros(0, np.int64)
            k = int(np.searchsorted(ends - sizes, n)) if sizes else 0
            values = [task, block, first, written, min(lead, n), docs[:k], sizes[:k], n, ids.astype(words.kind).tobytes()]
            lead = max(0, int(ends[k - 1]) - n) if k else lead - n
            first, block, written, docs, sizes = first + k, block + 1, written + n, docs[k:], sizes[k:]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()])], ["part", "block", "first_doc", "first_id", "carried", "doc_ids", "doc_sizes", "n_ids", "ids"])

        for batch in batches:
            for part in slices(batch):
                ids, counts = with_end(*words.ids(filled_text(part)), end_id)
                held = np.concatenate([held, ids])
                docs, sizes = docs + part.column("doc_id").to_pylist(), sizes + counts.tolist()
                while len(held) >= BLOCK:
                    yield row(BLOCK)
                trim()
        if len(held):
            yield row(len(held))

    return run


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str, limit: int = LIMIT) -> None:
    """Texts are tokenised once, in ascending doc_id order, into raw blocks in the scratch folder; their
    counts give the code and each block is coded on its own. The code has at most one row for each id of
    the vocabulary, which bounds what the driver holds."""
    spark = docs.sparkSession
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    raw_path = scratch_path(spark, "raw-ids")
    raw = stored(ordered.mapInArrow(_cut(tokenizer, end_id), PLACE + "ids binary"), "raw-ids", raw_path, FILE_BLOCKS)
    counted = id_counts(raw).toPandas()
    ids, n = counted["id"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    by_id = np.argsort(ids)
    ids, n = ids[by_id], n[by_id]
    bits = code_lengths(n, limit)
    rows = [(int(a), int(b), int(c)) for a, b, c in zip(ids, bits, n)]
    spark.createDataFrame(rows, "id long, bits long, n long").coalesce(1).write.parquet(f"{path}/code")
    code = Code(ids, bits)

    def make():
        def f(batch):
            coded = [code.encode(ids) for ids in raw_ids(batch)]
            cols = [batch.column(c) for c in batch.schema.names if c != "ids"]
            names = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([c.tobytes() for _, c in coded], pa.binary()), pa.array([s for s, _ in coded], pa.binary())], [*names, "checkpoints", "stream"])

        return f

    arrow_map(raw, make, BLOCKS).write.option("compression", "none").option("maxRecordsPerFile", FILE_BLOCKS).parquet(f"{path}/blocks")
    remove(spark, raw_path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a written corpus. Blocks are decoded on their own; only a
    document that spans blocks needs its pieces (of which there is one for each block) joined."""
    rows = spark.read.parquet(f"{path}/code").orderBy("id").toPandas()
    code = Code(rows["id"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # blocks know their place in their part; where parts begin is one short row for each
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = stored(parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start")), "part-places")
    joined = blocks.join(small(parts), "part").withColumn("block_start", F.col("part_start") + F.col("first_id")).drop("part_start", "first_id")

    def make():
        def f(batch):
            for k in range(batch.num_rows):
                b = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                ids = code.decode(b["stream"], np.frombuffer(b["checkpoints"], np.uint32), b["n_ids"]).astype("<u4")
                out, at = [], b["carried"]
                if at:  # the rest, or a middle part, of a document that began in an earlier block
                    out.append((b["part"], b["first_doc"] - 1, None, b["block"], None, None, ids[:at].tobytes(), None))
                for j, (doc, n) in enumerate(zip(b["doc_ids"], b["doc_sizes"])):
                    piece = ids[at : at + n]
                    whole = len(piece) == n
                    out.append((b["part"], b["first_doc"] + j, doc, b["block"], b["block_start"] + at, n, None if whole else piece.tobytes(), zlib.crc32(piece.tobytes()) if whole else None))
                    at += len(piece)
                cols = list(zip(*out)) if out else [[]] * 8
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["part", "nth", "doc_id", "block", "start", "n_tokens", "ids", "ids_crc32"])

        return f

    pieces = arrow_map(joined, make, "part int, nth long, doc_id long, block int, start long, n_tokens long, ids binary, ids_crc32 long")
    pieces = stored(pieces, "token-pieces")
    whole = pieces.filter("ids_crc32 IS NOT NULL").select("doc_id", "start", "n_tokens", "ids_crc32")
    return whole.unionByName(_spanning(pieces.filter("ids_crc32 IS NULL")))


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the ids of all texts and return, from the files, doc_id, start, n_tokens, ids_crc32."""
    path = path or scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, end_id, path)
    return read_ids(docs.sparkSession, path)


def _spanning(pieces: DataFrame) -> DataFrame:
    """Documents cut by block ends: a running CRC over their pieces, in block order."""

    def join(table):
        parts = sorted(table.to_pylist(), key=lambda x: x["block"])
        crc = 0
        for x in parts:
            crc = zlib.crc32(x["ids"], crc)
        head = parts[0]
        return pa.table([pa.array([v], pa.int64()) for v in (head["doc_id"], head["start"], head["n_tokens"], crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return pieces.groupBy("part", "nth").applyInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")
