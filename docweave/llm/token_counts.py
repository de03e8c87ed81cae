"""Token counts by prefix dynamic programming.

For every character position p of a text the exact number of tokens of text[:p] is known, so that
"how many tokens has this prefix" and "where must the text be cut to keep to a budget" are looked up
and nothing is encoded again.

The recurrence is count(p) = count(p - len(t)) + 1, where t is the only token ending at p that may
follow the last token before it (two tokens may be neighbours if encoding their concatenation gives
the two back). Texts fall apart at places where neither a whole text nor any prefix of it can have a
token across the gap (before white space that follows something else), so a table is made once for
each distinct piece and tables are joined.

Defined results: null and empty texts have no tokens; special-token strings inside a text count as the
library counts them by default; rows with null ids are counted like others.
"""

from __future__ import annotations

import gc
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from docweave.llm.common import arrow_map, filled_text, held, slices

#: White space as the library's pattern engine has it (fixed values, code points).
SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
#: The library's byte-level split pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that are plainly a word and closing signs; longest word, in bytes, that is treated with others.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%*$#&|]*)").fullmatch
SHORT = 32
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
RUN = re.compile(f"[{SPACE}]*")


FACTOR = 0x9E3779B97F4A7C15
POWERS = np.array([pow(FACTOR, k, 1 << 64) for k in range(SHORT + 1)], np.uint64)


def _prefix_hashes(raw: list[bytes]) -> np.ndarray:
    """Polynomial hashes (modulo 2^64) of all prefixes of short byte strings, one row each."""
    width = max(map(len, raw))
    grid = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width)
    out = np.zeros((len(raw), width + 1), np.uint64)
    for p in range(width):
        out[:, p + 1] = out[:, p] * np.uint64(FACTOR) + grid[:, p] + np.uint64(1)
    return out


def _slot(h):
    if isinstance(h, int):
        return (h * 0xC2B2AE3D27D4EB4F % (1 << 64)) >> 44
    return (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(44)


#: Characters from which words and pieces are held for one slice of texts only, so that caches are bounded in bytes.
LONG_WORD = 100


class PrefixCounter:
    """Prefix tables for one byte-level BPE vocabulary (a tokenizers .json file)."""

    def __init__(self, path: str, keep: int = 450_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.merges_only = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "pre_tokenizer": None, "post_processor": None, "normalizer": None, "decoder": None}))
        vocab = [t for t in spec["model"]["vocab"] if t not in self.specials]
        self.whole = {t for t, e in zip(vocab, self.merges_only.encode_batch(vocab, add_special_tokens=False)) if len(e) == 1}
        self.longest = max(map(len, self.whole))
        self.special = re.compile("|".join(map(re.escape, self.specials)))
        self.split = regex.compile(PATTERN)
        self.long: dict[str, bytes] = {}
        self.keep, self.pairs, self.words, self.old_words, self.pieces, self.old_pieces = keep, {}, {}, {}, {}, {}
        keep_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in keep_bytes}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.shown = [shown[b] for b in range(256)]
        byte_of = {c: b for b, c in shown.items()}
        self.tokens = [t for t in sorted(self.whole) if len(t) <= SHORT]
        raw = [bytes(byte_of[c] for c in t) for t in self.tokens]
        self.longest_short = max(map(len, raw))
        hashes = _prefix_hashes(raw)[np.arange(len(raw)), [len(r) for r in raw]]
        self.slots = np.full(1 << 20, -1, np.int32)
        self.slot_hash = np.zeros(1 << 20, np.uint64)
        for k, h in enumerate(hashes.tolist()):
            at = _slot(h)
            while self.slots[at] >= 0:
                at = (at + 1) & ((1 << 20) - 1)
            self.slots[at], self.slot_hash[at] = k, h

    def _encode(self, shown: str) -> list[str]:
        return self.merges_only.encode(shown, add_special_tokens=False).tokens

    def _neighbours(self, a: str, b: str) -> bool:
        return self._encode(a + b) == [a, b]

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the short tokens with these hashes, -1 where there is none."""
        at = _slot(hashes).astype(np.int64)
        out = np.where(self.slot_hash[at] == hashes, self.slots[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.slots[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << 20) - 1)
            same = self.slot_hash[at[open_]] == hashes[open_]
            here = self.slots[at[open_]]
            out[open_[same & (here >= 0)]] = here[same & (here >= 0)]
            open_ = open_[~same & (here >= 0)]
        return out

    def _allowed(self, keys: np.ndarray) -> np.ndarray:
        """Whether the pairs of tokens, as first * number of tokens + second, may be neighbours."""
        distinct, back = np.unique(keys, return_inverse=True)
        listed = distinct.tolist()
        known = list(map(self.pairs.get, listed))
        if None in known:
            n = len(self.tokens)
            for k, ok in enumerate(known):
                if ok is None:
                    a, b = divmod(listed[k], n)
                    known[k] = self.pairs[listed[k]] = self._neighbours(self.tokens[a], self.tokens[b])
        return np.array(known, bool)[back]

    def _short_words(self, words: list[str]) -> list[bytes]:
        """The recurrence for many words at once, one position and token length after the other."""
        if len(self.pairs) > 2 * self.keep:
            self.pairs.clear()
        order = sorted(range(len(words)), key=lambda k: -len(words[k].encode()))
        raw = [words[k].encode() for k in order]
        sizes = np.array([len(r) for r in raw])
        hashes, top, n = _prefix_hashes(raw), int(sizes[0]), len(self.tokens)
        last, count = np.full((len(raw), top + 1), -1, np.int64), np.zeros((len(raw), top + 1), np.int32)
        for p in range(1, top + 1):
            rows = np.arange(int(np.searchsorted(-sizes, -p, side="right")))
            for size in range(min(p, self.longest_short), 0, -1):
                token = self._ids(hashes[rows, p] - hashes[rows, p - size] * POWERS[size])
                is_token = token >= 0
                if not is_token.any():
                    continue
                some, token = rows[is_token], token[is_token]
                if size < p:
                    ok = self._allowed(last[some, p - size] * n + token)
                    some, token = some[ok], token[ok]
                last[some, p] = token
                count[some, p] = count[some, p - size] + 1
                rows = rows[last[rows, p] < 0]
                if not len(rows):
                    break
            if len(rows):
                raise ValueError("the vocabulary lacks single bytes")
        # changes at the last byte of each character
        inside = np.arange(1, top + 1) <= sizes[:, None]
        flat = count[:, 1:][inside]
        joined = np.frombuffer(b"".join(raw) + b"a", np.uint8)
        ends = (joined[1:] & 192) != 128
        word = np.repeat(np.arange(len(raw)), sizes)[ends]
        at_char = flat[ends]
        changes = np.diff(at_char, prepend=0)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        changes[first] = at_char[first]
        buffer, cuts = changes.astype(np.int8).tobytes(), [*first.tolist(), len(word)]
        out = [b""] * len(words)
        for k, a, b in zip(order, cuts, cuts[1:]):
            out[k] = buffer[a:b]
        return out

    def _long_word(self, text: str) -> bytes:
        """The recurrence for one long run."""
        raw = text.encode()
        shown = "".join([self.shown[b] for b in raw])
        counts, tokens, pairs = [0], [""], {}
        for p in range(1, len(shown) + 1):
            for start in range(max(0, p - self.longest), p):
                t = shown[start:p]
                if t not in self.whole:
                    continue
                ok = not start or pairs.get((tokens[start], t))
                if ok is None:
                    ok = pairs[tokens[start], t] = self._neighbours(tokens[start], t)
                if ok:
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            counts.append(counts[start] + 1)
            tokens.append(t)
        by_char = np.array(counts[1:])[np.flatnonzero((np.frombuffer(raw[1:] + b"a", np.uint8) & 192) != 128)]
        return np.diff(by_char, prepend=0).astype(np.int8).tobytes()

    def _contraction(self, text: str) -> bytes:
        """Shorter prefixes of it are cut elsewhere by the pattern."""
        counts = [len(self.full.encode(text[:j], add_special_tokens=False).ids) for j in range(1, len(text) + 1)]
        return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])

    def _learn(self, words: set[str]) -> None:
        """Put the tables of words that are not known yet into the cache."""
        short = []
        for w in words:
            if w[0] == "'" and len(w) <= 3:
                self.words[w] = self._contraction(w)
            elif len(w) * 4 <= SHORT or len(w.encode()) <= SHORT:
                short.append(w)
            else:
                self.words[w] = self._long_word(w)
        if short:
            self.words.update(zip(short, self._short_words(short)))
        for w in words:
            if len(w) >= LONG_WORD:
                self.long[w] = self.words.pop(w)

    def _word(self, text: str) -> bytes:
        """Changes of the count at each character of a run without inner gaps."""
        got = self.words.get(text)
        if got is None:
            got = self.old_words.get(text)
            if got is not None:
                self.words[text] = got
            elif len(text) < LONG_WORD:
                self._learn({text})
                got = self.words[text]
            else:
                if text not in self.long:
                    self._learn({text})
                got = self.long[text]
        return got

    def _plain(self, text: str) -> bytes:
        """Changes at each character of a text without special tokens, itself a piece or part of one."""
        words = self.split.findall(text)
        out = self._word(text) if len(words) == 1 else b"".join(map(self._word, words))
        run = 0 if text[0] > " " and text[0] < "\x7f" else len(RUN.match(text)[0])
        if run > 1:  # white space at the end of a prefix stays in one run
            inside = np.frombuffer(self._word(text[:run]), np.int8)
            counts = np.cumsum(np.frombuffer(out, np.int8), dtype=np.int64)
            counts[:run] = np.cumsum(inside, dtype=np.int64)
            out = np.diff(counts, prepend=0).astype(np.int8).tobytes()
        return out

    def _piece(self, text: str) -> bytes:
        """Changes of the count at each character, as signed bytes."""
        if not (self.specials and self.special.search(text)):
            return self._plain(text) if text else b""
        counts, base, at = [], 0, 0
        for m in [*self.special.finditer(text), None]:
            end = m.start() if m else len(text)
            before = base  # tokens up to the end of the special string before; what follows it is cut on its own
            if end > at:
                counts.append(np.cumsum(np.frombuffer(self._plain(text[at:end]), np.int8), dtype=np.int64) + base)
                base = int(counts[-1][-1])
            if m:  # a prefix that ends inside the special string has its letters as ordinary text
                inside = [before + len(self.full.encode(text[at:p], add_special_tokens=False).ids) for p in range(m.start() + 1, m.end())]
                base += 1
                counts.append(np.array([*inside, base]))
                at = m.end()
        return np.diff(np.concatenate(counts), prepend=0).astype(np.int8).tobytes()

    def tables(self, pieces: list[str]) -> list[bytes]:
        """The changes of each piece, from the caches where they are known."""
        if len(self.words) > self.keep // 2:
            self.old_words, self.words = self.words, {}
        young, old, words, old_words = self.pieces, self.old_pieces, self.words, self.old_words
        out = list(map(young.get, pieces))
        needed: set[str] = set()
        for k, d in enumerate(out):
            if d is None and pieces[k] not in old:
                m = PLAIN(pieces[k])
                needed.update(m.groups() if m else self.split.findall(pieces[k]))
        needed.discard("")
        self._learn({w for w in needed if w not in words and w not in old_words})
        for k, d in enumerate(out):
            if d is None:
                w = pieces[k]
                d = old.get(w)
                if d is None:
                    m = PLAIN(w)
                    d = (self._word(m[1]) + (self._word(m[2]) if m[2] else b"")) if m else self._piece(w)
                out[k] = d
                if len(w) < LONG_WORD:
                    young[w] = d
        self.long.clear()
        if len(young) > self.keep:
            self.old_pieces, self.pieces = young, {}
        return out

    def deltas(self, text: str) -> bytes:
        """For each character of the text, by how much it changes the token count, as signed bytes."""
        return b"".join(self.tables(PIECE.findall(text)))


def count_at(deltas: bytes, chars: int) -> int:
    """Tokens of the first `chars` characters."""
    return int(np.frombuffer(deltas, np.int8)[: max(0, chars)].sum(dtype=np.int64))


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens."""
    counts = np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def counter(path: str) -> PrefixCounter:
    """One counter for each worker process, so tables outlive a task."""
    gc.set_threshold(200_000, 50, 50)  # the tables hold many small objects, none of them in cycles
    return held(("counter", path), lambda: PrefixCounter(path))


#: Places where a text is not cut by the quick way: two white-space characters in a row, or unusual ones.
ODD = f"[ \n][ \n]|[\x00{''.join(c for c in SPACE if c not in ' \n')}]"


def pieces_of(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of texts, the piece numbers of all texts in a row, and how many each text has."""
    odd = pc.match_substring_regex(text, ODD)
    marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), pc.replace_substring(text, "\n", " \n"), pa.scalar("", pa.large_string()))
    parts = pc.split_pattern(pc.if_else(odd, pa.scalar("\0", pa.large_string()), marked), " ")
    coded = parts.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    # the first piece of a text has nothing before it, one that begins a line has its line end, others a space
    pieces = [w[1:] if w[:1] == "\0" else w if w[:1] == "\n" else " " + w for w in names]
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(rows):
        own = [PIECE.findall(t) for t in text.take(pa.array(rows)).to_pylist()]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(w, len(pieces) + len(number)) for ws in own for w in ws], np.int64)
        pieces += list(number)
        # the single marker of an odd text makes way for its pieces
        lengths = sizes.copy()
        lengths[rows] = [len(ws) for ws in own]
        out = np.empty(int(lengths.sum()), np.int64)
        from_odd = np.repeat(np.isin(np.arange(len(sizes)), rows), lengths)
        out[from_odd] = flat
        out[~from_odd] = which[~np.repeat(np.isin(np.arange(len(sizes)), rows), sizes)]
        which, sizes = out, lengths
    return pieces, which, sizes


def counted(table: PrefixCounter, text: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and the characters of its longest prefix with at most `limit` tokens, both from
    the prefix tables of its pieces."""
    pieces, which, sizes = pieces_of(text)
    tables = table.tables(pieces)
    inner = np.frombuffer(b"".join(tables), np.int8).astype(np.int32)
    lengths = np.fromiter(map(len, tables), np.int64, len(tables))
    ends = np.cumsum(lengths)
    sums = np.concatenate([[0], np.cumsum(inner, dtype=np.int64)])
    totals = sums[ends] - sums[ends - lengths]
    lowest = np.zeros(len(tables), np.int64)  # the least count that a non-empty prefix of a piece has
    full = np.flatnonzero(lengths)
    if len(full):
        lowest[full] = np.minimum.reduceat(sums[1:], (ends - lengths)[full]) - sums[(ends - lengths)[full]]
    running = np.concatenate([[0], np.cumsum(totals[which])])
    chars = np.concatenate([[0], np.cumsum(lengths[which])])
    last = np.cumsum(sizes)
    n = running[last] - running[last - sizes]
    cut = chars[last] - chars[last - sizes]
    for k in np.flatnonzero(n > limit).tolist():
        a, b = int(last[k] - sizes[k]), int(last[k])
        before = running[a:b] - running[a]
        fits = np.flatnonzero((before + lowest[which[a:b]] <= limit) & (lengths[which[a:b]] > 0))
        if not len(fits):
            cut[k] = 0
            continue
        at = a + int(fits[-1])
        cut[k] = chars[at] - chars[a] + longest_within(tables[which[at]], limit - int(running[at] - running[a]))
    return n, cut


def prefix_token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, keep_tables: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_chars (the longest prefix within the limit) and, if
    asked for, prefix_deltas (for count_at and longest_within). Narrow: no shuffle."""
    tail = ", prefix_deltas binary" if keep_tables else ""

    def make():
        table = counter(tokenizer)

        def f(batch):
            for part in slices(batch, 16 << 20):
                text = filled_text(part)
                n, cut = counted(table, text, limit)
                cols = [part.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit), pa.array(cut)]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"]
                if keep_tables:
                    cols, names = [*cols, pa.array([table.deltas(t) for t in text.to_pylist()], pa.binary())], [*names, "prefix_deltas"]
                yield pa.RecordBatch.from_arrays(cols, names)

        return f

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long" + tail)
