"""Quality scores by a factorisation machine.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): all pairwise
interactions between features at a cost linear in their number. Features are hashed words, binned
structure statistics of the text (shares of byte classes, repeated lines, word lengths) and its length.
Labels, languages, sources and ids are never features.

The model is fitted on a sample of labelled rows whose size is a parameter; scoring is a narrow map over
whole texts. Defined results: null counts as empty; an empty text is scored from its structure alone;
without labelled rows all scores are 0.5.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import arrow_map, filled_text, slices
from docweave.llm.features import SAMPLE_BYTES, bounded, distinct_words, labelled_sample, row_sums, texts_of

WORD_BITS, RANK, BINS = 17, 8, 24

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".", b",;:", b"!?", b"|\t", b"%*$&#@^~=+_", b"()[]{}<>/\\", b"\"'`-"]
CLASSES = np.full(256, len(_GROUPS), np.uint8)
for _k, _g in enumerate(_GROUPS):
    CLASSES[list(_g)] = _k
CLASSES[128:] = 0  # letters of other alphabets count as small letters
N_CLASSES = len(_GROUPS) + 1
N_STATS = N_CLASSES + 6


def structure(text: pa.Array) -> np.ndarray:
    """One bin for each statistic of each text."""
    out = np.zeros((len(text), N_STATS), np.int64)
    for k, t in enumerate(text.to_pylist()):
        raw = t.encode()
        n = max(1, len(raw))
        shares = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES) / n
        lines = t.split("\n")
        gaps = t.count(" ") + len(lines)
        joined = t.count(". ") + t.count(".\n") + 1
        extra = [1 - len(set(lines)) / len(lines), len(raw) / gaps / 40, gaps / len(lines) / 80, joined / gaps * 4, max(map(len, lines)) / n, np.log2(n) / 24]
        share_bins = np.ceil(np.sqrt(shares) * (BINS - 1))
        out[k, :N_CLASSES] = share_bins
        out[k, N_CLASSES:] = np.ceil(np.clip(extra, 0, 1) * (BINS - 1))
    return np.clip(out, 0, BINS - 1) + np.arange(N_STATS) * BINS + (1 << WORD_BITS)


SIZE = (1 << WORD_BITS) + N_STATS * BINS


def word_slots(names: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.lower().encode()) & ((1 << WORD_BITS) - 1) for w in names), np.int64, len(names))


@dataclass
class Machine:
    w0: float
    w: np.ndarray  # SIZE
    v: np.ndarray  # SIZE x RANK

    def scores(self, text: pa.Array) -> np.ndarray:
        rows = len(text)
        names, row, word, _ = distinct_words(text)
        slot = word_slots(names)[word]
        value = (0.5 / np.sqrt(np.maximum(1, np.bincount(row, minlength=rows))))[row]
        bins = structure(text)
        linear = self.w0 + row_sums(row, self.w[slot] * value, rows) + self.w[bins].sum(1)
        total, squares = self.v[bins].sum(1), (self.v[bins] ** 2).sum((1, 2))
        for f in range(self.v.shape[1]):
            x = self.v[slot, f] * value
            total[:, f] += np.bincount(row, weights=x, minlength=rows)
            squares += np.bincount(row, weights=x * x, minlength=rows)
        return linear + 0.5 * ((total**2).sum(1) - squares)


def probabilities(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sparse_rows(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    names, row, word, _ = distinct_words(text)
    slot, bins = word_slots(names), structure(text)
    cuts = np.searchsorted(row, np.arange(len(text) + 1))
    out = []
    for k in range(len(text)):
        s = slot[word[cuts[k] : cuts[k + 1]]]
        x = np.concatenate([np.full(len(s), 0.5 / np.sqrt(max(1, len(s)))), np.ones(N_STATS)])
        out.append((np.concatenate([s, bins[k]]), x))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 0.08, shrink: float = 2e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, in small batches."""
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.03, (SIZE, RANK)))
    g0, gw, gv = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6)
    for _ in range(epochs if len(labels) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            pick = order[at : at + 64]
            idx = np.concatenate([rows[k][0] for k in pick])
            x = np.concatenate([rows[k][1] for k in pick])
            row = np.repeat(np.arange(len(pick)), [len(rows[k][0]) for k in pick])
            vx = m.v[idx] * x[:, None]
            total = row_sums(row, vx, len(pick))
            z = m.w0 + row_sums(row, m.w[idx] * x, len(pick)) + 0.5 * ((total**2).sum(1) - row_sums(row, (vx**2).sum(1), len(pick)))
            error = (probabilities(z) - labels[pick]) / len(pick)
            e = error[row] * x
            slots, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, weights=e, minlength=len(slots)) + shrink * m.w[slots]
            dv = row_sums(back, e[:, None] * (total[row] - vx), len(slots)) + shrink * m.v[slots]
            d0 = error.sum()
            g0 += d0 * d0
            gw[slots] += dw**2
            gv[slots] += dv**2
            m.w0 -= rate * d0 / np.sqrt(g0)
            m.w[slots] -= rate * dw / np.sqrt(gw[slots])
            m.v[slots] -= rate * 0.3 * dv / np.sqrt(gv[slots])
    return m


def training_rows(chosen: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features, made on the executors, of a bounded sample; in the order of doc_id, so fits agree."""

    def make():
        def f(batch):
            for part in slices(batch, 4 << 20):
                rows = sparse_rows(filled_text(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary())], ["doc_id", "label", "slots"])

        return f

    got = bounded(arrow_map(chosen, make, "doc_id long, label int, slots binary"), "slots", SAMPLE_BYTES).toArrow().sort_by("doc_id")
    rows = []
    for b in got["slots"].to_pylist():
        idx = np.frombuffer(b, "<i4")
        n = len(idx) - N_STATS
        rows.append((idx, np.concatenate([np.full(n, 0.5 / np.sqrt(max(1, n)), np.float32), np.ones(N_STATS, np.float32)])))
    return rows, got["label"].to_numpy().astype(np.float64)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> Machine:
    """The machine of at most sample_rows labelled rows that are not held out, with the precision it is sent in."""
    sample = labelled_sample(labels, "quality", ~held_out(), sample_rows, by_class=False)
    rows, marks = training_rows(texts_of(docs, sample))
    model = fit(rows, np.minimum(marks, 1))
    return Machine(model.w0, model.w.astype(np.float32), model.v.astype(np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. sample_rows bounds the labelled rows for the fit, SAMPLE_BYTES their
    features; ids that repeat count once."""
    return scored_texts(docs, fitted(docs, labels, sample_rows), threshold)


def scored_texts(docs: DataFrame, model: Machine, threshold: float = 0.3) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))

    def make():
        machine = Machine(*sent.value)

        def f(batch):
            for part in slices(batch, 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(probabilities(machine.scores(filled_text(part))), pa.float64())], ["doc_id", "score"])

        return f

    scored = arrow_map(docs.select("doc_id", "text"), make, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
