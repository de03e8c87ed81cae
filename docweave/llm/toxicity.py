"""Toxicity grades by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds t_0 < t_1 < ...; the output is
the expected severity, the sum of these chances. Weights and thresholds are fitted together: they maximise
the sum of log(P(grade > y-1) - P(grade > y)) over the training rows less an L1 penalty on the weights, so
most weights are zero and long texts gather no noise. Features are hashed words and word beginnings of 4 to
7 letters, each counted once for a distinct word of the text.

If labels have grades above 1 they are the grades. Labels of 0 and 1 are graded by a stated rule: a feature
is telling if its share among the toxic training rows is TELLING times that among the others or more; a
toxic row has grade 1, 2 or 3 as it holds fewer than GRADES[0], fewer than GRADES[1] or more different words
with a telling feature. Fitted on a bounded sample (a parameter) whose rows weigh as much as the rows they
stand for; scoring is a narrow map over whole texts.

Defined results: null and empty texts have no features and the lowest severity the thresholds give;
without toxic labels nothing is rejected; rows that repeat an id or a text are scored alike.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import arrow_map, filled_text, slices
from docweave.llm.features import SAMPLE_BYTES, bounded, distinct_words, labelled_sample, texts_of

BITS = 20
LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
TELLING, GRADES = 20, (3, 6)
#: Marks the slot of a whole word among those of its beginnings in training rows.
WHOLE = 1 << BITS


def slots_of(word: str, mark: int = 0) -> list[int]:
    """Hashed features of the letter runs of one white-space separated word; `mark` is added to whole runs."""
    out = []
    for run in LETTERS.findall(word.lower()):
        out.append((zlib.crc32(run.encode()) & ((1 << BITS) - 1)) + mark)
        out += [zlib.crc32(f"^{run[:n]}".encode()) & ((1 << BITS) - 1) for n in BEGINNINGS if len(run) > n]
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def scores(self, text: pa.Array) -> np.ndarray:
        names, row, word, _ = distinct_words(text)
        known, w = self.known, self.weights
        if len(known) > 150_000:
            known.clear()
        for name in names:
            if name not in known:
                known[name] = float(sum(w[s] for s in slots_of(name)))
        each = np.fromiter((known[n] for n in names), np.float64, len(names))
        return np.bincount(row, weights=each[word], minlength=len(text)) if len(names) else np.zeros(len(text))

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return sigmoid(scores[:, None] - self.thresholds)


def loss_slopes(z: np.ndarray, grades: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row -log P(its grade), its derivative by z, and its derivatives by the thresholds."""
    over = sigmoid(z[:, None] - t)
    at = np.arange(len(z))
    above = np.concatenate([np.ones((len(z), 1)), over], 1)[at, grades]  # P(grade > y - 1)
    below = np.concatenate([over, np.zeros((len(z), 1))], 1)[at, grades]  # P(grade > y)
    p = np.maximum(above - below, 1e-12)
    slopes = np.zeros((len(z), len(t) + 2))  # a column too many at either end
    slopes[at, grades] = above * (1 - above) / p
    slopes[at, grades + 1] = -below * (1 - below) / p
    return -np.log(p), above + below - 1, slopes[:, 1:-1]


def fit(rows: list[np.ndarray], grades: np.ndarray, weights: np.ndarray, epochs: int = 12, rate: float = 0.3, penalty: float = 1e-3, seed: int = 5, gap: float = 1e-2) -> Ordinal:
    """The penalised likelihood of all thresholds and weights together, by AdaGrad with soft thresholding.
    rows hold slots, repeated as often as distinct words have them; thresholds stay `gap` apart or more."""
    top = max(1, int(grades.max(initial=1)))
    rng = np.random.default_rng(seed)
    w, t = np.zeros(1 << BITS), np.linspace(1, 1 + (top - 1) * 1.5, top)
    gw, gt = np.full(1 << BITS, 1e-3), np.full(top, 1e-1)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            pick = order[at : at + 64]
            idx = np.concatenate([rows[k] for k in pick])
            row = np.repeat(np.arange(len(pick)), [len(rows[k]) for k in pick])
            z = np.bincount(row, weights=w[idx], minlength=len(pick))
            _, by_z, by_t = loss_slopes(z, grades[pick], t)
            by_z, by_t = by_z * weights[pick] / len(pick), by_t * weights[pick, None] / len(pick)
            slots, back = np.unique(idx, return_inverse=True)
            d = np.bincount(back, weights=by_z[row], minlength=len(slots))
            gw[slots] += d * d
            step = rate / np.sqrt(gw[slots])
            moved = w[slots] - step * d
            w[slots] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * penalty)
            dt = by_t.sum(0)
            gt += dt * dt
            t = t - rate * dt / np.sqrt(gt)
            t = np.maximum.accumulate(t - gap * np.arange(top)) + gap * np.arange(top)
    return Ordinal(w, t)


def supported(rows: list[np.ndarray], least: int = 6) -> list[np.ndarray]:
    """Rows without features that fewer than `least` of them have."""
    if not rows:
        return rows
    n = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=1 << BITS)
    return [r[n[r] >= min(least, 1 + len(rows) // 50)] for r in rows]


def graded(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 of training rows (slots with WHOLE marks) with labels of 0 and 1."""
    slots = [r & (WHOLE - 1) for r in rows]
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    in_rows = lambda keep: np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(s) for s, k in zip(slots, keep) if k)]).astype(np.int64), minlength=1 << BITS)
    hit, miss = in_rows(toxic), in_rows(~toxic)
    telling = (hit >= min(8, 1 + n_toxic // 20)) & (hit * max(1, n_clean) >= TELLING * miss * n_toxic)
    grades = np.zeros(len(rows), np.int64)
    for k in np.flatnonzero(toxic):
        starts = np.flatnonzero(rows[k] & WHOLE)
        n = 0
        if len(starts):
            words = np.logical_or.reduceat(telling[slots[k]], starts)
            n = len(np.unique(slots[k][starts][words]))
        grades[k] = 1 + sum(n >= g for g in GRADES)
    return grades


def training_rows(chosen: DataFrame):
    def make():
        def f(batch):
            for part in slices(batch, 4 << 20):
                text = filled_text(part)
                names, row, word, _ = distinct_words(text)
                each = [np.array(slots_of(n, WHOLE), "<i4") for n in names]
                cuts = np.searchsorted(row, np.arange(len(text) + 1))
                slots = [np.concatenate([np.zeros(0, "<i4"), *(each[k] for k in word[a:b])]).tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(slots, pa.binary())], ["doc_id", "label", "slots"])

        return f

    got = bounded(arrow_map(chosen, make, "doc_id long, label int, slots binary"), "slots", SAMPLE_BYTES).toArrow().sort_by("doc_id")
    return [np.frombuffer(b, "<i4") for b in got["slots"].to_pylist()], got["label"].to_numpy().astype(np.int64)


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = 4_000) -> Ordinal:
    """The model of the labelled documents; sample_rows bounds the rows of either label."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    all_rows = {r["hit"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).alias("hit")).agg(F.count("*").alias("n")).collect()}
    rows, marks = training_rows(texts_of(docs, labelled_sample(labels, "toxic", None, sample_rows, by_class=True)))
    toxic = marks > 0
    if not toxic.any():
        return Ordinal(np.zeros(1 << BITS), np.array([30.0]))
    stands_for = np.array([all_rows[bool(m)] / max(1, (toxic == m).sum()) for m in (False, True)] if (~toxic).any() else [1.0, 1.0])
    weights = stands_for[toxic.astype(int)]
    grades = marks if marks.max() > 1 else graded(rows, toxic)
    return fit(supported([r & (WHOLE - 1) for r in rows]), np.maximum(grades, 0), weights / weights.mean())


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 4_000, reject_at: float = 0.5) -> DataFrame:
    """doc_id, text_key, severity (expected grade), grade (likeliest), toxic (P(grade > 0) >= reject_at) for every
    row; text_key tells rows with one id apart. sample_rows bounds the labelled rows of either label for
    the fit, SAMPLE_BYTES their features; ids that repeat count once."""
    return graded_texts(docs, fitted(docs, labels, sample_rows), reject_at)


def _sent(docs: DataFrame, model: Ordinal):
    """The model as executors take it up: only weights that are not zero travel."""
    used = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))

    def take() -> Ordinal:
        at, values, thresholds = sent.value
        w = np.zeros(1 << BITS)
        w[at] = values
        return Ordinal(w, thresholds)

    return take


def graded_texts(docs: DataFrame, model: Ordinal, reject_at: float = 0.5) -> DataFrame:
    take = _sent(docs, model)

    def make():
        model = take()

        def f(batch):
            for part in slices(batch, 4 << 20):
                over = model.chances(model.scores(filled_text(part)))
                each = np.concatenate([np.ones((len(over), 1)), over], 1) - np.concatenate([over, np.zeros((len(over), 1))], 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(over.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(over[:, 0] >= reject_at)], ["doc_id", "text_key", "severity", "grade", "toxic"])

        return f

    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), make, "doc_id long, text_key long, severity double, grade int, toxic boolean")


def kept_texts(docs: DataFrame, model: Ordinal, reject_at: float = 0.5) -> DataFrame:
    """docs, with all their columns, without the rows that graded_texts() calls toxic; one pass, no join."""
    take = _sent(docs, model)

    def make():
        model = take()

        def f(batch):
            for part in slices(batch, 4 << 20):
                yield part.filter(pa.array(model.chances(model.scores(filled_text(part)))[:, 0] < reject_at))

        return f

    return arrow_map(docs, make, docs.schema)
