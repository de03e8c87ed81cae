"""Sparse text features shared by the two classifiers, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import stored

#: Bytes of features that a fit gathers on the driver.
SAMPLE_BYTES = 256 << 20


def distinct_words(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words (runs without ASCII white space) of a batch, and of each (row, word) that occurs
    the row, the word's number and how often it occurs; sorted by row."""
    words = pc.ascii_split_whitespace(text)
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    per_row = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    key = np.repeat(np.arange(len(text)), per_row) * max(1, len(names)) + which
    key, n = np.unique(key, return_counts=True)
    row, word = np.divmod(key, max(1, len(names)))
    return names, row, word, n


def row_sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of values (one or several columns) by row."""
    if values.ndim == 1:
        return np.bincount(row, weights=values, minlength=rows)
    return np.stack([np.bincount(row, weights=values[:, k], minlength=rows) for k in range(values.shape[1])], axis=1)


def labelled_sample(labels: DataFrame, column: str, allowed: Column | None, rows: int, by_class: bool) -> DataFrame:
    """At most `rows` ids with their label (the largest if an id has several), picked by a hash of the id;
    with by_class at most as many of either label. This bound is the only thing that limits training."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if allowed is not None:
        known = known.filter(allowed)
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    if not by_class:
        return known.orderBy(order).limit(rows)
    return known.filter("label > 0").orderBy(order).limit(rows).unionByName(known.filter("label <= 0").orderBy(order).limit(rows))


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, label of the sampled ids, one row for each: of rows that repeat an id the one whose text has the
    smallest key. The sample is bounded, so it may be broadcast; repeated rows are left out before the shuffle."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label"))


def bounded(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of a sample, in the order of its hashes, whose binary column adds up to `most` bytes."""
    rows = stored(rows, "sample-features")
    order = Window.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # a bounded sample
    sums = rows.select("doc_id", F.sum(F.length(column)).over(order).alias("upto")).filter(F.col("upto") <= most)
    return rows.join(F.broadcast(sums.select("doc_id")), "doc_id")
