"""A corpus from raw documents: toxicity, near duplicates, contamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents and act on their decisions:

  toxicity       documents judged toxic go
  near_dedup     one document of each near-duplicate class stays: of those with the smallest id the one whose
                 text has the smallest key, and one row of those that repeat both (rows without an id or
                 without words are in no class)
  decontaminate  documents contaminated by the benchmark go
  mix            documents are repeated or left out as the mix to target weights has them
  tokens         token ids are written in ascending doc_id order and read back

Toxicity and decontamination are decided text by text in the pass that filters. Other decisions are joined by id
and text, so rows that repeat an id are told apart; null ids are matched too.
Extra columns of documents are kept by the filters as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import scratch_path, small, stored, table, trim
from docweave.llm.mixing import mixed
from docweave.llm.queries import tokenizer_path
from docweave.llm.set_sketch import near_duplicates
from docweave.llm.token_ids import token_ids
from docweave.llm.toxicity import fitted, kept_texts
from docweave.llm.wu_manber import uncontaminated


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for those whose doc_id and text are in dropped; few are broadcast, many joined by shuffle."""
    gone = stored(dropped.select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_key")).distinct(), "dropped")
    same: Column = F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.col("__row_key") == F.col("__gone_key"))
    return docs.withColumn("__row_key", F.xxhash64("text")).join(small(gone), same, "left_anti").drop("__row_key")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fitted(docs, table(spark, sf_dir, "labels"))
    trim()  # what the fit took is not held while the other stages run
    return kept_texts(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marks = near_duplicates(docs)
    rest = marks.filter("kept AND component_key IS NOT NULL").groupBy("component_key").agg(F.count("*").alias("n"), F.min("text_key").alias("first"), F.min("doc_id").alias("doc_id")).filter("n > 1")
    several = stored(rest.select("component_key", "doc_id", "first"), "several")
    if several.isEmpty():
        return _without(docs, marks.filter("NOT kept"))
    firsts = small(several.select("component_key", "first"))
    left = _without(docs, marks.join(firsts, "component_key", "left").filter("NOT kept OR text_key <> first"))
    return _once(left, several.select("doc_id", F.col("first").alias("key")))


def _once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with one row for each (doc_id, key of its text) of keys; few are broadcast, many joined by shuffle."""
    named = small(keys.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")))
    same: Column = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row_key") == F.col("__key"))
    rows = docs.withColumn("__row_key", F.xxhash64("text"))
    one = rows.join(named, same, "left_semi").dropDuplicates(["doc_id", "__row_key"])
    return rows.join(named, same, "left_anti").unionByName(one).drop("__row_key")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated in place: the number of copies is joined on, one range element for each. Of rows that
    repeat id and text one has the copies of all."""
    chosen = mixed(docs).groupBy("doc_id", F.col("text_key").alias("key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    chosen = stored(chosen.filter("copies > 0"), "copies")
    several = chosen.filter("n > 1")
    if not several.isEmpty():
        docs = _once(docs, several)
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("copies").alias("__copies"))
    same: Column = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row_key") == F.col("__key"))
    joined = docs.withColumn("__row_key", F.xxhash64("text")).join(small(chosen), same)
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: The classifier and the sketches have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
