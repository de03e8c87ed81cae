"""The registered queries of this subpackage, with production parameters, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.llm.common import table

#: Where the vocabulary files are; a parameter, None takes the installed package's.
TOKENIZER_PATH: Callable[[str], str] | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZER_PATH:
        return TOKENIZER_PATH(name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.token_counts import prefix_token_counts

    return prefix_token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.quality_fm import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.token_ids import token_ids

    return token_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.set_sketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_key", "component_key")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.cuckoo import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.sanitise import digests, personal_data

    return digests(personal_data(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.wu_manber import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13, share=20).drop("text_key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from docweave.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), anchors=F.col("vec_id") % 100 == 0, label=moved)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, length=2048)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.periodic_runs import digests, periodic_runs, with_planted_runs

    return digests(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from docweave.llm import sql

    return sql.oracle_sql()
