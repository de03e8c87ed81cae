"""Citations, prompt budgets and the answer's status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text

MAX_CHUNKS, MAX_CHARS, EXCERPT = 8, 6000, 160


def citation_keys(hits: DataFrame, by: str = "question_id", order: str = "rank") -> DataFrame:
    """Hits with their key, the place in arrival order as text, at most 999."""
    w = Window.partitionBy(by).orderBy(order)
    return hits.withColumn("key", F.least(F.row_number().over(w), F.lit(999)).cast("string"))


def cited(answer: Column) -> Column:
    """keys of [n] marks in the order of their first use; [1] and [01] are two keys."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[\s*([0-9]+)\s*\]"), F.lit(1)))


def verify(answers: DataFrame, n_sources: Column) -> DataFrame:
    """Verified and dropped keys of answers; a key is verified if its number is one of the sources'."""
    number = lambda k: F.try_to_number(k, F.lit("9" * 18))
    known = lambda k: F.coalesce(number(k).between(1, n_sources), F.lit(False))
    keys = cited(F.col("answer"))
    return answers.withColumn("verified", F.filter(keys, known)).withColumn("dropped", F.filter(keys, lambda k: ~known(k)))


def source_cards(verified: DataFrame, keyed_hits: DataFrame) -> DataFrame:
    """The sources of verified keys in key order: question_id, nth, key, id."""
    keys = verified.select("question_id", F.posexplode("verified").alias("nth", "cited_key")).withColumn("key", F.col("cited_key").cast("bigint").cast("string"))
    return keys.join(keyed_hits, ["question_id", "key"]).select("question_id", "nth", F.col("cited_key").alias("key"), "id")


def prompt_blocks(hits: DataFrame, max_chunks: int = MAX_CHUNKS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Framed excerpts of the first chunks of each question, the one that crosses the budget (in bytes, the
    frame with its key counted) cut, later ones gone. hits: question_id, rank, text, key (optional, the rank)."""
    max_chunks, max_chars = max_chunks if max_chunks > 0 else MAX_CHUNKS, max_chars if max_chars > 0 else MAX_CHARS
    key = F.col("key") if "key" in hits.columns else F.col("rank").cast("string")
    frame = F.concat(F.lit("\n["), key, F.lit("]\n"), text.excerpt(F.col("text"), EXCERPT), F.lit("\n"))
    blocks = hits.filter(F.col("rank") <= max_chunks).withColumn("block", frame)
    before = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("used", F.coalesce(F.sum(F.octet_length("block")).over(before), F.lit(0)))
    left = F.lit(max_chars) - F.col("used")
    return blocks.filter(left > 0).withColumn("kept_bytes", F.least(F.octet_length("block"), left)).withColumn("block", F.when(F.octet_length("block") <= left, F.col("block")).otherwise(F.expr(f"cast(substring(cast(block as binary), 1, cast({max_chars} - used as int)) as string)")))


#: What a model is told before the sources; own wording.
RULES = "Answer from the numbered sources below and from nothing else. Cite each fact by its key, as in [1], and use no other keys. If the sources do not answer the question, say that there is not enough information. Answer in a few sentences."


def prompt(hits: DataFrame, questions: DataFrame, max_chunks: int = MAX_CHUNKS, max_chars: int = MAX_CHARS) -> DataFrame:
    """one prompt for each question: rules, the map of keys (title or id, heading), the blocks within the
    budget, the question. hits: question_id, rank, text, id, title, heading; questions: question_id, question."""
    max_chunks = max_chunks if max_chunks > 0 else MAX_CHUNKS
    hits = citation_keys(hits).filter(F.col("rank") <= max_chunks)
    named = F.concat(F.lit("  ["), "key", F.lit("] "), F.when(F.col("title") != "", F.col("title")).otherwise(F.col("id")), F.lit(" — "), "heading", F.lit("\n"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("line")))), lambda x: x["line"]), "")
    keys = hits.groupBy("question_id").agg(joined(named).alias("keys"))
    blocks = prompt_blocks(hits, max_chunks, max_chars).groupBy("question_id").agg(joined(F.col("block")).alias("blocks"))
    out = questions.join(keys, "question_id", "left").join(blocks, "question_id", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select("question_id", F.concat(F.lit(f"{RULES}\n\nCitation key map:\n"), some("keys"), F.lit("\nSource material:\n"), some("blocks"), F.lit("\nQuestion: "), F.trim("question"), F.lit("\nAnswer:")).alias("prompt"))


def status(question: Column, hits: Column, answer: Column, verified: Column) -> Column:
    """What becomes of a question."""
    return (
        F.when(F.trim(F.coalesce(question, F.lit(""))) == "", "error")
        .when(F.coalesce(hits, F.lit(0)) == 0, "no_answer")
        .when((F.size(verified) <= 0) & ~text.refuses(answer), "no_answer")
        .otherwise("answered")
    )


class FakeProvider:
    """A deterministic stand-in for a language model (its modes: cite, miss, empty, anything else echoes)."""

    def __init__(self, mode: str = ""):
        self.complete: Callable[[Column], Column] = {
            "cite": lambda q: F.lit("The sources say so [1]."),
            "miss": lambda q: F.lit("The sources say so [99]."),
            "empty": lambda q: F.lit(""),
        }.get(mode, lambda q: F.concat(F.lit("echo: "), q))


def answers(questions: DataFrame, docs: DataFrame, provider: FakeProvider, k: int = MAX_CHUNKS) -> DataFrame:
    """Retrieval, generation, verification and status of a table of questions (question_id, question)."""
    from docweave.operators.retrieval import rank_batch

    hits = rank_batch(docs, questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("query")), k)
    counts = hits.groupBy(F.col("query_id").alias("question_id")).agg(F.count("*").alias("hits"))
    out = questions.join(counts, "question_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    out = verify(out.withColumn("answer", provider.complete(F.col("question"))), F.col("hits"))
    return out.withColumn("status", status(F.col("question"), F.col("hits"), F.col("answer"), F.col("verified")))
