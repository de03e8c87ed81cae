"""Decisions applied to a service, each once, from a stream that may be replayed.

A batch goes through three tables in a log folder, each written by a committed Spark job under the batch's number:

  intents/epoch=N    the decisions that batch N is to apply: distinct, and not applied by an earlier batch
  outcomes/epoch=N   what came of them

A batch that is replayed after a fault finds its intents fixed, so it applies the same ones; if its outcomes are
there it does nothing. What was begun and not noted is decided by the service: a change is looked up before it is made and
after it failed, and a merge names the commit that it expects, so the service itself refuses a second one. A failed
change is an outcome of its own; it is tried again when a later batch decides it again.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.sources.listings import Service, ServiceError

KEY = ["repository", "number", "head_sha", "action"]
INTENT = "repository string, number long, head_sha string, action string"
OUTCOME = f"{INTENT}, done boolean, result string, reason string, error string"
# What is written for each way that a change ends.
MERGED, CLOSED = "squash merge completed at expected head SHA", "conflict detected"
FAILED = {"merge": "merge request failed", "close": "close request failed"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a committed job has written the folder."""
    return _exists(spark, f"{path}/_SUCCESS")


def outcomes(spark: SparkSession, log: str) -> DataFrame:
    """All outcomes of a log with their epoch; of an epoch whose writer did not end, none."""
    root = f"{log}/outcomes"
    if not _exists(spark, root):
        return spark.createDataFrame([], f"{OUTCOME}, epoch long")
    return spark.read.schema(f"{OUTCOME}, epoch long").option("basePath", root).parquet(root)


def apply_batch(batch: DataFrame, epoch: int, log: str, effect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The outcomes of one batch of decisions (KEY). effect: intents -> OUTCOME, run where the rows are."""
    spark = batch.sparkSession
    begun, ended = f"{log}/intents/epoch={epoch}", f"{log}/outcomes/epoch={epoch}"
    if not whole(spark, ended):
        if not whole(spark, begun):
            wanted = batch.filter(F.col("action").isin(*FAILED)).select(*KEY).distinct()
            past = outcomes(spark, log).filter(F.col("done") & (F.col("epoch") != epoch)).select(*(F.col(k).alias(f"past_{k}") for k in KEY))
            same = [F.col(k).eqNullSafe(F.col(f"past_{k}")) for k in KEY]
            wanted.join(past, same, "left_anti").write.mode("overwrite").parquet(begun)
        effect(spark.read.schema(INTENT).parquet(begun)).write.mode("overwrite").parquet(ended)
    return spark.read.schema(OUTCOME).parquet(ended)


def exactly_once(decisions: DataFrame, log: str, effect: Callable[[DataFrame], DataFrame], checkpoint: str, trigger: dict | None = None, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """A stream of decisions applied batch by batch; `after` is called when a batch's outcomes are written and
    before the stream notes the batch as done."""

    def step(batch: DataFrame, epoch: int) -> None:
        apply_batch(batch, epoch, log, effect)
        if after:
            after(epoch)

    return decisions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# --- the service's changes ------------------------------------------------------------------------


def merge_request(service: Service, repository: str, number: int, sha: str) -> None:
    """Squash-merges at the commit expected; an answer that does not confirm it is an error."""
    said = service.request("PUT", f"/repos/{repository}/pulls/{number}/merge", {"merge_method": "squash", "sha": sha}) or {}
    if not said.get("merged"):
        raise ServiceError(f"merge of PR #{number} was not confirmed: {said.get('message') or 'merged=false'}")


def close_request(service: Service, repository: str, number: int) -> None:
    service.request("PATCH", f"/repos/{repository}/pulls/{number}", {"state": "closed"})


def create_request(service: Service, repository: str, title: str, body: str, head: str, base: str) -> None:
    service.request("POST", f"/repos/{repository}/pulls", {"title": title, "body": body, "head": head, "base": base})


def made_already(service: Service, repository: str, number: int, sha: str | None, action: str) -> bool:
    """Whether the change stands: merged with the expected head, or closed without a merge."""
    now = service.request("GET", f"/repos/{repository}/pulls/{number}") or {}
    merged = bool(now.get("merged"))
    return merged and (now.get("head") or {}).get("sha") == sha if action == "merge" else now.get("state") == "closed" and not merged


def changed(service: Service, repository: str, number: int, sha: str | None, action: str) -> tuple:
    """done, result, reason, error of one change."""
    try:
        if not made_already(service, repository, number, sha, action):
            try:
                if action == "merge":
                    merge_request(service, repository, number, sha or "")
                else:
                    close_request(service, repository, number)
            except ServiceError:  # it may have been made all the same, by another attempt or before an answer was lost
                if not made_already(service, repository, number, sha, action):
                    raise
    except ServiceError as e:
        return False, "skip", FAILED[action], f"PR #{number}: {action} failed: {e}"
    return True, action, MERGED if action == "merge" else CLOSED, None


def through(service: Service) -> Callable[[DataFrame], DataFrame]:
    """The effect that sends intents to a service, in the tasks that hold them."""

    def effect(intents: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                keys = list(zip(*(batch.column(k).to_pylist() for k in KEY)))
                rows = [(*k, *changed(service, *k)) for k in keys]
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], [*KEY, "done", "result", "reason", "error"])

        return intents.mapInArrow(run, OUTCOME)

    return effect
