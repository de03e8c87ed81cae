"""Decisions on change requests, and roll-ups of their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Policy:
    authors: list[str] = field(default_factory=list)
    base: str = "main"
    label: str = "automerge"
    prefixes: list[str] = field(default_factory=list)
    close_conflicts: bool = False
    allow_no_checks: bool = False
    apply: bool = False


def among(value: Column, allowed: list[str]) -> Column:
    return F.lower(value).isin([a.lower() for a in allowed]) if allowed else F.lit(False)


def decide(pr: DataFrame, policy: Policy) -> DataFrame:
    """Action and reason by the first gate that fails. pr: author, base_ref, draft, labels, head_ref,
    mergeable (nullable), check_state."""
    says = lambda action, *reason: F.struct(F.lit(action).alias("action"), F.concat(*reason).alias("reason"))
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    labelled = F.exists("labels", lambda x: F.lower(x) == policy.label.lower())
    prefixed = F.lit(not policy.prefixes)
    for p in policy.prefixes:
        prefixed = prefixed | F.col("head_ref").startswith(p)
    conflict = says("close" if policy.apply else "would_close", F.lit("conflict detected")) if policy.close_conflicts else says("skip", F.lit("conflict detected; use --close-conflicts to authorize closure"))
    decision = F.when(~among(F.col("author"), policy.authors), says("skip", F.lit("author "), quoted("author"), F.lit(" not on bot allowlist")))
    decision = decision.when(F.col("base_ref") != policy.base, says("skip", F.lit("base branch "), quoted("base_ref"), F.lit(f' does not match target "{policy.base}"')))
    decision = decision.when(F.col("draft"), says("skip", F.lit("draft PR")))
    decision = decision.when(~labelled, says("skip", F.lit(f'missing required label "{policy.label}"')))
    decision = decision.when(~prefixed, says("skip", F.lit("head ref "), quoted("head_ref"), F.lit(" does not match configured prefixes")))
    decision = decision.when(F.col("mergeable").isNull(), says("skip", F.lit("mergeable status still computing")))
    decision = decision.when(~F.col("mergeable"), conflict)
    if not policy.allow_no_checks:
        decision = decision.when(F.col("check_state") == "none", says("skip", F.lit("no checks reported")))
    decision = decision.when(F.col("check_state") == "pending", says("skip", F.lit("checks pending"))).when(F.col("check_state") == "failed", says("skip", F.lit("checks failed")))
    decision = decision.when(~F.col("check_state").isin("none", "passing"), says("skip", F.lit("unknown check state "), quoted("check_state")))
    decision = decision.otherwise(says("merge" if policy.apply else "would_merge", F.lit("all policy gates passed")))
    return pr.withColumn("decision", decision).select("*", "decision.action", "decision.reason").drop("decision")


def synced(pr: DataFrame, policy: Policy) -> DataFrame:
    """A decision for each request, by number; one that could not be read (error, a text) has the action
    error and does not keep the others from theirs. Without apply nothing is meant to be changed."""
    bad = F.coalesce("error", F.lit("")) != ""
    out = decide(pr, policy)
    return out.withColumn("action", F.when(bad, "error").otherwise(F.col("action"))).withColumn("reason", F.when(bad, F.col("error")).otherwise(F.col("reason"))).orderBy("number")


def sync_lines(decided: DataFrame) -> DataFrame:
    """A line for each decision, by number."""
    shown = display_action(F.col("action"))
    return decided.orderBy("number").select(F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" "), shown, F.lit(": "), F.col("reason")).alias("value"))


def display_action(action: Column) -> Column:
    """F28."""
    return F.when(action == "merge", "MERGED").when(action == "close", "CLOSED").otherwise(F.upper(action))


def _rolled(there: Column) -> Column:
    done, good = F.col("status") == "completed", F.col("conclusion").isin("success", "skipped", "neutral")
    return F.when(F.bool_or(there & ~done), "pending").when(F.bool_or(there & ~F.coalesce(good, F.lit(False))), "failed").otherwise("passing")


def roll_up(runs: DataFrame, key: str) -> DataFrame:
    """State of a commit's check runs (status, conclusion): pending before failed before passing."""
    return runs.groupBy(key).agg(_rolled(F.lit(True)).alias("state"), F.count("*").alias("total"))


def with_state(commits: DataFrame, rolled: DataFrame, key: str) -> DataFrame:
    """Commits without runs have the state none."""
    return commits.join(rolled, key, "left").withColumn("state", F.coalesce("state", F.lit("none"))).withColumn("total", F.coalesce("total", F.lit(0)))


def summaries(runs: DataFrame) -> DataFrame:
    """sha, state, total, error of commits from their check runs (sha, status, conclusion, error): without runs the
    state is none, and a commit whose runs could not be read has only its error. The runs are read once, as a second
    reading would make all requests again."""
    there = F.col("status").isNotNull()
    out = runs.groupBy("sha").agg(F.max("error").alias("error"), F.count_if(there).alias("total"), _rolled(there).alias("rolled"))
    state = F.when(F.col("total") == 0, "none").otherwise(F.col("rolled"))
    return out.select("sha", F.when(F.col("error").isNull(), state).alias("state"), F.col("total").cast("long").alias("total"), "error")


def tally(decided: DataFrame) -> DataFrame:
    """A17, F28."""
    shown = display_action(F.col("action"))
    return decided.groupBy(shown.alias("action")).agg(F.count("*").alias("n"))
