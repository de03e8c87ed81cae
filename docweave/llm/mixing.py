"""Mixing sources to target weights by Pareto order sampling.

Sources share a number of words by weight; no source gets more than `cap` times its own, the excess going to
the others by weight. The whole part of target/source_size is a number of certain copies of each document.
What is left of the target goes to one more copy of some, sampled with probabilities in proportion to size:

    p = min(1, lambda * measure),   sum of p * size = what is left,

where the measure of a document is its size cut to two leading digits, so that lambda comes from a short table
of sums by measure. Documents with p = 1 are certain too. The others are ranked by (U/(1-U)) / (p/(1-p)), U a
fixed hash of the document, and the first ones whose words fill the rest are taken: a sample of fixed size in
words, the same on each run.

The rank's threshold is found from sums over BINS ranges of rank/(1+rank), then exactly inside the one range
that it falls into, so no task sees more than a small share of a source.

Defined results: null and empty texts have size 0 and are never counted; null sources are one source, the
last; rows that repeat an id have the same U and stand next to each other; a source without words has
target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import small, stored

SPACES = "[\\x20\\x09-\\x0D]+"
BINS = 4096


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES, -1))).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target. The windows run over the list of sources, one short row each."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * cap)
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    sources = sources.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the level at the first source that stays under its limit is the level of all that do
    open_level = F.first(F.when(F.col("weight") * F.col("level") < F.col("limit"), F.col("level")), ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * open_level, F.col("limit")))
    return sources.select("source", "source_size", target.alias("target"))


def measure(size: Column) -> Column:
    """The size cut to its two leading digits."""
    step = F.pow(F.lit(10), F.greatest(F.length(size.cast("string")) - 2, F.lit(0))).cast("long")
    return size - size % step


def levels(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, lambda, rest (words that are left for documents that are not certain). Measures go from the
    largest to the first that is not certain; there are at most 90 for each power of ten."""
    sums = sizes.filter("size > 0").groupBy("source", measure(F.col("size")).alias("measure")).agg(F.sum("size").alias("words"))
    sums = sums.join(small(plan.select("of_source", "rest")), F.col("source").eqNullSafe(F.col("of_source")))
    down = Window.partitionBy("source").orderBy(F.desc("measure"))
    larger = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighed = F.sum((F.col("measure") * F.col("words")).cast("decimal(38,0)")).over(down.rowsBetween(0, Window.unboundedFollowing))
    sums = sums.withColumn("left", F.col("rest") - larger).withColumn("lambda", F.col("left") / weighed.cast("double"))
    open_ones = sums.filter(F.col("lambda") * F.col("measure") < 1)
    return open_ones.groupBy(F.col("source").alias("l_source")).agg(F.max_by("lambda", "measure").alias("lambda"), F.max_by("left", "measure").alias("left"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, text_key, size, source_size, target, copies, taken for every row; copies is how often the mix
    has the row, text_key tells rows with one id apart."""
    key = F.xxhash64("text")
    sizes = docs.select("doc_id", key.alias("text_key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), uniform(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), key.cast("string")), F.lit("mix"))).alias("u"))
    sizes = stored(sizes, "sizes")
    plan = targets(sizes, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(rate).cast("long"))
    plan = stored(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "of_source"), "targets")
    plan = stored(plan.join(levels(sizes, plan), F.col("of_source").eqNullSafe(F.col("l_source")), "left").drop("l_source"), "levels")
    rows = sizes.join(small(plan), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    p = F.col("lambda") * measure(F.col("size"))
    sampled = (F.col("size") > 0) & (p > 0) & (p < 1)
    rank = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    rows = rows.withColumn("rank", F.when(sampled, rank)).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    # the words of whole ranges before each range
    ranges = rows.filter("bin IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("words_before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    ranges = ranges.select(F.col("source").alias("r_source"), F.col("bin").alias("r_bin"), "words", "words_before")
    rows = rows.join(small(stored(ranges, "ranges")), F.col("source").eqNullSafe(F.col("r_source")) & (F.col("bin") == F.col("r_bin")), "left").drop("r_source", "r_bin")
    # whole ranges that fit are in, as are certain documents; the range where the sample ends is ranked
    inside = F.when(F.col("rank").isNull(), (F.col("size") > 0) & F.coalesce(p >= 1, F.lit(False))).otherwise(F.col("words_before") + F.col("words") <= F.col("left"))
    cut = F.col("rank").isNotNull() & ~inside & (F.col("words_before") <= F.col("left"))
    ranked = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("words_before") + F.coalesce(F.sum("size").over(ranked), F.lit(0))
    rows = rows.withColumn("cut", cut).withColumn("inside", inside)
    at_end = rows.filter("cut").withColumn("one_more", (before + F.col("size") / 2 <= F.col("left")).cast("long"))
    others = rows.filter("NOT cut").withColumn("one_more", F.col("inside").cast("long"))
    copies = F.col("whole") + F.col("one_more")
    return others.unionByName(at_end).select("doc_id", "text_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
named AS (
  SELECT source, source_size, weight, source_size * 2.0 AS lim FROM (
    SELECT source, sum(size)::BIGINT AS source_size,
           ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
    FROM sizes GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5
             - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM named),
opened AS (
  SELECT level AS open_level FROM levels WHERE weight * level < lim ORDER BY lim / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(lim, coalesce(weight * (SELECT open_level FROM opened), lim)) AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
measured AS (
  SELECT s.doc_id, s.source, s.size, s.u, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
         s.size - s.size % (10 ** greatest(length(s.size::VARCHAR) - 2, 0))::BIGINT AS measure
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
sums AS (SELECT source, rest, measure, sum(size)::BIGINT AS words FROM measured WHERE size > 0 GROUP BY ALL),
lambdas AS (
  SELECT source, measure, rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest_left,
         sum(measure::HUGEINT * words) OVER (PARTITION BY source ORDER BY measure DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weighed
  FROM sums),
solved AS (
  SELECT source, arg_max(rest_left / weighed::DOUBLE, measure) AS lambda, arg_max(rest_left, measure) AS rest_left
  FROM lambdas WHERE rest_left / weighed::DOUBLE * measure < 1 GROUP BY source),
chances AS (
  SELECT m.*, v.rest_left, v.lambda * m.measure AS p FROM measured m LEFT JOIN solved v ON m.source IS NOT DISTINCT FROM v.source),
ranked AS (
  SELECT *, coalesce(sum(CASE WHEN p > 0 AND p < 1 THEN size ELSE 0 END) OVER (PARTITION BY source
           ORDER BY CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM chances)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN size > 0 AND p >= 1 OR p > 0 AND p < 1 AND before + size / 2.0 <= rest_left THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ranked
"""
