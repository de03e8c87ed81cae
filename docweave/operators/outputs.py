"""Who writes which file of a site: claims of pages, reserved paths, taxonomy pages, stubs and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths
from docweave.operators import graph, site

# What the explorer reserves, and its name in messages.
RESERVED = ("graph/data.json", "graph/index.html")
RESERVED_BY = "the knowledge graph explorer (disable with graph_explorer: false)"
PAGE, EXPLORER, TAXONOMY, STUB, ASSET = range(5)


def _quoted(before: str, c: Column) -> Column:
    return F.concat(F.lit(f'{before}"'), c, F.lit('"'))


def claims(docs: DataFrame, explorer: bool = True, missing: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """phase, name, source, path of all writers, in the order of phase and name: rendered pages, the explorer,
    taxonomy pages, stubs of missing targets (target), assets (path, below the folder of assets)."""
    spark = docs.sparkSession
    row = lambda df, phase, name, source, path: df.select(F.lit(phase).alias("phase"), name.alias("name"), source.alias("source"), path.alias("path"))
    rel = F.col("rel_path")
    out = row(docs.filter(paths.rendered(F.col("render"))), PAGE, rel, _quoted("", rel), paths.output_path(rel, F.col("slug"), F.col("render")))
    if explorer:
        own = spark.createDataFrame([(r,) for r in RESERVED], "path string")
        out = out.unionByName(row(own, EXPLORER, F.col("path"), F.lit(RESERVED_BY), F.col("path")))
    terms = site.taxonomy_pages(docs).select("path")
    out = out.unionByName(row(terms, TAXONOMY, F.col("path"), F.lit("the generated taxonomy page"), F.col("path")))
    if missing is not None:
        out = out.unionByName(row(missing, STUB, F.col("target"), _quoted("the generated stub for ", F.col("target")), graph.stub_path(F.col("target"))))
    if assets is not None:
        path = F.concat(F.lit("assets/"), F.col("path"))
        out = out.unionByName(row(assets, ASSET, path, _quoted("the asset ", path), path))
    return out


def collisions(claimed: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Phase, path, first, level, message of each claim that an earlier writer stands against. The same
    path is an error (a stub is only left out: WARN); paths that differ in case only are an error where the file
    system takes them for one, else a warning. First writers are minima, so no window runs over a hot path."""
    claim = F.struct("phase", "name", "source", "path")
    same = claimed.groupBy("path").agg(F.min(claim).alias("same"), F.max(claim).alias("last")).filter("same <> last").drop("last").withColumnRenamed("path", "exact")
    alike = claimed.groupBy(F.lower("path").alias("folded")).agg(F.min(claim).alias("alike"), F.min("path").alias("a"), F.max("path").alias("b")).filter("a <> b").drop("a", "b")
    out = claimed.join(same, F.col("path") == F.col("exact"), "left").join(alike, F.lower("path") == F.col("folded"), "left")
    later = lambda c: F.struct("phase", "name", "source", "path") > F.col(c)
    taken, near = F.coalesce(later("same"), F.lit(False)), F.coalesce(later("alike") & (F.col("alike.path") != F.col("path")), F.lit(False))
    say = lambda c, tail: F.concat(F.col(f"{c}.source"), F.lit(" maps to "), _quoted("", F.col(f"{c}.path")), F.lit(" and "), F.col("source"), F.lit(" maps to "), _quoted("", F.col("path")), F.lit(tail))
    both = F.concat(F.lit("output path collision: "), F.col("same.source"), F.lit(" and "), F.col("source"), _quoted(" both map to ", F.col("path")))
    one_file = F.concat(F.lit("output path collision: "), say("alike", ", which are the same file on case-insensitive filesystems"))
    warned = F.concat(F.lit("output path warning: "), say("alike", ", which would be the same file on a case-insensitive filesystem"))
    error = taken | (near & F.lit(not case_sensitive))
    level = F.when(error & (F.col("phase") != STUB), "ERROR").otherwise("WARN")
    message = F.when(taken, both).when(F.lit(not case_sensitive), one_file).otherwise(warned)
    return out.filter(taken | near).select("phase", "path", F.when(taken, F.col("same.source")).otherwise(F.col("alike.source")).alias("first"), level.alias("level"), message.alias("message"))
