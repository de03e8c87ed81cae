"""The whole build: a document folder to its artifacts, behind a cache gate, published in one step."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import Config
from docweave.operators import graph, manifest, outputs, site
from docweave.sources import bundles, markdown, sinks
from docweave.storage import stored

CACHE = ".build-cache.json"
VERSION = 2


class OutputCollision(ValueError):
    """Two writers of a site claim the same file."""


def cache_path(config: Config) -> str:
    """Beside the project, never in what is published. Without a project root it lies beside the output,
    by whose name it is told."""
    out = os.path.abspath(config.output_dir)
    root = config.project_root.strip()
    if root and root != ".":
        return os.path.join(root, CACHE)
    return os.path.join(os.path.dirname(out), CACHE if os.path.basename(out) == "public" else f".{os.path.basename(out)}{CACHE}")


def tables(docs: DataFrame, config: Config) -> dict[str, DataFrame]:
    """All derived tables of a document table; its links are read once and stored."""
    found = stored(graph.links(docs), "links")
    edge, node = graph.edges(docs, found), graph.nodes(docs, found)
    meta = site.page_meta(docs, config.base_path)
    return {
        "nodes": node,
        "edges": edge,
        "backlinks": graph.backlinks(edge),
        "missing": graph.missing_targets(docs, found),
        "meta": meta,
        "search": site.search_order(site.search_index(docs, config.base_path)),
        "explorer": graph.explorer(node, edge, meta.drop("render")),
        "health": site.health(docs, edge, node),
        "tags": site.tag_counts(docs),
        "feed": site.feed(site.feed_pages(docs, config.siteurl)),
        "sitemap": site.sitemap(site.sitemap_locations(docs, config.siteurl), docs.select(F.lit("").alias("loc")).limit(0)),
    }


def fingerprint(spark: SparkSession, config: Config) -> str:
    """Of the configuration and the bytes of all content, template and asset files."""
    identity = json.dumps([VERSION, sorted(vars(config).items())])
    every = None
    for name, folder in (("content", config.content_dir), ("assets", config.asset_dir), ("templates", os.path.dirname(config.template))):
        if os.path.isdir(folder):
            files = markdown.read_files(spark, folder, "*", binary=True).select(F.concat(F.lit(f"{name}/"), "rel_path").alias("path"), "content")
            every = files if every is None else every.unionByName(files)
    return manifest.fingerprint(manifest.manifest(every), identity).first()[0]


def written(spark: SparkSession, folder: str) -> dict[str, str]:
    """Hashes of a site's files, in the order of paths."""
    files = markdown.read_files(spark, folder, "*", binary=True).withColumnRenamed("rel_path", "path")
    return {r["path"]: r["hash"] for r in manifest.manifest(files).orderBy("path").toLocalIterator()}


def case_sensitive(folder: str) -> bool:
    """Whether names that differ in case only are two files; no, if it cannot be found out."""
    probe = os.path.join(folder, f"case-probe-{uuid.uuid4().hex}")
    try:
        os.makedirs(folder, exist_ok=True)
        with open(probe, "w", encoding="utf-8"):
            pass
        other = os.path.exists(os.path.join(folder, os.path.basename(probe).upper()))
        os.remove(probe)
        return not other
    except OSError:
        return False


def _cached(spark: SparkSession, config: Config, mark: str) -> dict | None:
    """The state that the last build left, if its version, inputs and outputs are as they were."""
    try:
        with open(cache_path(config), encoding="utf-8") as f:
            old = json.load(f)
    except (OSError, ValueError):
        return None
    if old.get("version") != VERSION or not manifest.same_state(old, mark) or not os.path.isdir(config.output_dir):
        return None
    return old if old["files"] == written(spark, config.output_dir) else None


def graph_json(made: dict[str, DataFrame], path: str) -> None:
    """K3: nodes by id and edges by source, in document order."""
    node = F.struct("type", sinks.some(F.col("referenced_by")).alias("referenced_by"), "render", F.when(F.col("missing"), True).alias("missing"))
    edge = F.array("src", "dst")
    sinks.write_document({"nodes": ("map", sinks.rows_json(made["nodes"], "id", node)), "edges": ("list", sinks.rows_json(graph.ordered_edges(made["edges"]), None, edge))}, path)


def meta_value():
    return F.struct(sinks.filled(F.col("author")).alias("author"), sinks.some(F.col("categories")).alias("categories"), sinks.filled(F.col("date")).alias("date"), "render", sinks.some(F.col("tags")).alias("tags"), "title", "url", "word_count")


def explorer_value():
    """K5: the fields of a node of the explorer."""
    words = F.coalesce("word_count", F.lit(0))
    return F.struct(sinks.filled(F.col("author")).alias("author"), sinks.filled(F.col("url")).alias("url"), "type", sinks.filled(F.col("date")).alias("date"), "id", "title", "inbound", sinks.some(F.col("categories")).alias("categories"), sinks.some(F.col("tags")).alias("tags"), "outbound", words.alias("word_count"), "orphan", (F.col("type") == "stub").alias("stub"), "render")


def write_site(spark: SparkSession, config: Config, docs: DataFrame, made: dict[str, DataFrame], taken: DataFrame, assets: DataFrame | None, out: str) -> None:
    """All artifacts of a site below the folder `out`."""
    graph_json(made, f"{out}/graph.json")
    sinks.write_json(made["backlinks"], f"{out}/backlinks.json", "id", value=F.col("sources"))
    sinks.write_json(made["meta"], f"{out}/meta.json", "id", value=meta_value())
    item = F.struct("t", "u", sinks.some(F.col("g")).alias("g"), sinks.filled(F.col("s")).alias("s"), sinks.some(F.col("h")).alias("h"))
    sinks.write_json(made["search"], f"{out}/search.json", pretty=False, value=item)
    if config.graph_explorer:
        edge = graph.unique_edges(made["edges"]).orderBy("src", "dst")
        nodes = ("list", sinks.rows_json(made["explorer"].orderBy("id"), None, explorer_value()))
        sinks.write_document({"base_path": config.base_path, "nodes": nodes, "edges": ("list", sinks.rows_json(edge, None, F.array("src", "dst"))), "large_site_threshold": graph.LARGE_SITE}, f"{out}/graph/data.json")
    empty = made["sitemap"].isEmpty()
    sinks.write_text(sinks.sitemap_items(made["sitemap"]), f"{out}/sitemap.xml", *(sinks.NO_SITEMAP if empty else sinks.SITEMAP))
    where = f"\nSitemap: {config.siteurl.rstrip('/')}/sitemap.xml\n" if config.siteurl else ""
    with open(f"{out}/robots.txt", "w", encoding="utf-8") as f:
        f.write(f"User-agent: *\nAllow: /\n{where}")
    if not made["feed"].isEmpty():
        title = config.site_name if config.site_name.strip() else "Site feed"
        sinks.write_text(sinks.rss_items(made["feed"]), f"{out}/feed.xml", *sinks.rss_frame(title, f"{config.siteurl.rstrip('/')}/"))
    # raw pages as they are, stubs of missing targets that no other writer stands against, assets
    sinks.write_files(docs.filter(~F.coalesce("render", F.lit(True))).select(F.col("rel_path").alias("path"), "content"), out)
    free = made["missing"].select("target", "referenced_by").join(taken.filter(F.col("phase") == outputs.STUB).select(F.col("path").alias("taken")), graph.stub_path(F.col("target")) == F.col("taken"), "left_anti")
    sinks.write_files(sinks.listing_pages(graph.stub_parents(docs, free).select("path", F.lit("Missing page").alias("title"), "target", F.col("parent").alias("name"), "link")), out)
    if assets is not None:
        sinks.copy_files(assets, os.path.abspath(config.asset_dir), f"{os.path.abspath(out)}/assets")


def health_report(made: dict[str, DataFrame]) -> dict:
    """C7 as a document."""
    report = made["health"].first().asDict()
    tags = [{"tag": r["tag"], "count": r["n"]} for r in site.tag_order(made["tags"]).collect()]  # one for each term of a site
    return {"top_tags": tags} | {k: report[k] for k in ("orphaned_pages", "missing_descriptions", "missing_dates", "total_word_count", "avg_words_per_page", "node_count", "edge_count")}


def build(spark: SparkSession, config: Config) -> dict:
    """{"cached", "pages", "warnings", "health"}. A build whose inputs and outputs are as the last one left
    them does nothing; any other is a full one, and its files appear together or not at all. Writers that claim the
    same file make it fail."""
    config = config.validated(absolute=True)
    mark = fingerprint(spark, config)
    old = _cached(spark, config, mark)
    if old:
        return {"cached": True} | {k: old[k] for k in ("pages", "warnings", "health")}
    docs = stored(markdown.documents(markdown.read_files(spark, config.content_dir)), "documents")
    made = tables(docs, config)
    assets = bundles.site_assets(spark, config.asset_dir, config.project_root, config.output_dir, config.graph_explorer)
    claimed = outputs.claims(docs, config.graph_explorer, made["missing"], assets)
    clashes = stored(outputs.collisions(claimed, case_sensitive(os.path.dirname(os.path.abspath(config.output_dir)))), "collisions")
    first = clashes.filter("level = 'ERROR'").orderBy("phase", "path").first()
    if first:
        raise OutputCollision(first["message"])
    warned = clashes.filter(F.col("message").startswith("output path warning")).select(F.col("message").alias("w"))
    warned = warned.unionByName(docs.select(F.explode("warnings").alias("w"), "rel_path").select(F.concat("rel_path", F.lit(": "), "w").alias("w")))
    warnings = [r["w"] for r in warned.orderBy("w").toLocalIterator()]  # O11
    pages, health = site.page_count(docs).first()["pages"], health_report(made)
    with sinks.Publication(config.output_dir) as out:
        write_site(spark, config, docs, made, clashes, assets, out)
        state = {"version": VERSION, "fingerprint": mark, "pages": pages, "warnings": warnings, "health": health, "files": written(spark, out)}
    sinks.replace_file(cache_path(config), json.dumps(state))
    return {"cached": False, "pages": pages, "warnings": warnings, "health": health}
