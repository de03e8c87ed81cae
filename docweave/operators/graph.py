"""Links of documents: extraction, edges, backlinks, adjacency, stubs, orphans, the explorer's table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import paths, text
from docweave.sources import commonmark
from docweave.storage import small, stored

#: Nodes from which on an explorer shows a search first.
LARGE_SITE = 500
_EMPTY = "array<string>"


def markdown_links(body: Column) -> Column:
    """Destinations of the links of a Markdown text in order, images left out (G1)."""
    return F.transform(F.filter(commonmark.parsed_references(body), lambda r: ~r["image"]), lambda r: r["dest"])


def html_references(html: Column) -> Column:
    """Values of href and src attributes in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']([^"']*)["']"""), F.lit(1))


def links(docs: DataFrame) -> DataFrame:
    """rel_path, render, dest, seq, target of all links of documents to content files."""
    found = docs.select("rel_path", "render", F.posexplode(markdown_links(F.col("body"))).alias("seq", "dest"))
    return found.withColumn("target", paths.resolve_link(F.col("dest"), F.col("rel_path"))).filter("target IS NOT NULL")


def edges(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """src, dst, seq; duplicates stay. A target's id depends on how, and whether, it is rendered (J1). `found`
    are the links() of the documents if they are at hand."""
    known = docs.select(F.col("rel_path").alias("target"), F.col("render").alias("target_render"))
    found = (links(docs) if found is None else found).join(known, "target", "left")
    return found.select(paths.page_id(F.col("rel_path"), F.col("render")).alias("src"), paths.page_id(F.col("target"), F.col("target_render")).alias("dst"), "seq")


def ordered_edges(edge: DataFrame) -> DataFrame:
    """O2: by source; inside a source in document order."""
    return edge.orderBy("src", "seq")


def nodes(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Content nodes and a stub for each missing target, with its distinct parents."""
    own = docs.select(paths.page_id(F.col("rel_path"), F.col("render")).alias("id"), F.lit("page").alias("type"), paths.rendered(F.col("render")).alias("render"), F.lit(False).alias("missing"), F.array().cast(_EMPTY).alias("referenced_by"))
    gone = missing_targets(docs, found).select(F.regexp_replace("target", r"\.md$", "").alias("id"), F.lit("stub").alias("type"), F.lit(True).alias("render"), F.lit(True).alias("missing"), "referenced_by")
    return own.unionByName(gone)


def missing_targets(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    found = (links(docs) if found is None else found).join(docs.select(F.col("rel_path").alias("target")), "target", "left_anti")
    return found.groupBy("target").agg(F.array_sort(F.collect_set("rel_path")).alias("referenced_by"))


def stub_parents(docs: DataFrame, missing: DataFrame) -> DataFrame:
    """The entries of the stub page of each missing target: target, path of the stub, parent, link from the
    stub to the parent's output, by target and parent."""
    parents = missing.select("target", F.explode("referenced_by").alias("rel_path"))
    page = docs.select("rel_path", paths.output_path(F.col("rel_path"), F.col("slug"), F.col("render")).alias("out"))
    here = stub_path(F.col("target"))
    return parents.join(page, "rel_path").select("target", here.alias("path"), F.col("rel_path").alias("parent"), paths.relative_link(here, F.col("out")).alias("link")).orderBy("target", "parent")


def stub_path(target: Column) -> Column:
    """Where the stub of a missing target is written."""
    return paths.output_path(target, F.lit(""), F.lit(True))


def backlinks(edge: DataFrame) -> DataFrame:
    """id and the sorted list of sources, duplicates kept."""
    return edge.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("sources"))


#: Entries of a list in one row.
CHUNK = 1000


def chunked(pairs: DataFrame, key: str, value: str, size: int = CHUNK) -> DataFrame:
    """key, chunk (from 0), items: the ordered values of each key, cut into rows of `size`. Pairs are dealt by ranges of
    both columns, so a key with very many values is in many tasks; where its values begin in each is one short row."""
    dealt = pairs.select(key, value).repartitionByRange(key, value).sortWithinPartitions(key, value)
    dealt = stored(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(key, "__part").agg(F.count("*").alias("__n")).select(key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    late = small(stored(first.filter("__first > 0"), "range-starts"))
    inside = F.row_number().over(Window.partitionBy("__part", key).orderBy(value))
    placed = dealt.withColumn("__inside", inside).join(late, [key, "__part"], "left")
    chunk = F.floor((F.coalesce("__first", F.lit(0)) + F.col("__inside") - 1) / size).cast("long")
    return placed.groupBy(key, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(value)).alias("items"))


def backlink_chunks(edge: DataFrame, size: int = CHUNK) -> DataFrame:
    """A13 in bounded rows: id, chunk, sources."""
    return chunked(edge.select(F.col("dst").alias("id"), "src"), "id", "src", size).withColumnRenamed("items", "sources")


def adjacency_chunks(node_ids: DataFrame, edge: DataFrame, size: int = CHUNK) -> DataFrame:
    """A14 in bounded rows: id, direction (inbound, outbound), chunk, neighbours; a node without any has a row with
    neither."""
    way = lambda a, b, name: edge.select(F.struct(F.col(a).alias("id"), F.lit(name).alias("direction")).alias("end"), F.col(b).alias("other"))
    both = way("dst", "src", "inbound").unionByName(way("src", "dst", "outbound")).filter("end.id IS NOT NULL AND other IS NOT NULL").distinct()
    lists = chunked(both, "end", "other", size).select("end.id", "end.direction", "chunk", F.col("items").alias("neighbours"))
    linked = edge.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    alone = node_ids.select("id").distinct().join(linked, "id", "left_anti")
    return lists.unionByName(alone.select("id", F.lit(None).cast("string").alias("direction"), F.lit(0).cast("long").alias("chunk"), F.array().cast("array<string>").alias("neighbours")))


def adjacency(node_ids: DataFrame, edge: DataFrame) -> DataFrame:
    """id, inbound, outbound as sorted sets, for all nodes and endpoints (A14, U2). One pass: each edge
    gives a row to either end."""
    ends = edge.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("src").alias("i"), F.lit(None).cast("string").alias("o")), F.struct(F.col("src").alias("id"), F.lit(None).cast("string").alias("i"), F.col("dst").alias("o")))).alias("e")).select("e.*")
    every = ends.unionByName(node_ids.select("id", F.lit(None).cast("string").alias("i"), F.lit(None).cast("string").alias("o")))
    return every.groupBy("id").agg(F.array_sort(F.collect_set("i")).alias("inbound"), F.array_sort(F.collect_set("o")).alias("outbound"))


def unique_edges(edge: DataFrame) -> DataFrame:
    """Distinct edges with both ends; documents have them by source and target."""
    return edge.filter((F.col("src") != "") & (F.col("dst") != "")).select("src", "dst").distinct()


def orphans_health(docs: DataFrame, edge: DataFrame) -> DataFrame:
    """Rendered pages nobody links to, index excepted; self links and raw pages count as links."""
    pages = docs.filter(paths.rendered(F.col("render"))).select(F.regexp_replace("rel_path", r"\.md$", "").alias("id"))
    return pages.filter("id <> 'index'").join(edge.select(F.col("dst").alias("id")), "id", "left_anti")


def orphans_explorer(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Any node without inbound edges, stubs and raw pages too."""
    return node.filter("id <> 'index'").join(edge.select(F.col("dst").alias("id")), "id", "left_anti")


def orphans_checker(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Rendered pages that no link with an existing target reaches."""
    found = (links(docs) if found is None else found).join(docs.select(F.col("rel_path").alias("target")), "target", "left_semi").select(F.col("target").alias("rel_path"))
    return docs.filter(paths.rendered(F.col("render")) & (F.col("rel_path") != "index.md")).select("rel_path").join(found, "rel_path", "left_anti")


def node_class(kind: Column, render: Column, inbound: Column, node: Column) -> Column:
    """G8."""
    return F.when(kind == "stub", "stub").when(~render, "raw").when((F.size(inbound) == 0) & (node != "index"), "orphan").otherwise("page")


def explorer(node: DataFrame, edge: DataFrame, meta: DataFrame) -> DataFrame:
    """Nodes with neighbours, metadata (id, title, url, author, date, tags, categories, word_count)
    and class, and whether the site counts as large."""
    out = node.join(adjacency(node.select("id"), edge), "id", "left").join(meta, "id", "left")
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), text.title_from_id(F.col("id")))
    orphan = (F.size("inbound") == 0) & (F.col("id") != "index")
    return out.withColumn("title", title).withColumn("orphan", orphan).withColumn("class", node_class(F.col("type"), F.col("render"), F.col("inbound"), F.col("id")))


def neighbourhood(edge: DataFrame, node: Column | str) -> DataFrame:
    """The node and all within one step, either way."""
    node = F.lit(node) if isinstance(node, str) else node
    near = edge.filter(F.col("src") == node).select(F.col("dst").alias("id")).unionByName(edge.filter(F.col("dst") == node).select(F.col("src").alias("id")))
    return near.unionByName(edge.sparkSession.range(1).select(node.alias("id"))).distinct()


def visible_edges(edge: DataFrame, visible: DataFrame) -> DataFrame:
    """P20: both ends visible."""
    ids = visible.select("id").distinct()
    return edge.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def explorer_filter(query: str) -> Column:
    """Tokens ANDed; tag:, category:/cat:, author: exact, id: part; others part of title, id, tags,
    categories or author. An empty value matches nothing."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    among = lambda c, v: F.exists(F.coalesce(F.col(c), F.array().cast(_EMPTY)), lambda t: F.lower(t) == v)
    part = lambda c, v: F.exists(F.coalesce(F.col(c), F.array().cast(_EMPTY)), lambda t: F.lower(t).contains(v))
    tests = []
    for token in query.lower().split():
        field, colon, value = token.partition(":")
        if colon and field in ("tag", "category", "cat", "author", "id"):
            if not value:
                return F.lit(False)
            tests.append({"tag": lambda v: among("tags", v), "category": lambda v: among("categories", v), "cat": lambda v: among("categories", v), "author": lambda v: low("author") == v, "id": lambda v: low("id").contains(v)}[field](value))
        else:
            tests.append(low("title").contains(token) | low("id").contains(token) | part("tags", token) | part("categories", token) | low("author").contains(token))
    return reduce(Column.__and__, tests, F.lit(True))


def class_filter(show_render: bool = True, show_raw: bool = True, show_stub: bool = True, orphans_only: bool = False) -> Column:
    """P18."""
    stub = F.col("type") == "stub"
    raw = ~F.col("render") & ~stub
    shown = (stub & F.lit(show_stub)) | (raw & F.lit(show_raw)) | (F.col("render") & ~stub & F.lit(show_render))
    return shown & F.col("orphan") if orphans_only else shown


def large_site(node: DataFrame, threshold: int = LARGE_SITE) -> DataFrame:
    """One row: the number of nodes and whether the site counts as large."""
    return node.agg(F.count("*").alias("nodes"), (F.count("*") >= threshold).alias("large"))


def first_owner(claims: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Claims (path, owner) whose path an earlier owner has: path, owner, first. First owners are
    found by a minimum, so a path that many claim is summed up before the shuffle."""
    key = F.lower("path") if ignore_case else F.col("path")
    firsts = claims.groupBy(key.alias("claimed")).agg(F.min("owner").alias("first"), F.max("owner").alias("last")).filter("first <> last").drop("last")
    return claims.join(firsts, key == F.col("claimed")).filter("owner <> first").drop("claimed")
