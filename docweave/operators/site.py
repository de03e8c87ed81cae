"""Taxonomy, search index, health, feed, sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths, text

SEARCH_LIMIT, SUGGESTIONS = 7, 20
_EMPTY = "array<string>"


def taxonomy_terms(docs: DataFrame) -> DataFrame:
    """rel_path, kind, term of tags, then categories."""
    tags = docs.select("rel_path", "render", F.lit("tag").alias("kind"), F.explode("tags").alias("term"))
    return tags.unionByName(docs.select("rel_path", "render", F.lit("category").alias("kind"), F.explode("categories").alias("term")))


def taxonomy_groups(docs: DataFrame) -> DataFrame:
    """kind, term and the sorted distinct rendered pages (A5)."""
    shown = taxonomy_terms(docs).filter(paths.rendered(F.col("render")))
    return shown.groupBy("kind", "term").agg(F.array_sort(F.collect_set("rel_path")).alias("pages"))


def taxonomy_pages(docs: DataFrame, base: str = "") -> DataFrame:
    """The listing of each kind of term that occurs, and the page of each term: path (of the output file) and the
    search item t, u, g, s, h (J15, U3, C10)."""
    used = taxonomy_terms(docs).filter(paths.rendered(F.col("render"))).select("kind", "term").distinct()
    tag = F.col("kind") == "tag"
    folder = F.when(tag, "tags").otherwise("categories")
    none = F.array().cast(_EMPTY)
    one = F.struct(F.concat(folder, F.lit("/"), F.col("term"), F.lit("/index.html")).alias("path"), F.concat(F.when(tag, "Tag: ").otherwise("Category: "), F.col("term")).alias("t"), F.array("term").alias("g"))
    all_of = F.struct(F.concat(folder, F.lit("/index.html")).alias("path"), F.when(tag, "Tags").otherwise("Categories").alias("t"), none.alias("g"))
    pages = used.select(one.alias("p")).unionByName(used.select("kind").distinct().select(all_of.alias("p")))
    return pages.select("p.path", "p.t", paths.public_path(F.col("p.path"), base).alias("u"), "p.g", F.lit("").alias("s"), none.alias("h"))


def taxonomy_links(docs: DataFrame) -> DataFrame:
    """The entries of the terms' pages: kind, term, rel_path, title (the file's name without one), link from
    the term's page to the document's."""
    shown = taxonomy_terms(docs).filter(paths.rendered(F.col("render"))).select("kind", "term", "rel_path").distinct()
    page = docs.select("rel_path", file_title(docs), paths.output_path(F.col("rel_path"), F.col("slug"), F.col("render")).alias("out"))
    here = F.concat(F.when(F.col("kind") == "tag", "tags/").otherwise("categories/"), "term", F.lit("/index.html"))
    return shown.join(page, "rel_path").select("kind", "term", "rel_path", "title", paths.relative_link(here, F.col("out")).alias("link"))


def file_title(docs: DataFrame) -> Column:
    """The title, or the file's name if it is empty."""
    return F.coalesce(F.when(F.col("title") != "", F.col("title")), F.regexp_extract("rel_path", "([^/]*)$", 1)).alias("title")


def tag_counts(docs: DataFrame) -> DataFrame:
    """Over all pages, raw ones too."""
    return docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tag_order(tags: DataFrame) -> DataFrame:
    """O10."""
    return tags.orderBy(F.desc("n"), "tag")


def search_index(docs: DataFrame, base: str = "") -> DataFrame:
    """t, u, g, s, h of rendered pages and taxonomy pages (A7, F6, F8, U3); order with search_order()."""
    out = paths.output_path(F.col("rel_path"), F.col("slug"), F.col("render"))
    none = F.array().cast(_EMPTY)
    pages = docs.filter(paths.rendered(F.col("render"))).select(file_title(docs).alias("t"), paths.public_path(out, base).alias("u"), F.array_distinct(F.concat(F.coalesce("tags", none), F.coalesce("categories", none))).alias("g"), text.snippet(F.col("body")).alias("s"), text.headings(F.col("body")).alias("h"))
    return pages.unionByName(taxonomy_pages(docs, base).drop("path"))


def search_order(items: DataFrame) -> DataFrame:
    return items.orderBy("u", "t")


def search(items: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Items whose title, any tag, snippet or heading has the query as a part, in stored order,
    with the first heading that has it."""
    q = query.strip().lower()
    has: Column = F.lower("t").contains(q) | F.exists("g", lambda x: F.lower(x).contains(q)) | F.lower("s").contains(q) | F.exists("h", lambda x: F.lower(x).contains(q))
    found = items.filter(has if q else F.lit(False))
    return found.withColumn("section", F.try_element_at(F.filter("h", lambda x: F.lower(x).contains(q)), F.lit(1))).orderBy("u", "t").limit(limit)


def suggestions(items: DataFrame, query: str, limit: int = SUGGESTIONS) -> DataFrame:
    """The first nodes (id, title) whose title or id has the query as a part, in the order of ids."""
    q = query.strip().lower()
    has = F.lower("title").contains(q) | F.lower("id").contains(q)
    return items.filter(has if q else F.lit(False)).orderBy("id").limit(limit)


LACKS = ("missing_descriptions", "missing_dates", "orphaned_pages")


def health_findings(docs: DataFrame, edge: DataFrame) -> DataFrame:
    """A4: list (one of LACKS) and id of each rendered page that lacks something; one row each, however many."""
    from docweave.operators.graph import orphans_health

    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    lists = F.array(F.when(blank("description"), LACKS[0]), F.when(blank("date"), LACKS[1]))
    lacking = docs.filter(paths.rendered(F.col("render"))).select(F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("list"), F.regexp_replace("rel_path", r"\.md$", "").alias("id"))
    return lacking.unionByName(orphans_health(docs, edge).select(F.lit(LACKS[2]).alias("list"), "id"))


def health_totals(docs: DataFrame, edge: DataFrame, node: DataFrame) -> DataFrame:
    """A2, A3: one row: pages, total_word_count, avg_words_per_page, node_count, edge_count."""
    shown = docs.filter(paths.rendered(F.col("render")))
    words = text.word_count(F.coalesce("body", F.lit("")))
    totals = shown.agg(F.count("*").alias("pages"), F.coalesce(F.sum(words), F.lit(0)).alias("total_word_count"), F.coalesce(F.avg(words), F.lit(0.0)).alias("avg_words_per_page"))
    return totals.join(F.broadcast(node.agg(F.count("*").alias("node_count")))).join(F.broadcast(edge.agg(F.count("*").alias("edge_count"))))


def health(docs: DataFrame, edge: DataFrame, node: DataFrame) -> DataFrame:
    """The report in one row, its lists sorted; for sites whose report is read as a document."""
    found = health_findings(docs, edge)
    lists = found.agg(*[F.sort_array(F.collect_list(F.when(F.col("list") == x, F.col("id")))).alias(x) for x in LACKS])
    return health_totals(docs, edge, node).join(F.broadcast(lists))


def feed(items: DataFrame) -> DataFrame:
    """title, url, date, pub_date (RFC 1123), description of dated items, newest first, then by URL."""
    dated = items.filter(text.valid_date(F.col("date")).isNotNull())
    stamp = F.date_format(F.to_timestamp("date", "yyyy-MM-dd"), "EEE, dd MMM yyyy HH:mm:ss Z")
    said = F.col("description") if "description" in items.columns else F.lit("")
    return dated.orderBy(F.desc("date"), "url").select("title", "url", "date", stamp.alias("pub_date"), said.alias("description"))


def feed_pages(docs: DataFrame, site: str = "") -> DataFrame:
    """title, url, date, description of rendered pages with a date; the URL is absolute if there is a site."""
    out = paths.output_path(F.col("rel_path"), F.col("slug"), F.col("render"))
    url = paths.canonical_url(out, site) if site else paths.local_url(out)
    return docs.filter(paths.rendered(F.col("render")) & (F.coalesce("date", F.lit("")) != "")).select(file_title(docs), url.alias("url"), "date", text.snippet(F.col("body")).alias("description"))


def sitemap_locations(docs: DataFrame, site: str = "") -> DataFrame:
    """loc of all rendered and taxonomy pages; absolute if there is a site."""
    own = docs.filter(paths.rendered(F.col("render"))).select(paths.output_path(F.col("rel_path"), F.col("slug"), F.col("render")).alias("path"))
    every = own.unionByName(taxonomy_pages(docs).select("path"))
    return every.select((paths.canonical_url(F.col("path"), site) if site else paths.local_url(F.col("path"))).alias("loc"))


def sitemap(page_urls: DataFrame, taxonomy_urls: DataFrame) -> DataFrame:
    """Distinct URLs in order."""
    return page_urls.select("loc").union(taxonomy_urls.select("loc")).filter("loc <> ''").distinct().orderBy("loc")


def page_meta(docs: DataFrame, base: str = "") -> DataFrame:
    """id, author, categories, date, render, tags, title, url (of rendered pages), word_count (K4)."""
    out = paths.output_path(F.col("rel_path"), F.col("slug"), F.col("render"))
    shown = paths.rendered(F.col("render"))
    words = text.word_count(F.coalesce("body", F.lit("")))
    return docs.select(paths.page_id(F.col("rel_path"), F.col("render")).alias("id"), "author", "categories", "date", shown.alias("render"), "tags", file_title(docs), F.when(shown, paths.public_path(out, base)).alias("url"), words.alias("word_count"))


def page_count(docs: DataFrame) -> DataFrame:
    """One row: rendered pages and taxonomy pages."""
    own = docs.filter(paths.rendered(F.col("render"))).select(F.lit(1).alias("one"))
    return own.union(taxonomy_pages(docs).select(F.lit(1))).agg(F.count("*").alias("pages"))
