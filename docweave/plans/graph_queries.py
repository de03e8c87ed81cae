"""Links, graphs and site tables over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import paths, text
from docweave.operators import checks, graph, site
from docweave.plans.registry import query, table
from docweave.plans.text_queries import part_documents
from docweave.sources import markdown
from docweave.storage import stored

_HREFS = "SELECT page_id, unnest(h) AS reference, unnest(range(len(h))) AS seq FROM (SELECT page_id, regexp_extract_all(html, '(?i)\\b(?:href|src)\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS h FROM pages)"


@query(f"SELECT page_id, seq::INT AS seq, reference FROM ({_HREFS})")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(graph.html_references(F.col("html"))).alias("seq", "reference"))


@query(f"SELECT external, count(*) AS n FROM (SELECT regexp_matches(CASE seq % 4 WHEN 0 THEN '//x' || reference WHEN 1 THEN 'mailto:' || reference WHEN 2 THEN '#' || reference ELSE reference END, '^(#|//|[a-zA-Z][a-zA-Z0-9+.-]*:)') AS external FROM ({_HREFS})) GROUP BY external")
def link_classify(spark, d):
    k = F.col("seq") % 4
    ref = F.when(k == 0, F.concat(F.lit("//x"), "reference")).when(k == 1, F.concat(F.lit("mailto:"), "reference")).when(k == 2, F.concat(F.lit("#"), "reference")).otherwise(F.col("reference"))
    return page_links(spark, d).groupBy(paths.is_external(ref).alias("external")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || '/a.md' WHEN 1 THEN 'notes/' || source || '/a.md' WHEN 2 THEN 'notes/a.md'
  WHEN 3 THEN NULL WHEN 4 THEN 'notes/' || source || '/b/a.md' ELSE NULL END AS target FROM documents""")
def link_resolve(spark, d):
    forms = [F.concat(F.lit("/"), "source", F.lit("/./a.md?x=1#y")), F.lit("a.md"), F.lit("../a.md#top"), F.lit("../../../a.md"), F.lit("c/../b//a.md"), F.lit("https://example.com/a.md")]
    dest = F.element_at(F.array(*forms), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", paths.resolve_link(dest, F.concat(F.lit("notes/"), "source", F.lit("/p.md"))).alias("target"))


def linked_documents(spark, d):
    """Pages as Markdown documents: page n links to n * 7, n * 7 + 1 (twice) and to a page that may not be
    there; every ninth page is raw; descriptions, dates and titles are missing here and there."""
    n = F.col("page_id")
    to = lambda c, extra="": F.concat(F.lit("[x](/p/"), c.cast("string"), F.lit(f".md{extra}) "))
    near = F.pmod(n * 7 + 1, F.lit(200))
    body = F.concat(F.lit("Text ![no](/p/0.md) `[no](/p/1.md)`\n"), to(F.pmod(n * 7, F.lit(200))), to(near), to(near, "?q=1#f"), to(F.pmod(n * 11, F.lit(400))), F.lit("[out](https://example.com/a.md) [frag](#a)\n"), F.repeat(F.lit("w "), (n % 17).cast("int")))
    return markdown.from_table(
        table(spark, d, "pages"),
        F.concat(F.lit("p/"), n.cast("string"), F.lit(".md")),
        body,
        title=F.when(n % 13 != 0, F.concat(F.lit("Page "), n.cast("string"))),
        description=F.when(n % 4 != 0, F.lit("about")),
        date=F.when(n % 3 == 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")), "yyyy-MM-dd")),
        render=F.when(n % 9 == 0, F.lit(False)),
        slug=F.when(n % 5 == 0, F.concat(F.lit("s"), (n % 50).cast("string"))),
    )


#: Pieces of Markdown with a number in them, and the destinations of their links.
_PIECES = [
    ("[a](/x/{k}.md)", ["/x/{k}.md"]),
    ('![i](/i/{k}.png) and [b](c{k}.md "t")', ["c{k}.md"]),
    ("`[no](n{k}.md)`", []),
    ("\\[no](n{k}.md) [y](y{k}.md)", ["y{k}.md"]),
    ("[o [i](in{k}.md)](out.md)", ["in{k}.md"]),
    ("    [code](d{k}.md)", []),
    ("> [q](q{k}.md)\n- [l](l{k}.md)", ["q{k}.md", "l{k}.md"]),
    ("[r{k}]\n\n[r{k}]: <ref {k}.md> 'T'", ["ref {k}.md"]),
]
_DESTS = " ".join(f"WHEN {n} THEN [{', '.join(repr(d).replace('{k}', chr(39) + ' || k || ' + chr(39)) for d in dests)}]::VARCHAR[]" for n, (_, dests) in enumerate(_PIECES))


@query(f"""WITH o AS (SELECT o_orderkey AS k, unnest([0, 1, 2, 3]) AS j FROM orders), f AS (SELECT k, j, k // (8 ** j)::BIGINT % 8 AS f FROM o),
d AS (SELECT k, j, unnest(CASE f {_DESTS} END) AS dest, unnest(range(len(CASE f {_DESTS} END))) AS n FROM f)
SELECT k AS number, (row_number() OVER (PARTITION BY k ORDER BY j, n) - 1)::INT AS seq, dest FROM d""")
def markdown_variety(spark, d):
    """Orders as texts of four pieces in all mixtures that their keys spell in base eight."""
    k, forms = F.col("o_orderkey"), F.array(*[F.lit(p) for p, _ in _PIECES])
    pieces = [F.element_at(forms, (F.floor(k / 8**j) % 8 + 1).cast("int")) for j in range(4)]
    body = F.replace(F.concat_ws("\n\ntext\n\n", *pieces), F.lit("{k}"), k.cast("string"))
    return table(spark, d, "orders").select(k.alias("number"), F.posexplode(graph.markdown_links(body)).alias("seq", "dest"))


_DOCS = """docs AS (SELECT page_id AS n, 'p/' || page_id || '.md' AS rel_path, page_id % 9 <> 0 AS render,
  CASE WHEN page_id % 9 = 0 THEN 'p/' || page_id || '.md' ELSE 'p/' || page_id END AS id FROM pages),
links AS (SELECT n, rel_path, id AS src, unnest([n * 7 % 200, (n * 7 + 1) % 200, (n * 7 + 1) % 200, n * 11 % 400]) AS t, unnest([0, 1, 2, 3]) AS seq FROM docs),
edges AS (SELECT l.src, coalesce(d.id, 'p/' || l.t) AS dst, l.seq, l.rel_path, l.t, d.n IS NULL AS missing FROM links l LEFT JOIN docs d ON d.n = l.t)"""


@query(f"WITH {_DOCS} SELECT src, seq::INT AS seq, dst FROM edges")
def document_edges(spark, d):
    return graph.ordered_edges(graph.edges(linked_documents(spark, d)))


@query(f"WITH {_DOCS} SELECT 'p/' || t || '.md' AS target, string_agg(DISTINCT rel_path, ',' ORDER BY rel_path) AS referenced_by FROM edges WHERE missing GROUP BY t")
def missing_targets(spark, d):
    return graph.missing_targets(linked_documents(spark, d)).select("target", F.array_join("referenced_by", ",").alias("referenced_by"))


@query(f"""WITH {_DOCS} SELECT id, 'page' AS type, render, false AS missing, '' AS referenced_by FROM docs
UNION ALL SELECT 'p/' || t, 'stub', true, true, string_agg(DISTINCT rel_path, ',' ORDER BY rel_path) FROM edges WHERE missing GROUP BY t""")
def stub_nodes(spark, d):
    return graph.nodes(linked_documents(spark, d)).withColumn("referenced_by", F.array_join("referenced_by", ","))


@query(f"WITH {_DOCS} SELECT 'p/' || n AS id FROM docs WHERE render AND 'p/' || n NOT IN (SELECT dst FROM edges)")
def orphans_of_pages(spark, d):
    docs = linked_documents(spark, d)
    return graph.orphans_health(docs, graph.edges(docs))


@query(f"WITH {_DOCS} SELECT rel_path FROM docs WHERE render AND n NOT IN (SELECT t FROM edges WHERE NOT missing)")
def orphans_checker(spark, d):
    return graph.orphans_checker(linked_documents(spark, d))


@query(f"""WITH {_DOCS}, near AS (SELECT dst AS id, src AS i, NULL AS o FROM edges UNION ALL SELECT src, NULL, dst FROM edges UNION ALL SELECT id, NULL, NULL FROM docs),
adj AS (SELECT id, count(DISTINCT i) AS n_in, count(DISTINCT o) AS n_out FROM near GROUP BY id)
SELECT a.id, CASE WHEN d.n IS NULL THEN regexp_extract(a.id, '[0-9]+') WHEN d.n % 13 = 0 THEN 'none' ELSE 'Page ' || d.n END AS title,
  a.n_in::INT AS n_in, a.n_out::INT AS n_out, a.n_in = 0 AS orphan,
  CASE WHEN d.n IS NULL THEN 'stub' WHEN NOT d.render THEN 'raw' WHEN a.n_in = 0 THEN 'orphan' ELSE 'page' END AS class
FROM adj a LEFT JOIN docs d ON d.id = a.id""")
def explorer_nodes(spark, d):
    docs = linked_documents(spark, d)
    meta = site.page_meta(docs).withColumn("title", F.when(F.col("title").endswith(".md"), "none").otherwise(F.col("title"))).select("id", "title")
    found = stored(graph.links(docs), "links")
    out = graph.explorer(graph.nodes(docs, found), graph.edges(docs, found), meta)
    return out.select("id", "title", F.size("inbound").alias("n_in"), F.size("outbound").alias("n_out"), "orphan", "class")


@query(f"""WITH {_DOCS}, p AS (SELECT *, 'p/' || n AS page, n % 4 = 0 AS nodesc, n % 3 <> 0 AS nodate, 'p/' || n NOT IN (SELECT dst FROM edges) AS lonely FROM docs WHERE render),
m AS (SELECT (SELECT count(*) FROM docs) + (SELECT count(DISTINCT t) FROM edges WHERE missing) AS node_count)
SELECT count(*) AS pages, sum(9 + n % 17)::BIGINT AS total_word_count, avg(9 + n % 17) AS avg_words_per_page, any_value(node_count) AS node_count, (SELECT count(*) FROM edges) AS edge_count,
 string_agg(page, ',' ORDER BY page) FILTER (nodesc) AS missing_descriptions, string_agg(page, ',' ORDER BY page) FILTER (nodate) AS missing_dates, string_agg(page, ',' ORDER BY page) FILTER (lonely) AS orphaned_pages FROM p, m""")
def page_health(spark, d):
    docs = linked_documents(spark, d)
    found = stored(graph.links(docs), "links")
    out = site.health(docs, graph.edges(docs, found), graph.nodes(docs, found))
    return out.select("pages", "total_word_count", "avg_words_per_page", "node_count", "edge_count", *[F.array_join(x, ",").alias(x) for x in site.LACKS])


# --- the same operators at the scale of the order tables ------------------------------------------


def order_edges(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


_ORDERS = "edges AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


@query(f"WITH {_ORDERS} SELECT dst AS id, count(*) AS n, md5(string_agg(src, ',' ORDER BY src)) AS sources FROM edges GROUP BY dst")
def backlinks(spark, d):
    return graph.backlinks(order_edges(spark, d)).select("id", F.size("sources").cast("long").alias("n"), F.md5(F.array_join("sources", ",")).alias("sources"))


@query(f"""WITH {_ORDERS}, e AS (SELECT dst AS id, src AS i, NULL AS o FROM edges UNION ALL SELECT src, NULL, dst FROM edges UNION ALL SELECT 'p' || p_partkey, NULL, NULL FROM part)
SELECT id, count(DISTINCT i) AS n_in, count(DISTINCT o) AS n_out, md5(coalesce(string_agg(DISTINCT i, ',' ORDER BY i), '')) AS inbound, md5(coalesce(string_agg(DISTINCT o, ',' ORDER BY o), '')) AS outbound FROM e GROUP BY id""")
def adjacency(spark, d):
    out = graph.adjacency(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id")), order_edges(spark, d))
    return out.select("id", F.size("inbound").cast("long").alias("n_in"), F.size("outbound").cast("long").alias("n_out"), F.md5(F.array_join("inbound", ",")).alias("inbound"), F.md5(F.array_join("outbound", ",")).alias("outbound"))


@query(f"""WITH {_ORDERS}, n AS (SELECT dst AS id, src, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 8 AS chunk FROM edges)
SELECT id, chunk::BIGINT AS chunk, count(*) AS n, string_agg(src, ',' ORDER BY src) AS sources FROM n GROUP BY id, chunk""")
def backlink_chunks(spark, d):
    out = graph.backlink_chunks(order_edges(spark, d), 8)
    return out.select("id", "chunk", F.size("sources").cast("long").alias("n"), F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {_ORDERS}, e AS (SELECT dst AS id, 'inbound' AS direction, src AS other FROM edges UNION SELECT src, 'outbound', dst FROM edges),
n AS (SELECT *, (row_number() OVER (PARTITION BY id, direction ORDER BY other) - 1) // 8 AS chunk FROM e)
SELECT id, direction, chunk::BIGINT AS chunk, string_agg(other, ',' ORDER BY other) AS neighbours FROM n GROUP BY ALL
UNION ALL SELECT 'p' || p_partkey, NULL, 0, '' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def adjacency_chunks(spark, d):
    nodes = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return graph.adjacency_chunks(nodes, order_edges(spark, d), 8).withColumn("neighbours", F.array_join("neighbours", ","))


@query(f"WITH {_ORDERS} SELECT DISTINCT src, dst FROM edges")
def unique_edges(spark, d):
    return graph.unique_edges(order_edges(spark, d))


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def orphans_explorer(spark, d):
    edge = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    return graph.orphans_explorer(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")), edge)


@query(f"WITH {_ORDERS} SELECT 'p1' AS id UNION SELECT dst FROM edges WHERE src = 'p1' UNION SELECT src FROM edges WHERE dst = 'p1'")
def focus_neighbourhood(spark, d):
    return graph.neighbourhood(order_edges(spark, d), "p1")


@query("SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def visible_edges(spark, d):
    edge = order_edges(spark, d)
    parts = table(spark, d, "part").filter("p_type = 'ECONOMY'").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    orders = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return graph.visible_edges(edge, parts.union(orders))


@query("SELECT 'parts/p' || p_partkey AS id FROM part WHERE p_name ILIKE '%widget%' AND lower(p_type) = 'economy' AND ('parts/p' || p_partkey) LIKE '%1%'")
def explorer_query(spark, d):
    docs = part_documents(spark, d).withColumn("author", F.lit(None).cast("string")).withColumn("id", F.regexp_replace("rel_path", r"\.md$", ""))
    return docs.filter(graph.explorer_filter("widget tag:economy id:1")).select("id")


@query("SELECT count(*) AS n FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0")
def class_toggles(spark, d):
    part = table(spark, d, "part")
    n = part.select(F.when(F.col("p_partkey") % 7 == 0, "stub").otherwise("page").alias("type"), (F.col("p_partkey") % 5 != 0).alias("render"), F.lit(False).alias("orphan"))
    return n.filter(graph.class_filter(show_render=False)).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_partkey, lower(p_name) || '/index.html' AS path FROM part)
SELECT path, p_partkey AS owner, first FROM (SELECT *, min(p_partkey) OVER (PARTITION BY path) AS first FROM c) WHERE first <> p_partkey""")
def collision_check(spark, d):
    claims = table(spark, d, "part").select(F.concat(F.lower("p_name"), F.lit("/index.html")).alias("path"), F.col("p_partkey").alias("owner"))
    return graph.first_owner(claims)


@query("""WITH p AS (SELECT doc_id, coalesce(text, '') = '' OR doc_id % 3 = 0 AS nodesc, l.quality IS NULL AS nodate, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS words FROM documents LEFT JOIN labels l USING (doc_id)),
e AS (SELECT doc_id FROM p WHERE doc_id % 2 = 1)
SELECT 'missing_descriptions' AS list, 'd/' || doc_id AS id FROM p WHERE nodesc UNION ALL SELECT 'missing_dates', 'd/' || doc_id FROM p WHERE nodate UNION ALL SELECT 'orphaned_pages', 'd/' || doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM e)""")
def content_health(spark, d):
    """What documents lack, one row each: those with labels are dated, those with an odd id linked to."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    named = markdown.from_table(docs, F.concat(F.lit("d/"), "doc_id", F.lit(".md")), F.col("text"), description=F.when(F.col("doc_id") % 3 != 0, F.col("text")), date=F.when(F.col("quality").isNotNull(), F.lit("2024-01-01")))
    edge = docs.filter("doc_id % 2 = 1").select(F.lit("index").alias("src"), F.concat(F.lit("d/"), "doc_id").alias("dst"), F.lit(0).alias("seq"))
    return site.health_findings(named, edge)


@query("SELECT 'Order ' || o_orderkey AS title, '/o/' || o_orderkey || '/' AS url, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%a, %d %b %Y 00:00:00 +0000') AS pub_date FROM orders WHERE o_orderstatus <> 'P'")
def feed_items(spark, d):
    day = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    return site.feed(table(spark, d, "orders").select(F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.concat(F.lit("/o/"), "o_orderkey", F.lit("/")).alias("url"), day.alias("date"))).drop("description")


@query("SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS loc FROM pages UNION SELECT DISTINCT '/tags/' || lang || '/' FROM documents")
def sitemap_urls(spark, d):
    return site.sitemap(table(spark, d, "pages").select(paths.link_path(F.col("url")).alias("loc")), table(spark, d, "documents").select(F.concat(F.lit("/tags/"), "lang", F.lit("/")).alias("loc")))


# --- checks ---------------------------------------------------------------------------------------


@query(f"""WITH {_DOCS}, o AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'p/s' || n % 50 ELSE 'p/' || n END || '/index.html' AS path FROM docs WHERE render),
f AS (
 SELECT rel_path AS file, 'WARN' AS level, 'missing_metadata' AS category FROM docs WHERE render AND n % 13 = 0
 UNION ALL SELECT rel_path, 'WARN', 'missing_metadata' FROM docs WHERE render AND n % 4 = 0
 UNION ALL SELECT rel_path, 'ERROR', 'missing_metadata' FROM docs WHERE NOT render AND n % 5 = 0
 UNION ALL SELECT rel_path, 'ERROR', 'broken_links' FROM edges WHERE missing
 UNION ALL SELECT rel_path, 'ERROR', 'broken_links' FROM (SELECT rel_path, row_number() OVER (PARTITION BY path ORDER BY rel_path) AS k FROM o) WHERE k > 1
 UNION ALL SELECT rel_path, 'WARN', 'orphan' FROM docs WHERE render AND n NOT IN (SELECT t FROM edges WHERE NOT missing))
SELECT level, category, count(*) AS n FROM f GROUP BY ALL""")
def check_summary(spark, d):
    return checks.summary(checks.validate(linked_documents(spark, d)))


@query(f"""WITH {_DOCS} SELECT rel_path AS file, 2 AS line, 'broken internal link "/p/' || t || '.md' || CASE WHEN seq = 2 THEN '?q=1#f' ELSE '' END || '" -> "p/' || t || '.md"' AS message FROM edges WHERE missing""")
def broken_links(spark, d):
    return checks.broken_links(linked_documents(spark, d)).select("file", "line", "message")


_SIZE = "CASE WHEN size >= 1073741824 THEN printf('%.1f GB', size / 1073741824.0) ELSE printf('%.1f MB', size / 1048576.0) END"


@query(f"""WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 20 = 0 THEN 'IMG/' ELSE 'img/' END || (p_partkey // 21) || ['.bmp', '.png', '.xcf', '.TIFF', '.svg', ''][p_partkey % 6 + 1] AS path, p_partkey * 100000 AS size FROM part),
g AS (SELECT path, max(size) AS size FROM a GROUP BY path),
u AS (SELECT *, size % 1900000 = 0 AS symlink, '.' || regexp_extract(lower(path), '\\.([^./]*)$', 1) AS ext FROM g),
v AS (SELECT * FROM u WHERE NOT symlink),
t AS (SELECT *, min(path) OVER (PARTITION BY lower(path)) AS first FROM v)
SELECT path AS file, 'symlink in asset directory skipped: ' || path AS message FROM u WHERE symlink
UNION ALL SELECT path, 'asset case-collision / duplicate destination risk: "' || first || '" and "' || path || '" map to the same destination "' || lower(path) || '"' FROM t WHERE first <> path
UNION ALL SELECT path, 'unsupported or suspicious image extension "' || ext || '": prefer web-optimized formats (.png, .jpg, .webp, .svg, .avif)' FROM v WHERE ext IN ('.bmp', '.xcf', '.tiff')
UNION ALL SELECT path, 'unusually large raster asset (' || {_SIZE} || ' > 5.0 MB threshold)' FROM v WHERE size > 5242880 AND ext IN ('.bmp', '.png', '.tiff')""")
def asset_rules(spark, d):
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, (".bmp", ".png", ".xcf", ".TIFF", ".svg", ""))), (k % 6 + 1).cast("int"))
    path = F.concat(F.when(k % 20 == 0, "IMG/").otherwise("img/"), F.floor(k / 21), ext)
    assets = table(spark, d, "part").groupBy(path.alias("path")).agg(F.max(k * 100000).cast("long").alias("size")).withColumn("symlink", F.col("size") % 1900000 == 0)
    return checks.asset_files(assets).select("file", "message")


@query("""WITH r AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'img/' || p_partkey || '.png' WHEN 1 THEN 'IMG/' || (p_partkey - 1) || '.png' WHEN 2 THEN 'img/none' || p_partkey || '.png' ELSE '../x' || p_partkey END AS target FROM part)
SELECT 'd' || k AS file, CASE k % 4 WHEN 1 THEN 'referenced asset "/assets/' || target || '" has case mismatch with existing asset "img/' || (k - 1) || '.png"' WHEN 2 THEN 'missing referenced asset "/assets/' || target || '"' ELSE 'referenced asset path "/assets/' || target || '" escapes asset root' END AS message FROM r WHERE k % 4 <> 0""")
def asset_reference_rules(spark, d):
    k, part = F.col("p_partkey"), table(spark, d, "part")
    form = lambda fmt, c: F.format_string(fmt, c)
    target = F.when(k % 4 == 0, form("img/%d.png", k)).when(k % 4 == 1, form("IMG/%d.png", k - 1)).when(k % 4 == 2, form("img/none%d.png", k)).otherwise(form("../x%d", k))
    refs = part.select(F.concat(F.lit("d"), k).alias("file"), F.lit(1).alias("line"), F.concat(F.lit("/assets/"), target).alias("dest"), target.alias("target"))
    assets = part.filter(k % 4 == 0).select(F.format_string("img/%d.png", k).alias("path"))
    return checks.asset_references(refs, assets).select("file", "message")


@query(f"""WITH h AS ({_HREFS}), r AS (SELECT DISTINCT page_id, reference FROM h WHERE reference <> '' AND NOT regexp_matches(reference, '^(#|//|[a-zA-Z][a-zA-Z0-9+.-]*:)') AND regexp_replace(reference, '[?#].*$', '') <> ''),
t AS (SELECT *, CASE WHEN regexp_replace(reference, '[?#].*$', '') LIKE '/%' THEN substr(regexp_replace(reference, '[?#].*$', ''), 2) ELSE 'site/' || reference END AS target FROM r),
f AS (SELECT DISTINCT target || '/index.html' AS file FROM t WHERE length(target) % 2 = 0)
SELECT 'site/' || page_id || '.html' AS path, reference FROM t WHERE target NOT IN (SELECT file FROM f) AND NOT (regexp_matches(target, '(^|/)[^./]*$') AND target || '/index.html' IN (SELECT file FROM f))""")
def publish_missing_references(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("site/"), "page_id", F.lit(".html")).alias("path"), "html")
    refs = pages.select(F.explode(graph.html_references(F.col("html"))).alias("r")).filter(~paths.is_external(F.col("r")))
    p = paths.link_path(F.col("r"))
    target = F.when(p.startswith("/"), F.expr("substring(regexp_replace(r, '[?#].*$', ''), 2)")).otherwise(F.concat(F.lit("site/"), "r"))
    files = refs.filter((p != "") & (F.length(target) % 2 == 0)).select(F.concat(target, F.lit("/index.html")).alias("path")).distinct()
    return checks.missing_references(pages, files)


@query("SELECT path FROM (SELECT unnest(['sitemap.xml', 'robots.txt', 'search.json', 'graph.json', 'backlinks.json', 'meta.json']) AS path) WHERE path NOT IN (SELECT lower(r_name) || '.json' FROM region UNION SELECT 'graph.json' FROM nation WHERE n_nationkey = 0)")
def missing_artifacts(spark, d):
    files = table(spark, d, "region").select(F.concat(F.lower("r_name"), F.lit(".json")).alias("path")).union(table(spark, d, "nation").filter("n_nationkey = 0").select(F.lit("graph.json")))
    return checks.missing_artifacts(files)
