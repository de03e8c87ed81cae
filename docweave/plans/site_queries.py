"""Links, front matter, assets, output claims and site documents over tables made to break each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import paths, text
from docweave.operators import build, checks, graph, outputs, site
from docweave.plans.graph_queries import linked_documents
from docweave.plans.registry import query, table
from docweave.sources import bundles, commonmark, markdown, sinks
from docweave.storage import dealt

# --- Markdown links -------------------------------------------------------------------------------

_MARKDOWN = """[a][] ![i](i.png) and [B] then [c][b] `[code](no.md)` [t](p{n}.md "title") [x [in](in{n}.md) y](out.md) [none][] [none]

    [indented](no.md)

- item [l](l{n}.md)

```
[f](no.md)
```
<div>
[h](no.md)
</div>

[![p](j.png)](q{n}.md) \\[esc](no.md) <https://x.org/[u](no.md)>

[a]: one{n}.md
[b]: <two {n}.md> 'x'
"""


@query("""SELECT page_id, seq::INT AS seq, dest FROM (SELECT page_id, unnest(['one' || page_id || '.md', 'two ' || page_id || '.md', 'two ' || page_id || '.md', 'p' || page_id || '.md', 'in' || page_id || '.md', 'l' || page_id || '.md', 'q' || page_id || '.md']) AS dest, unnest(range(7)) AS seq FROM pages)""")
def markdown_links(spark, d):
    body = F.replace(F.lit(_MARKDOWN), F.lit("{n}"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", F.posexplode(graph.markdown_links(body)).alias("seq", "dest"))


@query("""SELECT page_id, seq::INT AS seq, dest, image FROM (SELECT page_id, unnest(['a.md', 'i' || page_id || '.png', 'b.md', 'j.png']) AS dest, unnest([false, true, false, true]) AS image, unnest(range(4)) AS seq FROM pages)""")
def markdown_references(spark, d):
    body = F.concat(F.lit("[a](a.md) ![i](i"), "page_id", F.lit(".png)\n\n[![x](j.png)](b.md)\n"))
    return table(spark, d, "pages").select("page_id", F.posexplode(commonmark.parsed_references(body)).alias("seq", "r")).select("page_id", "seq", "r.dest", "r.image")


# --- front matter ---------------------------------------------------------------------------------

_FRONT = [
    "---\ntitle: Page {n}\ndescription: about\ndate: 2024-01-02\ntags: [go, ok-1]\nslug: s{n}\n---\nbody\n",
    "---\ntitle: [unclosed\n---\nbody\n",
    "---\ntitle: T\ndescription: D\ndate: 2024-13-01\n---\nbody\n",
    "---\ntitle: T\ndescription: D\ntags: [Go Lang, ok]\ncategory: News!\n---\nbody\n",
    "---\nTITLE: upper\ntitle: lower\nrender: false\nslug: raw{n}\ncategories: [a, b]\ncategory: c\n---\nbody\n",
    "---\ntitle: T\ndescription: D\nslug: a.b/c\ntags: single\n---\nbody\n",
    "no front matter {n}\n",
    "---\ntitle: '  '\ndescription: D\ntags: [3, x, X]\nrender: maybe\n---\nbody\n",
]


def _front_files(spark, d):
    forms = F.array(*map(F.lit, _FRONT))
    n = F.col("page_id")
    content = F.replace(F.element_at(forms, (n % 8 + 1).cast("int")), F.lit("{n}"), n.cast("string"))
    return dealt(table(spark, d, "pages").select("page_id"), "page_id").select(F.format_string("f/%d.md", n).alias("rel_path"), content.alias("content"))


@query("""WITH k AS (SELECT page_id AS n, page_id % 8 AS k FROM pages)
SELECT 'f/' || n || '.md' AS rel_path,
 CASE k WHEN 0 THEN 'Page ' || n WHEN 4 THEN 'lower' WHEN 7 THEN '  ' WHEN 1 THEN '' WHEN 6 THEN '' ELSE 'T' END AS title,
 CASE k WHEN 0 THEN '2024-01-02' ELSE '' END AS date,
 CASE k WHEN 0 THEN 'go,ok-1' WHEN 3 THEN 'golang,ok' WHEN 5 THEN 'single' WHEN 7 THEN '3,x' ELSE '' END AS tags,
 CASE k WHEN 3 THEN 'news' WHEN 4 THEN 'a,b,c' ELSE '' END AS categories,
 CASE k WHEN 0 THEN 's' || n WHEN 4 THEN 'raw' || n WHEN 5 THEN 'a.b/c' ELSE '' END AS slug,
 CASE k WHEN 4 THEN false END AS render,
 CASE k WHEN 6 THEN 'no front matter ' || n || chr(10) WHEN 1 THEN '---' || chr(10) || 'title: [unclosed' || chr(10) || '---' || chr(10) || 'body' || chr(10) ELSE 'body' || chr(10) END AS body,
 k = 1 AS broken, CASE WHEN k IN (4, 7) THEN 1 ELSE 0 END AS n_warnings FROM k""")
def front_matter(spark, d):
    docs = markdown.documents(_front_files(spark, d))
    some = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    lists = [F.array_join(c, ",").alias(c) for c in ("tags", "categories")]
    return docs.select("rel_path", some("title"), some("date"), *lists, some("slug"), "render", "body", F.col("parse_error").isNotNull().alias("broken"), F.size("warnings").alias("n_warnings"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS type, p_partkey % 3 AS t, p_partkey // 3 % 6 AS g, p_partkey // 18 % 4 AS d, p_partkey // 72 % 4 AS r, p_partkey // 288 % 3 AS c FROM part)
SELECT 'v/' || k || '.md' AS rel_path, CASE t WHEN 0 THEN name || ' ' || k WHEN 1 THEN name ELSE '' END AS title,
 CASE g WHEN 1 THEN replace(lower(brand), '#', '') WHEN 2 THEN lower(type) || ',x-' || k WHEN 3 THEN 'ab,' || k WHEN 4 THEN k::VARCHAR ELSE '' END AS tags,
 CASE d WHEN 1 THEN '2024-0' || (k % 9 + 1) || '-1' || k % 9 ELSE '' END AS date, CASE r WHEN 1 THEN true WHEN 2 THEN false END AS render,
 CASE c WHEN 1 THEN lower(type) WHEN 2 THEN 'one,' || lower(type) || ',two' ELSE '' END AS categories,
 (t = 1)::INT + (g = 5)::INT + (r = 3)::INT AS n_warnings FROM p""")
def front_matter_variety(spark, d):
    docs = markdown.documents(varied_pages(spark, d))
    some = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select("rel_path", some("title"), F.array_join("tags", ",").alias("tags"), some("date"), "render", F.array_join("categories", ",").alias("categories"), F.size("warnings").alias("n_warnings"))


def varied_pages(spark, d):
    """Parts as pages, their blocks put together from independent forms of each field, keys in either order."""
    k, text = F.col("p_partkey"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    pick = lambda n, *forms: F.element_at(F.array(*[f if not isinstance(f, str) else F.lit(f) for f in forms]), (F.floor(k / n) % len(forms) + 1).cast("int"))
    title = pick(1, text("title: ", F.col("p_name"), " ", k, "\n"), text("Title: Upper\ntitle: ", F.col("p_name"), "\n"), "")
    tags = pick(3, "", text("tags: ", F.col("p_brand"), "\n"), text("tags: [", F.col("p_type"), ", x-", k, "]\n"), text("tags:\n  - A B\n  - ", k, "\n"), text("tags: ", k, "\n"), "tags: {a: 1}\n")
    date = pick(18, "", text("date: 2024-0", k % 9 + 1, "-1", k % 9, "\n"), text("date: 2024-02-3", k % 2, "\n"), 'date: "1/2/2024"\n')
    render = pick(72, "", "render: true\n", "render: false\n", "render: maybe\n")
    category = pick(288, "", text("category: ", F.col("p_type"), "\n"), text("categories: [One, ", F.col("p_type"), "]\ncategory: Two\n"))
    fields = F.when(k % 2 == 0, F.concat(title, tags, date, render, category)).otherwise(F.concat(category, render, date, tags, title))
    parts = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    return parts.select(text("v/", k, ".md").alias("rel_path"), F.concat(F.lit("---\n"), fields, F.lit("---\nbody\n")).alias("content"))


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS brand, p_type AS type, p_partkey % 3 AS t, p_partkey // 3 % 6 AS g, p_partkey // 18 % 4 AS d, p_partkey // 72 % 4 AS r, p_partkey // 288 % 3 AS c FROM part),
n AS (SELECT *, 'v/' || k || '.md' AS file, ([1, 2, 0])[t + 1] AS nt, ([0, 1, 1, 3, 1, 1])[g + 1] AS ng, (d > 0)::INT AS nd, (r > 0)::INT AS nr, c AS nc, k % 2 = 0 AS even, r <> 2 AS shown FROM p),
l AS (SELECT *, 2 + CASE WHEN even THEN nt + ng ELSE nc + nr END AS at_date, 2 + CASE WHEN even THEN nt ELSE nc + nr + nd END AS at_tags, 2 + CASE WHEN even THEN nt + ng + nd + nr ELSE 0 END + (c = 2)::INT AS at_category FROM n),
m AS (SELECT file, at_tags AS line, 'tag' AS what, CASE g WHEN 1 THEN brand WHEN 2 THEN type ELSE 'A B' END AS raw FROM l WHERE g IN (1, 2, 3)
 UNION ALL SELECT file, at_category, 'category', unnest(CASE c WHEN 1 THEN [type] ELSE ['One', type, 'Two'] END) FROM l WHERE c > 0)
SELECT file, at_date AS line, 'ERROR' AS level, 'invalid date format "' || CASE d WHEN 2 THEN '2024-02-3' || k % 2 ELSE '1/2/2024' END || '": must be YYYY-MM-DD' AS message FROM l WHERE d > 1
UNION ALL SELECT file, 0, 'WARN', 'missing title: <meta property="og:title"> will fallback to filename' FROM l WHERE shown AND t = 2
UNION ALL SELECT file, 0, 'WARN', 'missing description: page will use default_description if configured' FROM l WHERE shown
UNION ALL SELECT file, line, 'WARN', 'malformed ' || what || ' "' || raw || '" (normalized to "' || regexp_replace(lower(raw), '[^a-z0-9-]', '', 'g') || '")' FROM m""")
def frontmatter_rules_variety(spark, d):
    return checks.frontmatter(markdown.documents(varied_pages(spark, d))).select("file", "line", "level", "message")


@query("""WITH k AS (SELECT 'f/' || page_id || '.md' AS file, page_id AS n, page_id % 8 AS k FROM pages)
SELECT file, 1 AS line, 'ERROR' AS level, 'missing_metadata' AS category, 'invalid frontmatter' AS message FROM k WHERE k = 1
UNION ALL SELECT file, 4, 'ERROR', 'missing_metadata', 'invalid date format "2024-13-01": must be YYYY-MM-DD' FROM k WHERE k = 2
UNION ALL SELECT file, 4, 'WARN', 'missing_metadata', 'malformed tag "Go Lang" (normalized to "golang")' FROM k WHERE k = 3
UNION ALL SELECT file, 5, 'WARN', 'missing_metadata', 'malformed category "News!" (normalized to "news")' FROM k WHERE k = 3
UNION ALL SELECT file, 5, 'ERROR', 'missing_metadata', 'invalid render/slug combination: slug "raw' || n || '" specified when render is false' FROM k WHERE k = 4
UNION ALL SELECT file, 4, 'ERROR', 'missing_metadata', 'invalid slug "a.b/c": slug must be a simple local name without slashes or dots' FROM k WHERE k = 5
UNION ALL SELECT file, 4, 'WARN', 'missing_metadata', 'malformed tag "X" (normalized to "x")' FROM k WHERE k = 7
UNION ALL SELECT file, 0, 'WARN', 'missing_metadata', 'missing title: <meta property="og:title"> will fallback to filename' FROM k WHERE k IN (1, 6, 7)
UNION ALL SELECT file, 0, 'WARN', 'missing_metadata', 'missing description: page will use default_description if configured' FROM k WHERE k IN (1, 6)""")
def frontmatter_rules(spark, d):
    found = checks.frontmatter(markdown.documents(_front_files(spark, d)))
    return found.withColumn("message", F.regexp_replace("message", "(?s)^(invalid frontmatter): .*$", "$1"))


# --- assets of documents --------------------------------------------------------------------------

_BODY = """![one](/assets/img/{n}.png) ![two](img/near{n}.png "t") [pdf](/assets/doc{n}.pdf?v=1#p) [pic](../up{n}.SVG)
[page](other.md) [out](https://x.org/a.png) ![far](//x.org/b.png) ![enc](a%20b{n}.gif) ![away](../../../x{n}.png) [%2E](%2E%2E/y.png)
"""


def _asset_documents(spark, d):
    n = F.col("page_id").cast("string")
    body = F.replace(F.lit(_BODY), F.lit("{n}"), n)
    return markdown.from_table(table(spark, d, "pages"), F.concat(F.lit("d/"), n, F.lit(".md")), body, title=F.lit("T"), description=F.lit("D"))


_REFS = """r AS (SELECT 'd/' || page_id || '.md' AS file, page_id AS n, unnest(['/assets/img/' || page_id || '.png', 'img/near' || page_id || '.png', '/assets/doc' || page_id || '.pdf?v=1#p', '../up' || page_id || '.SVG', 'a%20b' || page_id || '.gif', '../../../x' || page_id || '.png', '%2E%2E/y.png']) AS dest,
 unnest(['img/' || page_id || '.png', 'd/img/near' || page_id || '.png', 'doc' || page_id || '.pdf', 'up' || page_id || '.SVG', 'd/a b' || page_id || '.gif', '../../x' || page_id || '.png', 'y.png']) AS target, unnest([1, 1, 1, 1, 2, 2, 2]) AS line FROM pages)"""


@query(f"WITH {_REFS} SELECT file, dest, target FROM r")
def asset_links(spark, d):
    return checks.asset_links(_asset_documents(spark, d))


@query(f"""WITH {_REFS}, a AS (SELECT CASE page_id % 3 WHEN 0 THEN 'img/' WHEN 1 THEN 'IMG/' ELSE 'none/' END || page_id || '.png' AS path FROM pages UNION ALL SELECT 'doc' || page_id || '.pdf' FROM pages),
f AS (SELECT lower(path) AS low, min(path) AS actual FROM a GROUP BY ALL)
SELECT file, line, 'WARN' AS level, 'asset_health' AS category, CASE WHEN target LIKE '..%' OR dest LIKE '%2E\\%2E%' ESCAPE '\\' THEN 'referenced asset path "' || dest || '" escapes asset root'
 WHEN actual IS NOT NULL THEN 'referenced asset "' || dest || '" has case mismatch with existing asset "' || actual || '"' ELSE 'missing referenced asset "' || dest || '"' END AS message
FROM r LEFT JOIN f ON lower(r.target) = f.low WHERE target NOT IN (SELECT path FROM a)
UNION ALL SELECT 'd/' || page_id || '.md', 0, 'WARN', 'orphan', 'orphaned page: no inbound links' FROM pages
UNION ALL SELECT 'd/' || page_id || '.md', 2, 'ERROR', 'broken_links', 'broken internal link "other.md" -> "d/other.md"' FROM pages""")
def lint_report(spark, d):
    """All rules over documents and assets."""
    n = F.col("page_id")
    img = F.concat(F.when(n % 3 == 0, "img/").when(n % 3 == 1, "IMG/").otherwise("none/"), n, F.lit(".png"))
    assets = table(spark, d, "pages").select(F.explode(F.array(img, F.concat(F.lit("doc"), n, F.lit(".pdf")))).alias("path")).withColumn("size", F.lit(10)).withColumn("symlink", F.lit(False))
    return checks.validate(_asset_documents(spark, d), assets)


@query(f"""WITH {_REFS} SELECT '[ERROR] d/' || page_id || '.md:2: broken internal link "other.md" -> "d/other.md"' AS value FROM pages
UNION ALL SELECT '[WARN] d/' || page_id || '.md: orphaned page: no inbound links' FROM pages
UNION ALL SELECT '✗ ' || count(*) || ' errors, ' || count(*) || ' warnings | ' || count(*) || ' orphaned pages, 0 missing descriptions, 0 missing dates' FROM pages""")
def lint_text(spark, d):
    found = checks.validate(_asset_documents(spark, d))
    return checks.report_lines(found).unionByName(checks.footer(found))


# --- who writes what ------------------------------------------------------------------------------


def _claiming_documents(spark, d):
    """Pages that meet each other (slugs), the explorer, taxonomy pages, stubs and assets, some by case only."""
    n = F.col("page_id")
    rel = F.when(n == 1, "graph/index.md").when(n == 2, "tags/t0/index.md").when(n % 10 == 4, F.format_string("assets/%d.md", n)).otherwise(F.format_string("p/%d.md", n))
    slug = F.when(n % 7 == 3, F.concat(F.lit("s"), (n % 4).cast("string"))).when(n % 7 == 5, F.concat(F.lit("S"), (n % 4).cast("string")))
    tags = F.when(n % 6 == 0, F.array(F.concat(F.lit("t"), (n % 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    return markdown.from_table(table(spark, d, "pages"), rel, F.lit(""), slug=slug, tags=tags, render=F.when(n % 11 == 10, F.lit(False)))


_CLAIMS = """d AS (SELECT page_id AS n, CASE WHEN page_id = 1 THEN 'graph/index.md' WHEN page_id = 2 THEN 'tags/t0/index.md' WHEN page_id % 10 = 4 THEN 'assets/' || page_id || '.md' ELSE 'p/' || page_id || '.md' END AS rel,
  CASE page_id % 7 WHEN 3 THEN 's' || page_id % 4 WHEN 5 THEN 'S' || page_id % 4 END AS slug FROM pages WHERE page_id % 11 <> 10),
o AS (SELECT n, rel, regexp_replace(rel, '[^/]*$', '') AS folder, CASE WHEN rel LIKE '%index.md' THEN 'index.html' ELSE coalesce(slug, regexp_extract(rel, '([^/]*)\\.md$', 1)) || '/index.html' END AS tail FROM d),
terms AS (SELECT DISTINCT 't' || page_id % 3 AS term FROM pages WHERE page_id % 6 = 0 AND page_id % 11 <> 10),
c AS (SELECT 0 AS phase, rel AS name, '"' || rel || '"' AS source, folder || tail AS path FROM o
 UNION ALL SELECT 1, p, 'the knowledge graph explorer (disable with graph_explorer: false)', p FROM (SELECT unnest(['graph/index.html', 'graph/data.json']) AS p)
 UNION ALL SELECT 2, 'tags/' || term || '/index.html', 'the generated taxonomy page', 'tags/' || term || '/index.html' FROM terms
 UNION ALL SELECT 2, 'tags/index.html', 'the generated taxonomy page', 'tags/index.html' FROM (SELECT 1 FROM terms LIMIT 1)
 UNION ALL SELECT 3, 'p/s' || page_id || '.md', 'the generated stub for "p/s' || page_id || '.md"', 'p/s' || page_id || '/index.html' FROM pages WHERE page_id < 6
 UNION ALL SELECT 4, 'assets/' || page_id || '/index.html', 'the asset "assets/' || page_id || '/index.html"', 'assets/' || page_id || '/index.html' FROM pages WHERE page_id % 2 = 0),
w AS (SELECT *, first(source) OVER e AS s1, first(phase) OVER e AS p1, first(name) OVER e AS n1, first(source) OVER f AS s2, first(phase) OVER f AS p2, first(name) OVER f AS n2, first(path) OVER f AS path2
 FROM c WINDOW e AS (PARTITION BY path ORDER BY phase, name), f AS (PARTITION BY lower(path) ORDER BY phase, name)),
x AS (SELECT *, (p1, n1) < (phase, name) AS taken, path2 <> path AND (p2, n2) < (phase, name) AS near FROM w)"""


@query(f"""WITH {_CLAIMS} SELECT phase, path, CASE WHEN taken THEN s1 ELSE s2 END AS first, CASE WHEN taken AND phase <> 3 THEN 'ERROR' ELSE 'WARN' END AS level,
 CASE WHEN taken THEN 'output path collision: ' || s1 || ' and ' || source || ' both map to "' || path || '"'
 ELSE 'output path warning: ' || s2 || ' maps to "' || path2 || '" and ' || source || ' maps to "' || path || '", which would be the same file on a case-insensitive filesystem' END AS message FROM x WHERE taken OR near""")
def output_collisions(spark, d):
    return outputs.collisions(_claims(spark, d))


@query(f"""WITH {_CLAIMS} SELECT phase, path, CASE WHEN phase <> 3 THEN 'ERROR' ELSE 'WARN' END AS level,
 CASE WHEN taken THEN 'output path collision: ' || s1 || ' and ' || source || ' both map to "' || path || '"'
 ELSE 'output path collision: ' || s2 || ' maps to "' || path2 || '" and ' || source || ' maps to "' || path || '", which are the same file on case-insensitive filesystems' END AS message FROM x WHERE taken OR near""")
def output_collisions_folded(spark, d):
    return outputs.collisions(_claims(spark, d), case_sensitive=False).drop("first")


def _claims(spark, d):
    pages = table(spark, d, "pages")
    missing = pages.filter("page_id < 6").select(F.format_string("p/s%d.md", "page_id").alias("target"))
    assets = pages.filter("page_id % 2 = 0").select(F.format_string("%d/index.html", "page_id").alias("path"))
    return outputs.claims(_claiming_documents(spark, d), True, missing, assets)


@query("""WITH f AS (SELECT doc_id, ['graph.json', 'meta.json', 'graph/index.html', 'site/a.html', 'site/b/index.html', 'x' || doc_id || '.css'][doc_id % 6 + 1] AS path FROM documents),
p AS (SELECT page_id, 'site/' || page_id || '.html' AS path, unnest(['b', 'a.html', 'b.html', '/gone' || page_id, 'c d.css', '../../up.css']) AS ref, unnest([true, true, true, false, false, false]) AS there FROM pages)
SELECT path || ' references missing local file "' || replace(ref, ' ', '%20') || '"' AS problem FROM p WHERE NOT there
UNION ALL SELECT 'publish artifact is missing required file "' || r || '"' FROM (SELECT unnest(['sitemap.xml', 'robots.txt', 'search.json', 'backlinks.json']) AS r)
UNION ALL SELECT 'publish artifact is missing required file "feed.xml": meta.json lists a dated rendered page' FROM (SELECT count(*) AS n FROM labels WHERE toxic = 1 AND quality = 0) WHERE n > 0
UNION ALL SELECT 'graph explorer is missing required artifact "' || r || '"' FROM (SELECT unnest(['graph/data.json', 'assets/graph/explorer.css', 'assets/graph/explorer.js']) AS r)""")
def publish_problems(spark, d):
    n = F.col("doc_id")
    names = F.array(*map(F.lit, ("graph.json", "meta.json", "graph/index.html", "site/a.html", "site/b/index.html")), F.format_string("x%d.css", n))
    files = table(spark, d, "documents").select(F.element_at(names, (n % 6 + 1).cast("int")).alias("path")).distinct()
    html = F.concat(F.lit('<a href="b">1</a><a href="a.html">2</a><a href="b.html#x">3</a><a href="/gone'), "page_id", F.lit('">4</a><link href="c%20d.css"><img src="../../up.css"><a href="https://x.org/">5</a><a href="#t">6</a><a href=" ">7</a>'))
    pages = table(spark, d, "pages").select(F.format_string("site/%d.html", "page_id").alias("path"), html.alias("html"))
    meta = table(spark, d, "labels").select((F.col("toxic") == 1).alias("render"), F.when(F.col("quality") == 0, "2024-01-01").otherwise(" ").alias("date"))
    return checks.publish_problems(files, pages, meta)


@query("SELECT 'site/' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '/.staging-1/a' WHEN 1 THEN '/.build-cache.json' ELSE '/x.css' END AS path, CASE p_partkey % 5 WHEN 0 THEN 'staging directory' WHEN 1 THEN 'cache file' ELSE 'symlink' END AS reason FROM part WHERE p_partkey % 5 < 3")
def forbidden_files(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("site/"), k, F.when(k % 5 == 0, "/.staging-1/a").when(k % 5 == 1, "/.build-cache.json").otherwise("/x.css"))
    return checks.forbidden_files(table(spark, d, "part").select(path.alias("path"), (k % 5 == 2).alias("symlink")))


@query("SELECT bool_or(toxic = 1 AND quality = 0) AS dated FROM labels")
def dated_pages(spark, d):
    return checks.dated_pages(table(spark, d, "labels").select((F.col("toxic") == 1).alias("render"), F.when(F.col("quality") == 0, "2024-01-01").otherwise(" ").alias("date")))


# --- documents of a site --------------------------------------------------------------------------

_LINKED = """docs AS (SELECT page_id AS n, page_id % 9 <> 0 AS render, CASE WHEN page_id % 9 = 0 THEN 'p/' || page_id || '.md' ELSE 'p/' || page_id END AS id,
 CASE WHEN page_id % 13 = 0 THEN page_id || '.md' ELSE 'Page ' || page_id END AS title, 'p/' || CASE WHEN page_id % 5 = 0 THEN 's' || page_id % 50 ELSE page_id::VARCHAR END || '/' AS url,
 CASE WHEN page_id % 3 = 0 THEN strftime(DATE '2024-01-01' + (page_id % 300)::INT, '%Y-%m-%d') END AS date FROM pages)"""


@query(f"""WITH {_LINKED} SELECT id, '{{' || CASE WHEN date IS NOT NULL THEN '"date":"' || date || '",' ELSE '' END || '"render":' || render || ',"title":"' || title || '"' || CASE WHEN render THEN ',"url":"/b/' || url || '"' ELSE '' END || ',"word_count":' || (9 + n % 17) || '}}' AS value FROM docs""")
def meta_document(spark, d):
    return site.page_meta(linked_documents(spark, d), "/b").select("id", F.to_json(build.meta_value()).alias("value"))


@query(f"""WITH {_LINKED} SELECT '    <item>' || chr(10) || '      <title>' || title || '</title>' || chr(10) || '      <link>https://x.org/b/' || url || '</link>' || chr(10) || '      <guid>https://x.org/b/' || url || '</guid>' || chr(10) || '      <pubDate>' || strftime(date::DATE, '%a, %d %b %Y 00:00:00 +0000') || '</pubDate>' || chr(10)
 || '      <description>Text no no' || chr(10) || '</description>' || chr(10) || '    </item>' AS value FROM docs WHERE render AND date IS NOT NULL""".replace("Text no no' || chr(10) || '", "Text no no x x x x out frag' || repeat(' w', n % 17) || '"))
def feed_document(spark, d):
    return sinks.rss_items(site.feed(site.feed_pages(linked_documents(spark, d), "https://x.org/b/")))


@query(f"""WITH {_LINKED} SELECT DISTINCT '  <url>' || chr(10) || '    <loc>https://x.org/b/' || url || '</loc>' || chr(10) || '  </url>' AS value FROM docs WHERE render""")
def sitemap_document(spark, d):
    docs = linked_documents(spark, d)
    return sinks.sitemap_items(site.sitemap(site.sitemap_locations(docs, "https://x.org/b"), docs.select(F.lit("").alias("loc")).limit(0)))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 <> 0 AS render, regexp_replace(lower(p_type), '[^a-z0-9-]', '', 'g') AS tag, regexp_replace(lower(p_brand), '[^a-z0-9-]', '', 'g') AS cat FROM part)
SELECT '/parts/p' || p_partkey || '/' AS loc FROM p WHERE render UNION SELECT '/tags/' || tag || '/' FROM p WHERE render UNION SELECT '/categories/' || cat || '/' FROM p WHERE render UNION SELECT '/tags/' UNION SELECT '/categories/'""")
def sitemap_locations(spark, d):
    from docweave.plans.text_queries import part_documents

    return site.sitemap_locations(part_documents(spark, d))


@query("""WITH p AS (SELECT p_partkey % 5 <> 0 AS render, p_type AS tag, p_brand AS cat FROM part)
SELECT (SELECT count(*) FROM p WHERE render) + (SELECT count(DISTINCT tag) + count(DISTINCT cat) + 2 FROM p WHERE render) AS pages""")
def page_count(spark, d):
    from docweave.plans.text_queries import part_documents

    return site.page_count(part_documents(spark, d))


@query("""WITH p AS (SELECT p_partkey, p_name, p_partkey % 5 <> 0 AS render, regexp_replace(lower(p_type), '[^a-z0-9-]', '', 'g') AS tag, regexp_replace(lower(p_brand), '[^a-z0-9-]', '', 'g') AS cat FROM part WHERE p_partkey % 5 <> 0)
SELECT 'tag' AS kind, tag AS term, 'parts/p' || p_partkey || '.md' AS rel_path, p_name AS title, '../../parts/p' || p_partkey || '/' AS link FROM p UNION ALL SELECT 'category', cat, 'parts/p' || p_partkey || '.md', p_name, '../../parts/p' || p_partkey || '/' FROM p""")
def taxonomy_links(spark, d):
    from docweave.plans.text_queries import part_documents

    return site.taxonomy_links(part_documents(spark, d))


@query("""WITH docs AS (SELECT page_id AS n, page_id % 9 <> 0 AS render, 'p/' || CASE WHEN page_id % 9 = 0 THEN page_id || '.md' WHEN page_id % 5 = 0 THEN 's' || page_id % 50 || '/' ELSE page_id || '/' END AS out FROM pages),
links AS (SELECT DISTINCT n, t FROM (SELECT n, unnest([n * 7 % 200, (n * 7 + 1) % 200, n * 11 % 400]) AS t FROM docs))
SELECT 'p/' || t || '.md' AS target, 'p/' || t || '/index.html' AS path, 'p/' || n || '.md' AS parent, '../' || substr(out, 3) AS link FROM links JOIN docs USING (n) WHERE t NOT IN (SELECT n FROM docs)""")
def stub_parents(spark, d):
    docs = linked_documents(spark, d)
    return graph.stub_parents(docs, graph.missing_targets(docs))


@query("SELECT count(*) AS nodes, count(*) >= 500 AS large FROM part")
def large_site(spark, d):
    return graph.large_site(table(spark, d, "part").select(F.col("p_partkey").alias("id")))


@query("SELECT 'parts/p' || p_partkey AS id, p_name AS title FROM part WHERE p_name ILIKE '%gadget%' OR 'parts/p' || p_partkey ILIKE '%gadget%' ORDER BY 'parts/p' || p_partkey LIMIT 20")
def suggestions(spark, d):
    return site.suggestions(table(spark, d, "part").select(F.concat(F.lit("parts/p"), "p_partkey").alias("id"), F.col("p_name").alias("title")), " Gadget")


@query("""SELECT id, title FROM (SELECT p_brand || '/p' || p_partkey AS id, p_name AS title FROM part) WHERE contains(lower(title), 'widget') OR contains(lower(id), 'widget') ORDER BY id LIMIT 20""")
def suggestions_by_title(spark, d):
    items = table(spark, d, "part").select(F.concat("p_brand", F.lit("/p"), "p_partkey").alias("id"), F.col("p_name").alias("title"))
    return site.suggestions(items, " Widget ")


@query("SELECT row_number() OVER (ORDER BY n DESC, tag)::INT AS nth, tag, n FROM (SELECT regexp_replace(lower(p_type), '[^a-z0-9-]', '', 'g') AS tag, count(*) AS n FROM part GROUP BY tag)")
def tag_order(spark, d):
    from docweave.plans.text_queries import part_documents

    rows = site.tag_order(site.tag_counts(part_documents(spark, d))).collect()  # a handful of terms
    return spark.createDataFrame([(k, r["tag"], r["n"]) for k, r in enumerate(rows, 1)], "nth int, tag string, n long")


# --- addresses and listings -----------------------------------------------------------------------


@query("""SELECT doc_id, 'https://x.org/b/' || u AS canonical, '/' || u AS local FROM (SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN '/' || doc_id || '/' WHEN 1 THEN '/' ELSE '' END || CASE WHEN doc_id % 3 = 2 THEN '/a.html' ELSE '' END AS u FROM documents) WHERE u NOT LIKE '%.html'
UNION ALL SELECT doc_id, 'https://x.org/b/' || source || '/a.html', '/' || source || '/a/' FROM documents WHERE doc_id % 3 = 2""")
def page_addresses(spark, d):
    n = F.col("doc_id")
    out = F.concat("source", F.when(n % 3 == 0, F.format_string("/%d/index.html", n)).when(n % 3 == 1, "/index.html").otherwise("/a.html"))
    return table(spark, d, "documents").select("doc_id", paths.canonical_url(out, "https://x.org/b/").alias("canonical"), paths.local_url(out).alias("local"))


@query("SELECT l_orderkey || '-' || l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN 'rag-content' WHEN 1 THEN 'rag-system' WHEN 2 THEN 'rag-config' ELSE 'content' END AS kind FROM lineitem")
def bundle_kinds(spark, d):
    n = F.col("l_linenumber")
    name = F.when(n % 4 == 0, "a/rag-content.md").when(n % 4 == 1, "rag-system-2.md").when(n % 4 == 2, "x/y/rag-config.md").otherwise("rag-content/z.md")
    return table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), paths.bundle_kind(name).alias("kind"))


@query("SELECT 'src' || p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def missing_defaults(spark, d):
    return bundles.missing_defaults(table(spark, d, "part").select(F.concat(F.lit("src"), "p_partkey").alias("path")), table(spark, d, "supplier").select(F.concat(F.lit("src"), "s_suppkey").alias("path")))


@query("""SELECT event_id, k AS key, CASE k WHEN 'a' THEN '/' || event_type || '/' ELSE '' END AS url, CASE k WHEN 'a' THEN NULL ELSE event_type END AS title FROM events, (SELECT unnest(['a', 'b']) AS k)""")
def json_maps(spark, d):
    doc = F.concat(F.lit('{"a": {"url": "/'), "event_type", F.lit('/", "other": 1}, "b": {"url": "", "title": "'), "event_type", F.lit('"}}'))
    rows = table(spark, d, "events").select("event_id", doc.alias("doc"))
    one = bundles.json_map(rows, "doc", "url: string, title: string", "event_id")
    return one.select("event_id", "key", "value.url", "value.title")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE lang || ' > ' || source END AS label FROM documents")
def heading_labels(spark, d):
    trail = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array("lang")).otherwise(F.array("lang", "source"))
    return table(spark, d, "documents").select("doc_id", text.heading_label(trail, F.col("source")).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Big Thing ' || p_partkey || ' ' ELSE 'A b' END AS title FROM part")
def titles_from_ids(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", text.title_from_id(F.when(k % 2 == 0, F.format_string("x/__big--thing_%d-", k)).otherwise("a b.md")).alias("title"))
