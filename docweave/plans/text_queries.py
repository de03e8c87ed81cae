"""Text, path and taxonomy functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import paths, text
from docweave.operators import site
from docweave.plans.registry import query, table
from docweave.sources import bundles

TOKENS_SQL = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: t <> '')"


@query(f"SELECT doc_id, len({TOKENS_SQL})::INT AS n_tokens FROM documents")
def tokenize_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> ''))::INT AS n_words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query("SELECT doc_id, (octet_length(encode(text)) // 4)::BIGINT AS estimate FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("estimate"))


@query("SELECT sum(octet_length(encode(text)) // 4)::BIGINT AS estimate FROM documents")
def corpus_token_estimate(spark, d):
    return table(spark, d, "documents").agg(F.sum(text.token_estimate(F.col("text"))).alias("estimate"))


def _excerpt_sql(n: int) -> str:
    return rf"SELECT doc_id, CASE WHEN length(c) <= {n} THEN c ELSE substr(c, 1, {n - 1}) || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)"


@query(_excerpt_sql(120))
def excerpt_120(spark, d):
    return table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), 120).alias("excerpt"))


@query(_excerpt_sql(200))
def excerpt_200(spark, d):
    return table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), 200).alias("excerpt"))


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 39) || '…' END AS short FROM documents")
def truncate_40(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 40).alias("short"))


_NAMES = "|".join(text.ELEMENTS)
_TAGS = rf"(?i)</?(?:(?:{_NAMES})(?:[^a-z0-9<>\n-][^<>\n]*)?|[a-z][a-z0-9-]*[^<>\n]*\s[a-z_:][-a-z0-9_:.]*\s*=\s*\"[^\"<>\n]*\"[^<>\n]*)>".replace('\\"', '"')


@query(rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)```[^\n]*\n.*?```', '', 'g') AS s FROM pages),
b AS (SELECT page_id, regexp_replace(s, '!?\[([^\]]*)\]\([^)]+\)', '\1', 'g') AS s FROM a),
c AS (SELECT page_id, regexp_replace(s, '(?s)<!--.*?-->|<![^<>]*>|<\?[^<>]*>', '', 'g') AS s FROM b),
t AS (SELECT page_id, regexp_replace(s, '{_TAGS}', '', 'g') AS s FROM c),
q AS (SELECT page_id, regexp_replace(s, '(?m)^[ \t]*>+[ \t]?', '', 'g') AS s FROM t),
r AS (SELECT page_id, trim(regexp_replace(regexp_replace(s, '[#*\[\]`_~]', '', 'g'), '\s+', ' ', 'g')) AS s FROM q)
SELECT page_id, CASE WHEN length(s) > 160 THEN substr(s, 1, 160) || '...' ELSE s END AS snippet FROM r
""")
def snippet_160(spark, d):
    return table(spark, d, "pages").select("page_id", text.snippet(F.col("html")).alias("snippet"))


_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_SLUG48 = "(CASE WHEN {0} = '' THEN 'section' ELSE regexp_replace(substr({0}, 1, 48), '-+$', '') END)"


def slug_sql(expr: str) -> str:
    return _SLUG48.format(_SLUG.format(expr))


@query(f"SELECT doc_id, {slug_sql('text')} AS slug FROM documents")
def heading_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query(f"SELECT doc_id, source || '/' || lang || '/' || doc_id || '#' || CASE WHEN doc_id % 4 = 0 THEN 'h0' ELSE 'h' || (doc_id % 7 + 1) || '-' || {slug_sql('text')} END AS chunk_id FROM documents")
def chunk_id(spark, d):
    page = paths.corpus_page_id(F.concat(F.lit("content/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit(".md")))
    heading = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", paths.chunk_id(page, F.col("doc_id") % 7, heading).alias("chunk_id"))


_NORM = "(CASE WHEN regexp_matches(trim({0}), '^[a-z0-9-]+$') THEN trim({0}) ELSE regexp_replace(lower(trim({0})), '[^a-z0-9-]', '', 'g') END)"


@query(f"SELECT p_partkey, {_NORM.format('p_type')} AS tag, {_NORM.format('p_brand')} AS category, {_NORM.format('p_name')} AS name FROM part")
def taxonomy_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", *[text.taxonomy_value(F.col(c)).alias(n) for c, n in (("p_type", "tag"), ("p_brand", "category"), ("p_name", "name"))])


def part_documents(spark, d):
    """Parts as documents: their type is a tag (twice), their brand a category; every fifth is raw."""
    part = table(spark, d, "part")
    one = lambda c: text.taxonomy_list(F.array(c))
    return part.select(F.format_string("parts/p%d.md", "p_partkey").alias("rel_path"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("slug"), F.when(F.col("p_partkey") % 5 == 0, F.lit(False)).alias("render"), text.taxonomy_list(F.array("p_type", "p_type")).alias("tags"), one(F.col("p_brand")).alias("categories"), F.concat(F.lit("## "), F.col("p_name"), F.lit("\n\nmade by *"), F.col("p_brand"), F.lit("*")).alias("body"))


_PARTS = f"parts AS (SELECT p_partkey, 'parts/p' || p_partkey || '.md' AS rel_path, p_name, p_brand, p_partkey % 5 <> 0 AS render, {_NORM.format('p_type')} AS tag, {_NORM.format('p_brand')} AS category FROM part)"


@query(f"WITH {_PARTS}, t AS (SELECT 'tag' AS kind, tag AS term, rel_path FROM parts WHERE render UNION ALL SELECT 'category', category, rel_path FROM parts WHERE render) SELECT kind, term, string_agg(DISTINCT rel_path, ',' ORDER BY rel_path) AS pages FROM t GROUP BY ALL")
def taxonomy_groups(spark, d):
    return site.taxonomy_groups(part_documents(spark, d)).select("kind", "term", F.array_join("pages", ",").alias("pages"))


@query(f"WITH {_PARTS} SELECT tag, count(*) AS n FROM parts GROUP BY tag")
def top_tags(spark, d):
    return site.tag_counts(part_documents(spark, d))


@query(f"""
WITH {_PARTS}, i AS (
  SELECT p_name AS t, '/parts/p' || p_partkey || '/' AS u, tag || ',' || category AS g, p_name || ' made by ' || replace(p_brand, '#', '') AS s, p_name AS h FROM parts WHERE render
  UNION ALL SELECT DISTINCT 'Tag: ' || tag, '/tags/' || tag || '/', tag, '', '' FROM parts WHERE render
  UNION ALL SELECT DISTINCT 'Category: ' || category, '/categories/' || category || '/', category, '', '' FROM parts WHERE render
  UNION ALL SELECT 'Tags', '/tags/', '', '', '' UNION ALL SELECT 'Categories', '/categories/', '', '', '')
SELECT * FROM i""")
def search_index(spark, d):
    return site.search_index(part_documents(spark, d)).select("t", "u", F.array_join("g", ",").alias("g"), "s", F.array_join("h", ",").alias("h"))


@query(f"""
WITH {_PARTS}, i AS (
  SELECT p_name AS t, '/parts/p' || p_partkey || '/' AS u, p_name AS section FROM parts WHERE render AND p_name ILIKE '%widget%')
SELECT t, u, section FROM i ORDER BY u, t LIMIT 7""")
def search_filter(spark, d):
    return site.search(site.search_index(part_documents(spark, d)), " Widget ").select("t", "u", "section")


@query("""
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN source || '/' || doc_id || '.md'
  WHEN doc_id % 7 = 0 THEN source || '/index.html'
  WHEN doc_id % 3 = 0 THEN source || '/s-' || doc_id || '/index.html'
  ELSE source || '/' || doc_id || '/index.html' END AS output,
  CASE WHEN doc_id % 10 = 0 THEN '/b/' || source || '/' || doc_id || '.md'
  WHEN doc_id % 7 = 0 THEN '/b/' || source || '/'
  WHEN doc_id % 3 = 0 THEN '/b/' || source || '/s-' || doc_id || '/'
  ELSE '/b/' || source || '/' || doc_id || '/' END AS public,
  CASE WHEN doc_id % 10 <> 0 AND doc_id % 7 = 0 THEN source || '/index' WHEN doc_id % 10 = 0 THEN source || '/' || doc_id || '.md' ELSE source || '/' || doc_id END AS page_id
FROM documents""")
def output_paths(spark, d):
    name = F.when((F.col("doc_id") % 10 != 0) & (F.col("doc_id") % 7 == 0), "index").otherwise(F.col("doc_id").cast("string"))
    rel, render = F.concat("source", F.lit("/"), name, F.lit(".md")), F.col("doc_id") % 10 != 0
    slug = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("s-"), "doc_id")).when(F.col("doc_id") % 3 == 1, F.lit("../x")).otherwise("")
    out = paths.output_path(rel, slug, render)
    return table(spark, d, "documents").select("doc_id", out.alias("output"), paths.public_path(out, "/b").alias("public"), paths.page_id(rel, render).alias("page_id"))


@query(r"SELECT page_id, rtrim(lower(trim(url)), '/') AS normal, regexp_matches(url, '^https?://[^/?#@\s]+(/[^?#\s]*)?$') AS valid_site, regexp_matches(url, '^(#|//|[a-zA-Z][a-zA-Z0-9+.-]*:)') AS external FROM pages")
def url_checks(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", text.normal_url(u).alias("normal"), paths.valid_site(u).alias("valid_site"), paths.is_external(u).alias("external"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def titles_from_names(spark, d):
    return table(spark, d, "part").select("p_partkey", text.title_from_name(F.concat(F.lit("parts/"), F.regexp_replace("p_name", " ", "-"), F.lit(".md"))).alias("title"))


@query("""SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0)
  WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%d B', n) END AS size FROM (SELECT doc_id, octet_length(encode(text)) * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 300000 END AS n FROM documents)""")
def byte_sizes(spark, d):
    n = F.octet_length(F.col("text")) * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1000).otherwise(300000).cast("long")
    return table(spark, d, "documents").select("doc_id", text.byte_size(n).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN strftime(ts, '%Y-%m-%d') END AS valid FROM events")
def strict_dates(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    forms = [day, day, F.concat(day, F.lit("x")), F.lit("2023-02-30"), F.lit("2023-1-5")]
    raw = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", text.valid_date(raw).alias("valid"))


def markdown_body():
    """A Markdown page from a document: headings, a fence with a false heading, a repeated heading."""
    fence = F.lit("```\n# not a heading\n```\n")
    return F.concat(F.lit("# "), "source", F.lit(" [*"), "lang", F.lit("*](x.md) #\n\n"), F.col("text"), F.lit("\n\n## Part _one_\n"), fence, F.col("text"), F.lit("\n\n### <b>Two</b> "), "doc_id", F.lit("\n\n#### Part one\n\nend\n"))


@query("SELECT doc_id, source || ' ' || lang || '|Part one|Two ' || doc_id AS headings FROM documents")
def headings(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.headings(markdown_body()), "|").alias("headings"))


@query(r"""SELECT doc_id, md5('<file path="' || doc_id || '">' || chr(10) || '\</content>' || chr(10) || text || chr(10) || '\\<content>x') AS plain_md5,
  md5('\<file path="' || doc_id || '">' || chr(10) || '\\</content>' || chr(10) || text || chr(10) || '\\\<content>x') AS escaped_md5, true AS same FROM documents""")
def archive_roundtrip(spark, d):
    body = F.concat(F.lit('<file path="'), "doc_id", F.lit('">\n\\</content>\n'), "text", F.lit("\n\\\\<content>x"))
    escaped = text.escape_lines(body)
    return table(spark, d, "documents").select("doc_id", F.md5(body).alias("plain_md5"), F.md5(escaped).alias("escaped_md5"), (text.unescape_lines(escaped) == body).alias("same"))


@query("SELECT 'content/' || source || '/' || doc_id || '.md' AS path FROM documents WHERE lang <> 'de' AND (doc_id % 2 = 0 OR source = 'src3') ")
def bundle_selection(spark, d):
    doc = table(spark, d, "documents")
    ext = F.when((F.col("doc_id") % 2 == 0) | (F.col("source") == "src3"), ".md").otherwise(".txt")
    top = F.when(F.col("lang") == "de", "node_modules").otherwise("content")
    files = doc.select(F.concat(top, F.lit("/"), "source", F.lit("/"), "doc_id", ext).alias("path"))
    return bundles.selected(files.union(files), ["**/*.md", "content/src3/*.md"], ["drafts/"])


@query("SELECT 'a/' || source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.tmp' WHEN 1 THEN '.go' ELSE '.png' END AS path, CASE WHEN doc_id % 4 = 1 THEN true WHEN source = 'src2' THEN true WHEN doc_id % 4 = 0 THEN source <> 'src4' ELSE false END AS ignored FROM documents")
def ignore_rules(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".tmp", ".go", ".png", ".png"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("a/"), "source", F.lit("/"), "doc_id", ext)
    rules = bundles.ignore_rules(["# rules", "*.tmp", "!a/src4/*.tmp", "src2/", "", "/nowhere/**/x"])
    return table(spark, d, "documents").select(path.alias("path"), bundles.ignored(path, rules).alias("ignored"))


@query("""WITH f AS (SELECT source, doc_id, octet_length(encode(text)) AS n FROM documents)
SELECT 'content/' AS value UNION ALL SELECT DISTINCT 'content/' || source || '/' FROM f UNION ALL SELECT 'content/' || source || '/' || doc_id || '.md (size: ' || n || ' bytes)' FROM f""")
def inventory(spark, d):
    return bundles.inventory(table(spark, d, "documents").select(F.concat(F.lit("content/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.octet_length("text").alias("length")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '../' || lang || '/' ELSE './' END AS link FROM documents")
def relative_links(spark, d):
    here = F.concat("source", F.lit("/a/index.html"))
    there = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("/"), "lang", F.lit("/index.html"))).otherwise(here)
    return table(spark, d, "documents").select("doc_id", paths.relative_link(here, there).alias("link"))


@query("SELECT doc_id, 'see ![](https://emojik.vercel.app/s/1f600_1f480) ' || source AS body FROM documents")
def emoji_mashups(spark, d):
    return table(spark, d, "documents").select("doc_id", text.emoji_mashups(F.concat(F.lit("see !ek[😀+💀] "), "source")).alias("body"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'acme/' || source ELSE 'acme/' || source || '.x' END AS repo FROM documents")
def owner_repo(spark, d):
    remote = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("git@example.com:acme/"), "source", F.lit(".git"))).otherwise(F.concat(F.lit("https://example.com/acme/"), "source", F.lit(".x/")))
    return table(spark, d, "documents").select("doc_id", paths.owner_repo(remote).alias("repo"))
