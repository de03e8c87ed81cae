"""Bundles to chunks to prompts, and change requests with errors, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import answers, policy, retrieval
from docweave.plans.registry import query, table
from docweave.plans.retrieval_queries import POLICY, requests
from docweave.plans.text_queries import slug_sql
from docweave.sources import bundles


def _bundled(spark, d):
    """bundle, value: a bundle for each document, of three files: a page (raw, titled or neither), a listing, and a
    page that quotes the format."""
    n = F.col("doc_id")
    front = F.when(n % 3 == 0, F.concat(F.lit("---\ntitle: 'Doc "), n, F.lit("'\nother: x\n---\n"))).when(n % 7 == 1, F.lit("---\nRender: No\n---\n")).otherwise(F.lit("# Head line #\n"))
    body = F.concat(front, F.lit("\n## "), "source", F.lit("\n"), F.regexp_replace("text", r"\s+", " "), F.lit("\n"))
    page = F.concat(F.lit("content/"), "source", F.lit("/"), n, F.lit(".md"))
    quoting = F.concat(F.lit("see\n<file path=\"x\">\n<content>\n\\</content>\n</file> "), "lang")
    files = [(page, body), (F.lit("content/"), F.lit("content/a.md (size: 1 bytes)")), (F.format_string("content/q%d.md", n), quoting)]
    value = F.concat(*[bundles.file_block(p, b) for p, b in files])
    kind = F.when(n % 5 == 4, "rag-system").otherwise("rag-content")
    return table(spark, d, "documents").select(F.concat(kind, F.lit("-"), n, F.lit(".md")).alias("bundle"), value.alias("value"))


_BUNDLED = r"""f AS (SELECT doc_id AS n, CASE WHEN doc_id % 5 = 4 THEN 'rag-system' ELSE 'rag-content' END || '-' || doc_id || '.md' AS bundle, 'content/' || source || '/' || doc_id || '.md' AS page, lang, source,
 regexp_replace(text, '\s+', ' ', 'g') AS t,
 CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'title: ''Doc ' || doc_id || '''' || chr(10) || 'other: x' || chr(10) || '---' || chr(10) WHEN doc_id % 7 = 1 THEN '---' || chr(10) || 'Render: No' || chr(10) || '---' || chr(10) ELSE '# Head line #' || chr(10) END AS front FROM documents)"""


@query(f"""WITH {_BUNDLED}
SELECT bundle, page AS path, 0 AS nth, front || chr(10) || '## ' || source || chr(10) || t || chr(10) AS text FROM f
UNION ALL SELECT bundle, 'content/', 1, 'content/a.md (size: 1 bytes)' FROM f
UNION ALL SELECT bundle, 'content/q' || n || '.md', 2, 'see' || chr(10) || '<file path="x">' || chr(10) || '<content>' || chr(10) || '\\</content>' || chr(10) || '</file> ' || lang FROM f""".replace("'\\\\</content>'", "'\\</content>'"))
def bundle_files(spark, d):
    return bundles.parsed_bundles(_bundled(spark, d))


@query("""SELECT CASE k WHEN 1 THEN 'b-1' WHEN 2 THEN 'b-2' WHEN 3 THEN 'b-3' WHEN 4 THEN 'b-4' WHEN 0 THEN 'b-0' END AS bundle, n, k > 0 AS bad FROM (SELECT p_partkey % 5 AS k, count(*) AS n FROM part GROUP BY k)""")
def malformed_bundles(spark, d):
    k = F.col("p_partkey") % 5
    value = F.when(k == 0, '<file path="a">\n<content>\nx\n</content>\n</file>\n').when(k == 1, '<file path="a">\n<file path="b">\n').when(k == 2, "<file >\n").when(k == 3, '<file path="a">\n<content>\nx\n</file>\n').otherwise("")
    rows = bundles.parsed_bundles(table(spark, d, "part").select(F.concat(F.lit("b-"), k.cast("string")).alias("bundle"), value.alias("value")), keep_errors=True)
    return rows.groupBy("bundle").agg(F.count("*").alias("n"), F.bool_or(F.col("error").isNotNull()).alias("bad"))


_PAGES = f"""{_BUNDLED}, p AS (SELECT *, source || '/' || n AS page_id, CASE WHEN n % 3 = 0 THEN 'Doc ' || n WHEN n % 7 = 1 THEN '' ELSE 'Head line #' END AS title, n % 3 = 0 OR n % 7 <> 1 AS shown, n % 3 = 0 OR n % 7 = 1 AS fenced FROM f WHERE n % 5 <> 4),
c AS (SELECT page, page_id, title, 0 AS position, '' AS heading, '# Head line #' AS text FROM p WHERE shown AND NOT fenced
 UNION ALL SELECT page, page_id, title, CASE WHEN fenced THEN 0 ELSE 1 END, source, trim(t) FROM p WHERE shown
 UNION ALL SELECT 'content/q' || n || '.md', 'q' || n, '', 0, '', 'see' || chr(10) || '<file path="x">' || chr(10) || '<content>' || chr(10) || '\\</content>' || chr(10) || '</file> ' || lang FROM p)"""


@query(f"WITH {_PAGES} SELECT page_id || '#' || CASE WHEN heading = '' THEN 'h0' ELSE 'h' || (position + 1) || '-' || {slug_sql('heading')} END AS id, page AS source_path, title, heading AS heading_text, position::INT AS position, text, 'rag-content' AS source_kind FROM c")
def corpus_chunks(spark, d):
    return retrieval.corpus_chunks(bundles.parsed_bundles(_bundled(spark, d))).select("id", "source_path", "title", "heading_text", "position", "text", "source_kind")


@query(f"WITH {_PAGES} SELECT 'v1' AS version, (SELECT 2 * count(*) FROM f) AS documents, (SELECT 2 * count(*) FROM p) AS site_documents, (SELECT count(*) FROM c) AS chunks, true AS ready")
def corpus_report(spark, d):
    return retrieval.load_report(bundles.parsed_bundles(_bundled(spark, d)))


@query(r"""WITH h AS (SELECT conv_id AS question_id, turn + 1 AS rank, 'c' || turn AS id, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS title, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank)::VARCHAR AS key FROM h),
b AS (SELECT *, chr(10) || '[' || key || ']' || chr(10) || CASE WHEN length(t) <= 160 THEN t ELSE substr(t, 1, 159) || '…' END || chr(10) AS block FROM k WHERE rank <= 8),
m AS (SELECT question_id, string_agg('  [' || key || '] ' || CASE WHEN title <> '' THEN title ELSE id END || ' — H' || chr(10), '' ORDER BY rank) AS keys, string_agg(block, '' ORDER BY rank) AS blocks FROM b GROUP BY question_id)
SELECT conv_id AS question_id, 'Citation key map:' || chr(10) || coalesce(keys, '') || chr(10) || 'Source material:' || chr(10) || coalesce(blocks, '') || chr(10) || 'Question: what' || chr(10) || 'Answer:' AS prompt FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN m ON question_id = conv_id""")
def prompts(spark, d):
    turn = F.col("turn")
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), (turn + 1).alias("rank"), F.concat(F.lit("c"), turn).alias("id"), F.when(turn % 2 == 0, F.col("role")).otherwise("").alias("title"), F.lit("H").alias("heading"), "text")
    asked = hits.select("question_id").distinct().withColumn("question", F.lit(" what "))
    made = answers.prompt(hits, asked, 8, 1_000_000)
    return made.withColumn("prompt", F.regexp_replace("prompt", r"(?s)^.*?\n\n(?=Citation key map)", ""))


@query("""WITH r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 6 = 1)
SELECT k AS number, 'error' AS action, 'status 502' AS reason FROM r""")
def sync_errors(spark, d):
    k = F.col("number")
    pr = requests(spark, d).withColumn("error", F.when(k % 6 == 1, "status 502"))
    return policy.synced(pr, POLICY).filter("action = 'error'").select("number", "action", "reason")


@query("""SELECT '#' || o_orderkey || ' SKIP: author "bot-' || o_orderkey % 5 || '" not on bot allowlist' AS value FROM orders WHERE o_orderkey % 5 IN (0, 4) AND o_orderkey % 6 <> 1
UNION ALL SELECT '#' || o_orderkey || ' ERROR: status 502' FROM orders WHERE o_orderkey % 6 = 1""")
def sync_lines(spark, d):
    k = F.col("number")
    pr = requests(spark, d).withColumn("error", F.when(k % 6 == 1, "status 502")).filter((k % 6 == 1) | (k % 5).isin(0, 4))
    return policy.sync_lines(policy.synced(pr, POLICY))
