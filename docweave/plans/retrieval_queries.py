"""Retrieval, answers, manifests, change streams and policy over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import answers, manifest, policy, retrieval
from docweave.plans.registry import query, table
from docweave.plans.text_queries import TOKENS_SQL, slug_sql
from docweave.streaming import changes

FLAGSHIP = "the thing is ation"


def token_docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))


_DOCS = f"docs AS (SELECT doc_id AS id, {TOKENS_SQL} AS tokens FROM documents), stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM docs)"
_POST = "flat AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM docs), post AS (SELECT term, id, dl, count(*) AS tf FROM flat GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
_GAIN = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))"


@query(f"WITH {_DOCS}, {_POST} SELECT term, id, tf FROM post")
def postings(spark, d):
    return retrieval.postings(token_docs(spark, d))


@query(f"WITH {_DOCS}, {_POST} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, stats")
def term_idf(spark, d):
    return retrieval.term_idf(token_docs(spark, d)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_DOCS} SELECT id, len(tokens)::BIGINT AS doc_len FROM docs")
def doc_lengths(spark, d):
    return retrieval.doc_lengths(token_docs(spark, d))


@query(f"WITH {_DOCS} SELECT n, round(avg_len, 6) AS avg_len FROM stats")
def corpus_stats(spark, d):
    return retrieval.corpus_stats(token_docs(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


@query(f"""WITH {_DOCS}, {_POST}, q AS (SELECT unnest(string_split('{FLAGSHIP}', ' ')) AS term),
s AS (SELECT id, sum({_GAIN}) AS score FROM q JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY id)
SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 8""")
def bm25_topk(spark, d):
    return retrieval.rank_one(token_docs(spark, d), FLAGSHIP, 8).withColumn("score", F.round("score", 6))


@query(f"""WITH {_DOCS}, {_POST}, q AS (SELECT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT query_id, id, sum(times * {_GAIN}) AS score FROM qt JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, id, round(score, 5) AS score FROM r WHERE rank <= 5""")
def bm25_batch(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.rank_batch(token_docs(spark, d), asked, 5).withColumn("score", F.round("score", 5)).select("query_id", "rank", "id", "score")


def sectioned(spark, d):
    """Documents as pages with a blank or non-blank prelude and three headings."""
    start = F.when(F.col("doc_id") % 2 == 0, F.lit("\n \n")).otherwise(F.concat(F.col("text"), F.lit("\n")))
    body = F.concat(start, F.lit("## "), "source", F.lit(" One ##\n"), F.col("text"), F.lit("\n### Two "), "lang", F.lit("\n"), F.lit("\n#### Three\nlast words\n"))
    body = F.when(F.col("doc_id") % 10 == 3, F.col("text")).otherwise(body)
    flat = F.regexp_replace(body, "[\r\x0b\x0c]", " ")
    return table(spark, d, "documents").select(F.format_string("content/%s/%d.md", "source", "doc_id").alias("source_path"), F.concat(F.lit("T"), "doc_id").alias("title"), flat.alias("body"))


_SECTIONS = rf"""base AS (SELECT doc_id, source, lang, text AS t77, text AS t50, text AS t100, source || '/' || doc_id AS page_id FROM documents),
c AS (
 SELECT page_id, 0 AS position, '' AS heading, t77 AS section, t77 AS inner_text, '' AS trail FROM base WHERE doc_id % 10 = 3
 UNION ALL SELECT page_id, 0, '', t50 || chr(10), t50, '' FROM base WHERE doc_id % 10 <> 3 AND doc_id % 2 = 1
 UNION ALL SELECT page_id, doc_id % 2, source || ' One', '## ' || source || ' One ##' || chr(10) || t100 || chr(10), t100, source || ' One' FROM base WHERE doc_id % 10 <> 3
 UNION ALL SELECT page_id, doc_id % 2 + 1, 'Two ' || lang, '### Two ' || lang || chr(10) || chr(10), '', 'Two ' || lang || '>' || source || ' One' FROM base WHERE doc_id % 10 <> 3
 UNION ALL SELECT page_id, doc_id % 2 + 2, 'Three', '#### Three' || chr(10) || 'last words' || chr(10), 'last words', 'Three>Two ' || lang FROM base WHERE doc_id % 10 <> 3)"""


@query(f"WITH {_SECTIONS} SELECT page_id || '#' || CASE WHEN heading = '' THEN 'h0' ELSE 'h' || (position + 1) || '-' || {slug_sql('heading')} END AS id, page_id, '/' || page_id || '/' AS url, position::INT AS position, trim(inner_text, ' ' || chr(10)) AS text, (octet_length(encode(section)) // 4)::BIGINT AS token_count FROM c")
def chunk_sections(spark, d):
    return retrieval.chunks(sectioned(spark, d)).select("id", "page_id", "url", "position", "text", "token_count")


@query(f"WITH {_SECTIONS} SELECT page_id, position::INT AS position, trail FROM c")
def heading_trail(spark, d):
    return retrieval.chunks(sectioned(spark, d)).select("page_id", "position", F.array_join("heading_path", ">").alias("trail"))


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 THEN '/q/' || d.doc_id || '/' ELSE '/' || d.source || '/' || d.doc_id || '/' END AS url,
 CASE WHEN d.doc_id % 3 <> 0 THEN 'T' || d.doc_id WHEN l.quality IS NOT NULL THEN 'meta' || l.toxic WHEN d.lang = 'en' THEN 'found' || d.doc_id ELSE '' END AS title
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def enrich_chunks(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    chunk = docs.select(F.col("doc_id").alias("page_id"), F.format_string("/%s/%d/", "source", "doc_id").alias("url"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("T"), "doc_id")).otherwise("").alias("title"))
    meta = labels.select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 1, F.format_string("/q/%d/", "doc_id")).otherwise("").alias("meta_url"), F.concat(F.lit("meta"), "toxic").alias("meta_title"))
    even = docs.filter("lang = 'en'").select(F.format_string(" /%s/%d", F.upper("source"), "doc_id").alias("url"), F.explode(F.array(F.struct(F.lit(1).alias("nth"), F.lit("old").alias("search_title")), F.struct(F.lit(2).alias("nth"), F.concat(F.lit("found"), "doc_id").alias("search_title")))).alias("e")).select("url", "e.*")
    return retrieval.enrich(chunk, meta, even).select(F.col("page_id").alias("doc_id"), "url", "title")


def cited_turns(spark, d):
    turn, conv = F.col("turn"), F.col("conv_id")
    marks = F.concat(F.lit(" [1] [ "), (turn % 12).cast("string"), F.lit(" ] [01] ["), (conv % 20).cast("string"), F.lit("] [1]"))
    return table(spark, d, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("question_id"), conv.alias("conv_id"), turn.alias("turn"), F.concat("text", marks).alias("answer"))


_CITED = r"cited AS (SELECT conv_id || '-' || turn AS question_id, list_distinct(k) AS d, k, conv_id, turn FROM (SELECT conv_id, turn, regexp_extract_all(text || ' [1] [ ' || (turn % 12) || ' ] [01] [' || (conv_id % 20) || '] [1]', '\[\s*([0-9]+)\s*\]', 1) AS k FROM conversations)), keys AS (SELECT question_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS keys FROM cited)"


@query(f"WITH {_CITED} SELECT question_id, array_to_string(list_filter(keys, lambda x: x::BIGINT BETWEEN 1 AND 8), ',') AS verified, array_to_string(list_filter(keys, lambda x: x::BIGINT NOT BETWEEN 1 AND 8), ',') AS dropped FROM keys")
def citation_verify(spark, d):
    return answers.verify(cited_turns(spark, d), F.lit(8)).select("question_id", F.array_join("verified", ",").alias("verified"), F.array_join("dropped", ",").alias("dropped"))


@query("SELECT conv_id AS question_id, turn AS rank, least(row_number() OVER (PARTITION BY conv_id ORDER BY turn), 999)::VARCHAR AS key FROM conversations")
def citation_keys(spark, d):
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"))
    return answers.citation_keys(hits)


@query(f"""WITH {_CITED}, v AS (SELECT question_id, unnest(ks) AS key, unnest(range(len(ks))) AS nth FROM (SELECT question_id, list_filter(keys, lambda x: x::BIGINT BETWEEN 1 AND 8) AS ks FROM keys))
SELECT question_id, nth::INT AS nth, key, 'chunk' || key::BIGINT AS id FROM v""")
def source_cards(spark, d):
    asked = answers.verify(cited_turns(spark, d), F.lit(8))
    hits = asked.select("question_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank")).withColumn("id", F.concat(F.lit("chunk"), "rank"))
    return answers.source_cards(asked, answers.citation_keys(hits))


@query(r"""WITH h AS (SELECT conv_id AS question_id, turn + 1 AS rank, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM conversations),
b AS (SELECT question_id, rank, chr(10) || '[' || rank || ']' || chr(10) || CASE WHEN length(c) <= 160 THEN c ELSE substr(c, 1, 159) || '…' END || chr(10) AS block FROM h WHERE rank <= 8),
u AS (SELECT *, octet_length(encode(block)) AS n, coalesce(sum(octet_length(encode(block))) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
SELECT question_id, rank, used::BIGINT AS used, least(n, 400 - used)::BIGINT AS kept_bytes FROM u WHERE used < 400""")
def prompt_budget(spark, d):
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), (F.col("turn") + 1).alias("rank"), "text")
    return answers.prompt_blocks(hits, 8, 400).select("question_id", "rank", F.col("used").cast("long").alias("used"), F.col("kept_bytes").cast("long").alias("kept_bytes"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'error' WHEN turn % 5 = 3 THEN 'no_answer' WHEN conv_id % 3 = 1 AND turn % 2 = 0 THEN 'no_answer' ELSE 'answered' END AS status FROM conversations""")
def answer_status(spark, d):
    turn, conv = F.col("turn"), F.col("conv_id")
    answer = F.when(conv % 3 == 0, F.concat("text", F.lit(" [1]"))).when((conv % 3 == 1) & (turn % 2 == 0), F.col("text")).otherwise(F.lit("I don't know."))
    rows = table(spark, d, "conversations").withColumn("answer", answer).withColumn("question", F.when(turn % 5 == 4, "  ").otherwise(F.col("text"))).withColumn("hits", F.when(turn % 5 == 3, 0).otherwise(5))
    rows = answers.verify(rows, F.col("hits"))
    return rows.select("conv_id", "turn", answers.status(F.col("question"), F.col("hits"), F.col("answer"), F.col("verified")).alias("status"))


# --- manifests and change streams -----------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return manifest.manifest(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@query("SELECT doc_id::VARCHAR AS path, CASE WHEN source = 'src1' THEN 'added' WHEN source = 'src2' THEN 'removed' ELSE 'modified' END AS change FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def manifest_diff(spark, d):
    docs, k = table(spark, d, "documents"), F.col("source")
    of = lambda df, body: manifest.manifest(df.select(F.col("doc_id").cast("string").alias("path"), body.alias("content")))
    return manifest.difference(of(docs.filter(k != "src1"), F.col("text")), of(docs.filter(k != "src2"), F.when(k == "src3", F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))))


@query("""WITH h AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents),
p AS (SELECT substr(sha256(path), 1, 4) AS part, sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path || ':' || hash)) AS digest FROM h GROUP BY part)
SELECT sha256('v1' || chr(10) || string_agg(digest, chr(10) ORDER BY part)) AS fingerprint FROM p""")
def fingerprint(spark, d):
    return manifest.fingerprint(content_hash(spark, d), "v1")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start_us FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, d):
    return changes.sessions(table(spark, d, "events"), "user_id", "30 minutes").select("user_id", "n", F.unix_micros("start").alias("start_us"))


@query("SELECT event_type, (epoch_us(ts) // 3600000000 * 3600000000)::BIGINT AS start_us, count(*) AS triggers FROM events GROUP BY ALL")
def coalesced_builds(spark, d):
    return changes.coalesced_builds(table(spark, d, "events"), "event_type", 3600).select("event_type", F.unix_micros("start").alias("start_us"), "triggers")


@query("""WITH RECURSIVE e AS (SELECT event_type AS k, epoch_us(ts) AS t FROM events),
b(k, s, before) AS (SELECT k, min(t), -1::BIGINT FROM e GROUP BY k
 UNION ALL SELECT k, greatest(t, s + 86400000000), s FROM (SELECT b.k, b.s, min(e.t) AS t FROM b JOIN e ON e.k = b.k AND e.t > b.s GROUP BY b.k, b.s))
SELECT k AS event_type, s AS start_us, count(*) AS triggers FROM b JOIN e USING (k) WHERE t > before AND t <= s GROUP BY k, s""")
def single_slot_builds(spark, d):
    return changes.single_slot_builds(table(spark, d, "events"), "event_type", 86400).select("event_type", F.unix_micros("start").alias("start_us"), "triggers")


# --- policy ---------------------------------------------------------------------------------------

POLICY = policy.Policy(authors=["Bot-1", "bot-2", "bot-3"], base="main", label="AutoMerge", prefixes=["bot/", "deps/"], close_conflicts=True)


def requests(spark, d):
    """Orders as change requests."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("number"),
        F.concat(F.lit("bot-"), (k % 5).cast("string")).alias("author"),
        F.when(k % 11 == 0, "dev").otherwise("main").alias("base_ref"),
        (k % 13 == 0).alias("draft"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), F.lit("automerge"))).alias("labels"),
        F.when(k % 17 == 0, "fix/a").otherwise(F.concat(F.lit("deps/"), k.cast("string"))).alias("head_ref"),
        F.when(k % 19 == 0, F.lit(None)).otherwise(k % 23 != 0).cast("boolean").alias("mergeable"),
        F.element_at(F.array(*map(F.lit, ("passing", "pending", "failed", "none", "odd"))), (k % 29 % 5 + 1).cast("int")).alias("check_state"),
    )


_POLICY = """d AS (SELECT o_orderkey AS k, ['passing', 'pending', 'failed', 'none', 'odd'][o_orderkey % 29 % 5 + 1] AS state FROM orders),
p AS (SELECT k, CASE WHEN k % 5 NOT IN (1, 2, 3) THEN 'author "bot-' || k % 5 || '" not on bot allowlist' WHEN k % 11 = 0 THEN 'base branch "dev" does not match target "main"'
 WHEN k % 13 = 0 THEN 'draft PR' WHEN k % 7 = 0 THEN 'missing required label "AutoMerge"' WHEN k % 17 = 0 THEN 'head ref "fix/a" does not match configured prefixes'
 WHEN k % 19 = 0 THEN 'mergeable status still computing' WHEN k % 23 = 0 THEN 'conflict detected' WHEN state = 'none' THEN 'no checks reported' WHEN state = 'pending' THEN 'checks pending'
 WHEN state = 'failed' THEN 'checks failed' WHEN state = 'odd' THEN 'unknown check state "odd"' ELSE 'all policy gates passed' END AS reason FROM d),
q AS (SELECT k, reason, CASE reason WHEN 'conflict detected' THEN 'would_close' WHEN 'all policy gates passed' THEN 'would_merge' ELSE 'skip' END AS action FROM p)"""


@query(f"WITH {_POLICY} SELECT k AS number, action, reason FROM q")
def pr_policy(spark, d):
    return policy.decide(requests(spark, d), POLICY).select("number", "action", "reason")


@query(f"WITH {_POLICY} SELECT upper(action) AS action, count(*) AS n FROM q GROUP BY ALL")
def decision_tally(spark, d):
    return policy.tally(policy.decide(requests(spark, d), POLICY))


@query("""WITH r AS (SELECT l_orderkey AS k, l_returnflag = 'N' AND l_quantity < 10 AS open, l_linestatus = 'O' AND l_discount > 0.08 AS bad FROM lineitem),
s AS (SELECT k, CASE WHEN bool_or(open) THEN 'pending' WHEN bool_or(bad) THEN 'failed' ELSE 'passing' END AS state, count(*) AS total FROM r GROUP BY k)
SELECT o_orderkey AS k, coalesce(state, 'none') AS state, coalesce(total, 0)::BIGINT AS total FROM orders LEFT JOIN s ON k = o_orderkey""")
def check_rollup(spark, d):
    status = F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") < 10), "in_progress").otherwise("completed")
    result = F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.08), "failure").otherwise("success")
    runs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), status.alias("status"), result.alias("conclusion"))
    return policy.with_state(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), policy.roll_up(runs, "k"), "k")
