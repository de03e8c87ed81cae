"""Queries on listings of a service, change streams, mutations, publication, hosts, metadata bags and rule tables."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import bags, hosts, rules
from docweave.operators import policy
from docweave.plans.registry import query, table
from docweave.plans.retrieval_queries import _POLICY, POLICY, requests
from docweave.sources import listings, publish, sinks
from docweave.storage import scratch_path
from docweave.streaming import mutations, retries, snapshots

# --- listings -------------------------------------------------------------------------------------

_OPTIONS = {"transport": "docweave.sources.listings:stored", "errors": "rows"}
_BUSY = "busy;" * 1000


def _paged(rows, by, size=100):
    """rows (by, number, item) as pages of a JSON list each."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("number")) - 1
    numbered = rows.withColumn("page", F.floor(place / size) + 1).groupBy(by, "page").agg(F.array_sort(F.collect_list(F.struct("number", "item"))).alias("items"))
    return numbered.withColumn("body", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]")))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus || year(o_orderdate) AS repo FROM orders WHERE o_orderkey % 11 <> 0),
n AS (SELECT repo, count(*) AS n, repo LIKE 'P%' AS busy FROM o GROUP BY repo)
SELECT '/repos/o/' || repo || '/pulls' AS listing, k AS number, 'Bot-' || k % 5 AS author, CASE WHEN k % 7 = 0 THEN '' ELSE 'x,automerge' END AS labels, k % 13 = 0 AS draft, sha256(k::VARCHAR) AS head_sha, NULL AS error
FROM o JOIN n USING (repo) WHERE NOT busy AND n < 2000 AND k % 5 IN (1, 2)
UNION ALL SELECT '/repos/o/' || repo || '/pulls', NULL, NULL, NULL, NULL, NULL, 'GET /repos/o/' || repo || CASE WHEN busy THEN '/pulls?base=main&page=1&per_page=100&state=open: API error status=503: ' || substr(repeat('busy;', 1000), 1, 4096) ELSE '/pulls: pagination truncated after 20 pages' END
FROM n WHERE busy OR n >= 2000""")
def request_listing(spark, d):
    """Orders as open change requests of repositories, stored as pages and read through the paged source."""
    k, root = F.col("o_orderkey"), scratch_path(spark, "request-pages")
    orders = table(spark, d, "orders").filter(k % 11 != 0)
    names = F.when(k % 7 == 0, F.array().cast("array<struct<name: string>>")).otherwise(F.array(F.struct(F.lit("x").alias("name")), F.struct(F.lit("automerge").alias("name"))))
    item = F.struct(k.alias("number"), F.lit("open").alias("state"), (k % 13 == 0).alias("draft"), F.struct(F.concat(F.lit("Bot-"), (k % 5).cast("string")).alias("login")).alias("user"), names.alias("labels"), F.struct(F.sha2(k.cast("string").cast("binary"), 256).alias("sha")).alias("head"))
    repository = F.concat("o_orderstatus", F.year("o_orderdate").cast("string"))
    pages = _paged(orders.select(repository.alias("repo"), k.alias("number"), F.to_json(item).alias("item")), "repo")
    busy, asked = F.col("repo").startswith("P"), F.format_string("repos/o/%s/pulls?base=main&page=%d&per_page=100&state=open", "repo", "page")
    listings.store_responses(pages.select(asked.alias("path"), F.when(busy, 503).otherwise(200).alias("status"), F.when(busy, "busy").otherwise("OK").alias("reason"), F.when(busy, _BUSY).otherwise(F.col("body")).alias("body")), root)
    repositories = [f"o/{r['repo']}" for r in orders.select(repository.alias("repo")).distinct().collect()]  # one for each status and year
    found = listings.open_requests(spark, f"{root}/responses", sorted(repositories), ["bot-1", "BOT-2"], "main", **_OPTIONS)
    good = F.col("error").isNull()
    return found.select("listing", "number", "author", F.when(good, F.array_join("labels", ",")).alias("labels"), F.when(good, F.col("draft")).alias("draft"), "head_sha", "error")


@query("""WITH r AS (SELECT l_suppkey AS k, count(*) AS n, bool_or(l_returnflag = 'N' AND l_quantity < 2) AS open, bool_or(l_linestatus = 'O' AND l_discount > 0.099 AND l_tax > 0.079) AS bad FROM lineitem GROUP BY 1)
SELECT 'c' || s_suppkey AS sha, CASE WHEN n > 2000 THEN NULL WHEN n IS NULL THEN 'none' WHEN open THEN 'pending' WHEN bad THEN 'failed' ELSE 'passing' END AS state, CASE WHEN n > 2000 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS total,
CASE WHEN n > 2000 THEN 'GET /repos/o/r/commits/c' || s_suppkey || '/check-runs: pagination truncated: got 2000 of ' || n END AS error FROM supplier LEFT JOIN r ON k = s_suppkey""")
def check_listing(spark, d):
    """Line items as check runs of their suppliers' commits, stored as pages with a total and rolled up."""
    root = scratch_path(spark, "check-pages")
    state = F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") < 2), "in_progress").otherwise("completed")
    result = F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.099) & (F.col("l_tax") > 0.079), "failure").otherwise("neutral")
    runs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.struct("l_orderkey", "l_linenumber").alias("number"), F.to_json(F.struct(state.alias("status"), result.alias("conclusion"))).alias("item"))
    pages = _paged(runs, "k")
    total = runs.groupBy("k").agg(F.count("*").alias("n"))
    body = F.concat(F.format_string('{"total_count": %d, "check_runs": ', "n"), "body", F.lit("}"))
    listings.store_responses(pages.join(total, "k").select(F.format_string("repos/o/r/commits/c%d/check-runs?page=%d&per_page=100", "k", "page").alias("path"), F.lit(200).alias("status"), F.lit("OK").alias("reason"), body.alias("body")), root)
    commits = table(spark, d, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("sha"))
    service = listings.Service(f"{root}/responses", transport="docweave.sources.listings:stored_object")
    found = listings.check_runs(commits, service, "o/r")
    return policy.summaries(found)


# --- change streams -------------------------------------------------------------------------------


@query("""WITH s AS (SELECT 'doc/' || doc_id AS path, doc_id % 10 <> 0 AS in1, doc_id % 9 <> 0 AS in2, doc_id % 8 <> 0 AS in3, sha256(text) AS h1,
 sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS h2, sha256(text || CASE WHEN doc_id % 5 = 0 THEN '?' WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS h3 FROM documents),
c AS (SELECT 2 AS snapshot, path, in1 AS a, in2 AS b, h1 AS x, h2 AS y FROM s UNION ALL SELECT 3, path, in2, in3, h2, h3 FROM s)
SELECT snapshot::BIGINT AS snapshot, path, CASE WHEN NOT a THEN 'added' WHEN NOT b THEN 'removed' ELSE 'modified' END AS change, CASE WHEN b THEN y END AS hash FROM c WHERE (a OR b) AND (NOT a OR NOT b OR x <> y)""")
def change_stream(spark, d):
    """Three snapshots of documents; the stream is stopped behind the second and goes on from its checkpoint."""
    log, out, checkpoint = (scratch_path(spark, x) for x in ("change-log", "changes", "changes-checkpoint"))
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    mark = F.when(k % 7 == 0, "!").otherwise("")
    states = [(k % 10 != 0, F.lit("")), (k % 9 != 0, mark), (k % 8 != 0, F.when(k % 5 == 0, "?").otherwise(mark))]
    for n, (there, tail) in enumerate(states):
        snapshots.record(spark, docs.filter(there).select(F.concat(F.lit("doc/"), k.cast("string")).alias("path"), F.sha2(F.concat("text", tail), 256).alias("hash")), log, 8)
        if n:
            stream = snapshots.changes(spark, log, buckets=8).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            stream.start(out, format="parquet").awaitTermination()
    return spark.read.schema(snapshots.CHANGE).parquet(out)


@query(f"""WITH {_POLICY}, w AS (SELECT k, CASE action WHEN 'would_merge' THEN 'merge' ELSE 'close' END AS action, k % 31 <> 0 AS done FROM q WHERE action <> 'skip')
SELECT k AS number, action, CASE WHEN k % 3 = 0 AND NOT done THEN 2 ELSE 1 END::BIGINT AS sent, done, CASE WHEN done THEN action ELSE 'skip' END AS result FROM w""")
def mutations_once(spark, d):
    """Decisions on orders, applied in three batches: the second is replayed after a fault, the third decides those of
    the first again. What is sent is written to a ledger; a change that failed is sent again when decided again."""
    log, ledger, decided, checkpoint = (scratch_path(spark, x) for x in ("mutations", "ledger", "decisions", "mutations-checkpoint"))
    rows = policy.decide(requests(spark, d), dataclasses.replace(POLICY, apply=True))
    k = F.col("number")
    rows = rows.select(F.lit("o/r").alias("repository"), "number", F.sha2(k.cast("string").cast("binary"), 256).alias("head_sha"), "action")

    def effect(intents):
        intents.withColumn("attempt", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(ledger)
        done = k % 31 != 0
        return intents.select("*", done.alias("done"), F.when(done, F.col("action")).otherwise("skip").alias("result"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("error"))

    class Fault(Exception):
        pass

    def fail(epoch):
        raise Fault(f"after the outcomes of batch {epoch}")

    def run(after=None):
        stream = spark.readStream.schema(mutations.INTENT).parquet(decided)
        mutations.exactly_once(stream, log, effect, checkpoint, after=after).awaitTermination()

    for n, part in enumerate((k % 3 == 0, k % 3 == 1, k % 3 != 1)):
        rows.filter(part).write.mode("append").parquet(decided)
        if n == 1:
            try:
                run(fail)
            except Exception as e:  # noqa: BLE001
                if "after the outcomes" not in str(e):
                    raise
        run()
    sent = spark.read.parquet(ledger).groupBy("number", "action").agg(F.count("*").alias("sent"))
    last = mutations.outcomes(spark, log).groupBy("number", "action").agg(F.max_by(F.struct("done", "result"), "epoch").alias("o"))
    return sent.join(last, ["number", "action"]).select("number", "action", "sent", "o.done", "o.result")


@query("""WITH RECURSIVE a(k, n, due) AS (SELECT c_custkey, 1, 1704067200000 + c_custkey * 1000 + 2000 FROM customer
UNION ALL SELECT k, n + 1, due + 2000 * (1 << n) FROM a WHERE n < 5 AND n <= k % 7)
SELECT 'c' || k AS key, n AS attempt, due::BIGINT AS due_ms, CASE WHEN n > k % 7 THEN 'made' WHEN n = 5 THEN 'given up' ELSE 'failed' END AS outcome,
CASE WHEN n > k % 7 THEN NULL WHEN n = 5 THEN 'failed after 5 attempts: status 505' ELSE 'status 50' || n END AS error FROM a""")
def retry_schedule(spark, d):
    """Customers as requests of a stream, each failing as often as its key says; the stream's clock goes on with rows of
    later days, one batch each."""
    source, out, checkpoint = (scratch_path(spark, x) for x in ("retry-requests", "retry-attempts", "retry-checkpoint"))
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("key"), F.timestamp_seconds(k + 1_704_067_200).alias("ts"), (k % 7).cast("string").alias("payload"))
    rows.coalesce(1).write.mode("append").parquet(source)
    for day in range(1, 8):
        clock = spark.range(1).select(F.lit("clock").alias("key"), F.timestamp_seconds(F.lit(1_800_000_000 + day * 86_400)).alias("ts"), F.lit("0").alias("payload"))
        clock.coalesce(1).write.mode("append").parquet(source)

    def attempt(_key, failures, n):
        return f"status 50{n}" if n <= int(failures) else None

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    retries.attempts(stream, attempt).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.schema(retries.OUT).parquet(out).filter("key <> 'clock'")


# --- publication ----------------------------------------------------------------------------------


@query("""SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, octet_length(encode(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END))::BIGINT AS size, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS sha256
FROM documents WHERE doc_id % 10 <> 0""")
def published_files(spark, d):
    """Documents published as files, replaced by a second version; a third is written and never made current."""
    root, k = scratch_path(spark, "site"), F.col("doc_id")
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("docs/"), "source", F.lit("/"), k.cast("string"), F.lit(".md")))
    publish.publish(docs.select("path", F.col("text").alias("content")), root)
    publish.publish(docs.filter(k % 10 != 0).select("path", F.concat("text", F.when(k % 7 == 0, "!").otherwise("")).alias("content")), root)
    publish.write_version(docs.filter(k % 2 == 0).select("path", F.lit("never seen").alias("content")), root)
    return publish.published(spark, root).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@query("""WITH l AS (SELECT 'c/' || l_suppkey % 50 || '/index.html' AS path, 'o&' || l_orderkey AS name, l_linenumber AS k FROM lineitem),
p AS (SELECT path, string_agg('<li><a href="../' || k || '">' || replace(name, '&', '&amp;') || '</a></li>' || chr(10), '' ORDER BY name, k) AS body FROM l GROUP BY path)
SELECT path, sha256('<!DOCTYPE html>' || chr(10) || '<title>A &lt;b&gt;</title>' || chr(10) || '<h1>A &lt;b&gt;</h1>' || chr(10) || '<ul>' || chr(10) || body || '</ul>' || chr(10)) AS sha256 FROM p""")
def listing_pages(spark, d):
    """Line items as links of fifty pages, written as files by the tasks that hold them and read back."""
    root = scratch_path(spark, "pages")
    rows = table(spark, d, "lineitem").select(F.format_string("c/%d/index.html", F.col("l_suppkey") % 50).alias("path"), F.lit("A <b>").alias("title"), F.lit("").alias("target"), F.concat(F.lit("o&"), F.col("l_orderkey").cast("string")).alias("name"), F.concat(F.lit("../"), F.col("l_linenumber").cast("string")).alias("link"))
    sinks.write_files(sinks.listing_pages(rows), root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_extract("path", "/(c/[0-9]+/index.html)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))


# --- hosts and addresses --------------------------------------------------------------------------

_K = "(k % 256)"


@query(f"""WITH p AS (SELECT page_id AS k, url FROM pages),
f AS (SELECT k, 0 AS form, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, FALSE AS loopback FROM p
UNION ALL SELECT k, 1, '127.' || {_K} || '.0.1', TRUE FROM p UNION ALL SELECT k, 2, '::1', TRUE FROM p UNION ALL SELECT k, 3, 'LocalHost', TRUE FROM p
UNION ALL SELECT k, 4, '10.0.0.' || {_K}, FALSE FROM p UNION ALL SELECT k, 5, '::ffff:127.0.0.' || {_K}, TRUE FROM p UNION ALL SELECT k, 6, '127.0.0.' || k % 300, k % 300 < 256 FROM p
UNION ALL SELECT k, 7, '0127.0.0.1', FALSE FROM p UNION ALL SELECT k, 8, '::' || to_hex(k % 3), k % 3 = 1 FROM p UNION ALL SELECT k, 9, '', TRUE FROM p UNION ALL SELECT k, 10, '::127.0.0.1', FALSE FROM p)
SELECT k AS page_id, form, host, loopback, loopback AND host <> '' AND form <> 9 OR form = 4 AND {_K} = 7 AS allowed FROM f""")
def loopback_hosts(spark, d):
    """Hosts of page addresses, and ten forms of hosts made from their ids."""
    k = F.col("page_id")
    low, text = (k % 256).cast("string"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    forms = [F.col("url"), text("http://a:b@127.", low, ".0.1:8080/x/y"), text("[::1]:", k.cast("string")), text("LocalHost:", k.cast("string"), "/"), text("ftp://10.0.0.", low), text("http://[::ffff:127.0.0.", low, "]:80"), text("https://127.0.0.", (k % 300).cast("string"), "/?q"), text("0127.0.0.1"), text("[::", F.lower(F.hex(k % 3)), "]"), text("http://"), text("x@::127.0.0.1/")]
    rows = table(spark, d, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "text"))
    host = hosts.host_of(F.col("text"))
    return rows.select("page_id", "form", host.alias("host"), hosts.is_loopback(F.col("text")).alias("loopback"), hosts.host_allowed(host, "10.0.0.7").alias("allowed"))


@query("""WITH p AS (SELECT o_orderkey AS k, k::BIGINT * 7919 % 32768 AS a, k::BIGINT * 104729 % 65536 AS b, k::BIGINT * 31 % 65536 AS c FROM orders),
v AS (SELECT k, 0 AS form, 0 AS hi, 281470681743360 + 10 * 16777216 + (a % 256) * 65536 + (b % 256) * 256 + c % 256 AS lo, TRUE AS private, FALSE AS docs FROM p
UNION ALL SELECT k, 1, a * 281474976710656 + b * 4294967296, c, FALSE, FALSE FROM p
UNION ALL SELECT k, 2, 536939960 * 4294967296 + a * 65536 + b, c * 4294967296 + 3221225472 + c % 256, FALSE, TRUE FROM p
UNION ALL SELECT k, 3, NULL, NULL, FALSE, FALSE FROM p UNION ALL SELECT k, 4, NULL, NULL, FALSE, FALSE FROM p)
SELECT k AS number, form, hi::BIGINT AS hi, lo::BIGINT AS lo, private, docs FROM v""")
def address_numbers(spark, d):
    """Addresses of both families made from order keys, as numbers and by range."""
    k = F.col("o_orderkey")
    a, b, c = (k * 7919 % 32768).cast("long"), (k * 104729 % 65536).cast("long"), (k * 31 % 65536).cast("long")
    forms = [F.format_string("10.%d.%d.%d", a % 256, b % 256, c % 256), F.format_string("%x:%X::%x", a, b, c), F.format_string("2001:db8:%x:%x:0:%x:192.0.0.%d", a, b, c, c % 256), F.format_string("%x:%x::1::2", a, b), F.format_string("1:2:3:4:5:6:7:8:%x", c)]
    rows = table(spark, d, "orders").select(k.alias("number"), F.posexplode(F.array(*forms)).alias("form", "text")).withColumn("ip", hosts.address(F.col("text")))
    return rows.select("number", "form", "ip.hi", "ip.lo", hosts.in_range(F.col("ip"), "10.0.0.0/8").alias("private"), hosts.in_range(F.col("ip"), "2001:db8::/32").alias("docs"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey * 37 % 70000 - 10 AS port, ['127.0.0.1', '', '192.168.1.5', '::1', 'example.org'][o_orderkey % 5 + 1] AS host, o_orderkey % 3 > 0 AS bound FROM orders)
SELECT k AS number, CASE WHEN port NOT BETWEEN 1 AND 65535 THEN 'ask: port must be between 1 and 65535, got ' || port WHEN host = '' THEN 'ask: host cannot be empty'
WHEN bound AND host IN ('192.168.1.5', 'example.org') THEN 'ask: refusing non-loopback host "' || host || '" — pass an explicit, non-loopback address only when you accept that the assistant may become reachable on your network' END AS error FROM o""")
def binding_errors(spark, d):
    k = F.col("o_orderkey")
    host = F.element_at(F.array(*map(F.lit, ("127.0.0.1", "", "192.168.1.5", "::1", "example.org"))), (k % 5 + 1).cast("int"))
    rows = table(spark, d, "orders").select(k.alias("number"), host.alias("host"), (k * 37 % 70000 - 10).alias("port"))
    return rows.select("number", hosts.binding_error(F.col("host"), F.col("port"), F.col("number") % 3 > 0).alias("error"))


# --- metadata bags --------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS title, CASE doc_id % 4 WHEN 0 THEN doc_id WHEN 1 THEN -1 ELSE 0 END AS position,
CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN lang ELSE lang || ',' || source END AS tags, doc_id % 2 = 0 AS draft, lang AS inner_lang,
CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'draft,inner,order,tags,title' END AS keys FROM documents""")
def metadata_bags(spark, d):
    """Documents' columns as JSON bags of mixed types, read back by typed getters."""
    k = F.col("doc_id")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    order = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "-1.75").when(k % 4 == 2, quoted(k.cast("string"))).otherwise("null")
    title = F.when(k % 3 == 0, k.cast("string")).otherwise(quoted(F.col("source")))
    tags = F.when(k % 5 == 0, "[]").when(k % 5 == 1, quoted(F.col("lang"))).when(k % 5 == 2, F.concat(F.lit("[1, "), quoted(F.col("lang")), F.lit(', "", null]'))).otherwise(F.concat(F.lit("["), quoted(F.col("lang")), F.lit(","), quoted(F.col("source")), F.lit("]")))
    text = F.concat(F.lit('{"title": '), title, F.lit(', "order": '), order, F.lit(', "tags": '), tags, F.lit(', "draft": '), F.when(k % 2 == 0, "true").otherwise(F.when(k % 7 == 0, '"true"').otherwise("false")), F.lit(', "inner": {"lang": '), quoted(F.col("lang")), F.lit("}}"))
    rows = table(spark, d, "documents").select("doc_id", bags.bag(text).alias("bag"))
    get = lambda *path: bags.value(F.col("bag"), *path)
    return rows.select("doc_id", bags.string(get("title")).alias("title"), bags.integer(get("order")).alias("position"), F.array_join(bags.strings(get("tags")), ",").alias("tags"), bags.boolean(get("draft")).alias("draft"), bags.string(get("inner", "lang")).alias("inner_lang"), F.when(k % 6 != 0, F.array_join(bags.keys(F.col("bag")), ",")).alias("keys"))


# --- rule tables ----------------------------------------------------------------------------------


def _case(text: str, found: list[rules.Rule], default: str) -> str:
    """The same rules as a SQL expression."""
    sql = lambda s: "'" + s.replace("'", "''") + "'"
    when = [f"WHEN {' OR '.join('(' + ' AND '.join(f'contains(lower({text}), {sql(p)})' for p in parts) + ')' for parts in r.any_of)} THEN {sql(r.result)}" for r in found]
    return f"CASE {' '.join(when)} ELSE {sql(default)} END"


_EXTENSIONS = ("html", "css", "JS", "svg", "json", "tar.gz", "min.js", "")
_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.CONTENT_TYPES.items())


@query(f"""WITH n AS (SELECT page_id, url || '/file.v' || page_id || ['', {', '.join(f"'.{x}'" for x in _EXTENSIONS[:-1])}][page_id % 8 + 1] AS name FROM pages)
SELECT page_id, CASE lower(regexp_extract(name, '\\.[^./]*$')) {_TYPES} ELSE '{rules.OTHER_TYPE}' END AS content_type FROM n""")
def content_types(spark, d):
    k = F.col("page_id")
    ending = F.element_at(F.array(*[F.lit(f".{x}" if x else "") for x in ("", *_EXTENSIONS[:-1])]), (k % 8 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", rules.content_type(F.concat("url", F.lit("/file.v"), k.cast("string"), ending)).alias("content_type"))


_WORDS = ("listen: Address already in use", "Layout broken", "bad YAML in a template", "open x: no such file", "key not found in markdown", "odd", "BIND failed", "timeout")


@query(f"""WITH m AS (SELECT event_id, event_type || ': ' || [{', '.join(f"'{w}'" for w in _WORDS)}][event_id % 8 + 1] AS message FROM events)
SELECT event_id, {_case('message', rules.GUIDANCE, rules.NO_GUIDANCE)} AS hint FROM m""")
def recovery_hints(spark, d):
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", rules.guidance(F.concat("event_type", F.lit(": "), word)).alias("hint"))


_SAID = ("Frontmatter warning in ", "case-only: would be the same file on a case-insensitive disk ", "broken internal link in ", "the asset is missing ", "Unusually large raster ", "suspicious image extension ", "Case collision ", "output path collision ", "all is well in ")


@query(f"""WITH m AS (SELECT event_id AS k, [{', '.join(f"'{w}'" for w in _SAID)}][event_id % 9 + 1] || 'docs/' || event_id || '.md: line 3' AS message FROM events)
SELECT k AS event_id, CASE WHEN contains(lower(message), 'frontmatter') THEN 'fix frontmatter in docs/' || k || '.md' ELSE {_case('message', [r for r in rules.NEXT_ACTIONS if not r.patterns], '')} END AS hint FROM m""")
def diagnostic_hints(spark, d):
    k = F.col("event_id")
    said = F.element_at(F.array(*map(F.lit, _SAID)), (k % 9 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", rules.next_action(F.concat(said, F.lit("docs/"), k.cast("string"), F.lit(".md: line 3"))).alias("hint"))
