"""Paged listings, change streams, mutations, publication, hosts, bags and rules."""

import ipaddress
import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from docweave import storage
from docweave.functions import bags, hosts, rules
from docweave.operators import policy
from docweave.sources import listings, publish
from docweave.streaming import changes, mutations, retries, snapshots


class Server:
    """A service on this machine, with requests that fail as told and a count of all changes."""

    def __init__(self):
        self.requests, self.asked, self.fail, self.merges, self.lost = {}, [], {}, [], set()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def answer(self, status, body):
                data = body if isinstance(body, bytes) else json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def handle_any(self):
                url = urlsplit(self.path)
                n = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(n)) if n else None
                with outer.lock:
                    outer.asked.append((self.command, self.path, dict(self.headers), body))
                    left = outer.fail.get(url.path, 0)
                    outer.fail[url.path] = left - 1
                    if left > 0:
                        return self.answer(503, b"  try later  ")
                    return self.answer(*outer.said(self.command, url.path, {k: v[0] for k, v in parse_qs(url.query).items()}, body))

            do_GET = do_PUT = do_PATCH = do_POST = handle_any

        self.lock = threading.Lock()
        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.http.server_port}"

    def said(self, method, path, query, body):
        parts = path.strip("/").split("/")
        if parts[-1] == "long":
            return 500, b"x" * 10_000
        if parts[-1] == "empty":
            return 200, b" "
        if parts[-1] == "html":
            return 200, b"<html>"
        if parts[-1] == "pulls" and method == "GET":
            rows = sorted((r for r in self.requests.values() if r["base"]["ref"] == query.get("base", "main")), key=lambda r: str(r["number"]), reverse=True)
            at = (int(query["page"]) - 1) * int(query["per_page"])
            return 200, rows[at : at + int(query["per_page"])]
        if parts[-1] == "check-runs":
            n = int(parts[-2].lstrip("c"))
            at = (int(query["page"]) - 1) * int(query["per_page"])
            runs = [{"name": str(k), "status": "completed", "conclusion": "success"} for k in range(n)]
            return 200, {"total_count": n + (parts[-2] == "c7"), "check_runs": runs[at : at + int(query["per_page"])]}
        if len(parts) == 3:
            return 200, {"default_branch": "main" if parts[-1] == "r" else " "}
        number = int(parts[4])
        one = self.requests[number]
        if method == "GET":
            return 200, one
        if method == "PATCH":
            one["state"] = body["state"]
            return 200, one
        if one.get("merged") or body["sha"] != one["head"]["sha"]:
            return 409, {"message": "head has moved"}
        if number % 10 == 9:
            return 200, {"merged": False, "message": "not today"}
        one |= {"merged": True, "state": "closed"}
        self.merges.append(number)
        if number in self.lost:  # the change is made, the answer is lost
            return 502, b""
        return 200, {"merged": True}


@pytest.fixture()
def server():
    s = Server()
    yield s
    s.http.shutdown()
    s.http.server_close()


def request(number, **more):
    return {"number": number, "title": f"t{number}", "state": "open", "draft": False, "mergeable": None, "user": {"login": f"Bot-{number % 3}"}, "labels": [{"name": "a"}], "head": {"ref": f"h{number}", "sha": f"s{number}"}, "base": {"ref": "main", "sha": "b"}} | more


# --- listings -------------------------------------------------------------------------------------


def test_listing_reads_all_pages_of_a_service(spark, server):
    server.requests = {n: request(n) for n in range(1, 251)} | {900: request(900, base={"ref": "dev", "sha": ""})}
    got = listings.open_requests(spark, server.base, ["o/r"], ["BOT-1"], "main", token="secret").orderBy("number").collect()
    assert [r["number"] for r in got] == [n for n in range(1, 251) if n % 3 == 1]
    assert (got[0]["author"], got[0]["labels"], got[0]["head_sha"], got[0]["mergeable"], got[0]["listing"]) == ("Bot-1", ["a"], "s1", None, "/repos/o/r/pulls")
    assert listings.open_requests(spark, server.base, ["o/r"], [], "dev").count() == 1
    assert any(h.get("Authorization") == "token secret" and h["Accept"] == "application/vnd.github+json" for _, _, h, _ in server.asked)
    assert {parse_qs(urlsplit(p).query)["page"][0] for _, p, _, _ in server.asked} == {str(n) for n in range(1, 21)}


def test_listing_longer_than_allowed_is_an_error(spark, server):
    server.requests = {n: request(n) for n in range(1, 31)}
    schema = "listing string, page int, number long, error string"
    assert listings.listing(spark, server.base, ["/repos/o/r/pulls"], schema, size=10, pages=4).filter("number IS NOT NULL").count() == 30
    cut = listings.listing(spark, server.base, ["/repos/o/r/pulls"], schema, size=10, pages=3)
    with pytest.raises(Exception, match="pagination truncated after 3 pages"):
        cut.count()
    rows = listings.open_requests(spark, server.base, ["o/r"], [], "main", size=10, pages=3, errors="rows").collect()
    assert [(r["number"], r["error"]) for r in rows] == [(None, "GET /repos/o/r/pulls: pagination truncated after 3 pages")]


def test_errors_have_a_bounded_body(server):
    service = listings.Service(server.base)
    with pytest.raises(listings.ServiceError) as e:
        service.request("GET", "/a/b/c/long")
    assert str(e.value) == "GET /a/b/c/long: API error status=500: " + "x" * 4096
    with pytest.raises(listings.ServiceError, match="GET /a/b/c/html: failed to decode response"):
        service.request("GET", "/a/b/c/html")
    assert service.request("GET", "/a/b/c/empty") is None
    with pytest.raises(listings.ServiceError, match="request failed"):
        listings.Service("http://127.0.0.1:1").request("GET", "/x")
    assert listings.default_branch(service, "o/r") == "main"
    with pytest.raises(listings.ServiceError, match="default_branch is empty"):
        listings.default_branch(service, "o/x")


def test_requests_are_repeated_as_often_as_allowed(spark, server):
    server.requests = {1: request(1)}
    server.fail = {"/repos/o/r/pulls": 2}
    with pytest.raises(listings.ServiceError, match="status=503: try later"):
        listings.Service(server.base).page("/repos/o/r/pulls", 1, 10, {})
    server.fail = {"/repos/o/r/pulls": 2}
    assert len(listings.Service(server.base, attempts=3, pause=0.01).page("/repos/o/r/pulls", 1, 10, {})[0]) == 1
    server.fail = {"/repos/o/r/pulls": 2}
    rows = listings.listing(spark, server.base, ["/repos/o/r/pulls"], "number long", pages=1, attempts=3, pause=0.01)
    assert [r["number"] for r in rows.collect()] == [1]


def test_equality_travels_with_the_request(spark, server):
    server.requests = {n: request(n, base={"ref": "dev" if n % 2 else "main", "sha": ""}, target="dev" if n % 2 else "main") for n in range(1, 7)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = listings.listing(spark, server.base, ["/repos/o/r/pulls"], "number long, target string", pages=2, pushed={"target": "base"}).filter("target = 'dev'")
        assert sorted(r["number"] for r in rows.collect()) == [1, 3, 5]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert all(parse_qs(urlsplit(p).query)["base"] == ["dev"] for _, p, _, _ in server.asked)


def test_values_that_do_not_fit_the_schema_are_errors(spark, server):
    server.requests = {1: request(1, base={"ref": "main"}) | {"number": "one"}}
    rows = listings.listing(spark, server.base, ["/repos/o/r/pulls"], "number long, error string", pages=1, errors="rows").collect()
    assert rows[0]["error"] == "failed to decode response: number is not of type bigint"
    assert listings.listing(spark, server.base, [], "number long").count() == 0
    plain = listings.listing(spark, server.base, ["/repos/o/r/pulls"], "value string, page int", pages=1).collect()
    assert json.loads(plain[0]["value"])["title"] == "t1" and plain[0]["page"] == 1


def test_check_runs_of_commits(spark, server):
    commits = spark.createDataFrame([("c0",), ("c5",), ("c250",), ("c7",), ("c2500",)], "sha string")
    found = listings.check_runs(commits, listings.Service(server.base), "o/r")
    got = {r["sha"]: (r["state"], r["total"], r["error"]) for r in policy.summaries(found).collect()}
    assert got["c0"] == ("none", 0, None) and got["c5"] == ("passing", 5, None) and got["c250"] == ("passing", 250, None)
    assert got["c7"] == (None, 0, "GET /repos/o/r/commits/c7/check-runs: pagination truncated: got 7 of 8")
    assert got["c2500"][2] == "GET /repos/o/r/commits/c2500/check-runs: pagination truncated: got 2000 of 2500"
    server.requests = {1: request(1, mergeable=True)}
    one = listings.details(spark.createDataFrame([("o/r", 1)], "repository string, number long"), listings.Service(server.base)).first()
    assert tuple(one) == ("o/r", 1, True, "s1", None)


def test_runs_are_asked_for_once_and_in_many_tasks(spark, server):
    commits = spark.createDataFrame([(f"c{n}",) for n in (0, 5, 250, 30, 40, 50, 60)], "sha string").coalesce(1)
    found = listings.check_runs(commits, listings.Service(server.base), "o/r")
    assert found.select(F.spark_partition_id()).distinct().count() > 3
    server.asked.clear()
    assert policy.summaries(found).filter("error IS NULL").count() == 7
    assert len(server.asked) == len({path for _, path, _, _ in server.asked}) == 9


# --- change streams -------------------------------------------------------------------------------


def test_merged_difference():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ({f"{k:02}".encode(): rng.choice("xy") for k in rng.sample(range(30), rng.randrange(20))} for _ in range(2))
        want = [(k, "removed", None) if k not in b else (k, "added", b[k]) if k not in a else (k, "modified", b[k]) for k in sorted({*a, *b}) if a.get(k) != b.get(k)]
        assert list(snapshots.difference(iter(sorted(a.items())), iter(sorted(b.items())))) == want


def ran(spark, log, out, **options):
    stream = snapshots.changes(spark, log, buckets=4, **options).writeStream.option("checkpointLocation", f"{out}-at").trigger(availableNow=True)
    stream.start(out, format="parquet").awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(snapshots.CHANGE).parquet(out).collect())


def test_change_stream_of_folders_survives_restarts(spark, tmp_path):
    content, public, log = tmp_path / "content", tmp_path / "content/public", f"file://{tmp_path}/log"
    os.makedirs(public)

    def put(name, text):
        (content / name).parent.mkdir(parents=True, exist_ok=True)
        (content / name).write_text(text)

    def take():
        return snapshots.record(spark, changes.snapshot(spark, [str(content)], exclude=str(public)), log, 4)

    for name in ("a.md", "b.md", "é ü.md", "public/out.html"):
        put(name, name)
    assert take() == 1
    assert ran(spark, log, f"{tmp_path}/out") == []
    put("b.md", "other")
    put("deep/new folder/c.md", "c")
    put("public/out.html", "changed")
    os.remove(content / "a.md")
    assert take() == 2
    base = os.path.realpath(content)
    second = [(2, f"{base}/a.md", "removed"), (2, f"{base}/b.md", "modified"), (2, f"{base}/deep/new folder/c.md", "added")]
    assert [r[:3] for r in ran(spark, log, f"{tmp_path}/out")] == second
    assert take() == 3 and take() == 4  # nothing changed, then two snapshots in one batch
    os.remove(content / "é ü.md")
    assert take() == 5
    assert [r[:3] for r in ran(spark, log, f"{tmp_path}/out", keep=1)] == [*second, (5, f"{base}/é ü.md", "removed")]
    assert [r[:3] for r in ran(spark, log, f"{tmp_path}/out", keep=1)] == [*second, (5, f"{base}/é ü.md", "removed")]


def test_snapshots_that_were_not_finished_do_not_count(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3"), ("b", None)], "path string, hash string")
    snapshots.record(spark, rows, log, 4)
    assert [r[1:] for r in ran(spark, log, f"{tmp_path}/first", initial="added")] == [("a", "added", "1"), ("b", "added", None)]
    snapshots.record(spark, rows.filter("path = 'b'"), log, 4)
    os.remove(tmp_path / "log/buckets=4/id=2/_SUCCESS")
    assert ran(spark, log, f"{tmp_path}/out") == []
    assert snapshots.record(spark, rows.filter("path = 'a'").limit(0), log, 4) == 2
    assert [r[:3] for r in ran(spark, log, f"{tmp_path}/out")] == [(2, "a", "removed"), (2, "b", "removed")]


def test_builds_follow_the_change_stream(spark, tmp_path):
    log, seen = f"file://{tmp_path}/log", []
    for n in range(3):
        snapshots.record(spark, spark.createDataFrame([(f"p{n}", "h")], "path string, hash string"), log, 4)
    query = changes.rebuild_on_change(snapshots.changes(spark, log, buckets=4), lambda batch, _: seen.append(batch.count()), lambda _: seen.append("reload"), f"{tmp_path}/at")
    query.awaitTermination()
    assert seen == [4, "reload"]


# --- mutations ------------------------------------------------------------------------------------


def decided(spark, path, rows):
    spark.createDataFrame([("o/r", *r) for r in rows], mutations.INTENT).coalesce(2).write.mode("append").parquet(path)
    return spark.readStream.schema(mutations.INTENT).parquet(path)


def test_mutations_are_made_once(spark, server, tmp_path):
    server.requests = {n: request(n) for n in range(1, 12)}
    server.lost = {3}
    service, log, path = listings.Service(server.base), f"{tmp_path}/log", f"{tmp_path}/in"
    send = mutations.through(service)

    def dies_after_sending(intents):
        send(intents).collect()
        raise RuntimeError("the executor is lost")

    rows = [(1, "s1", "merge"), (1, "s1", "merge"), (2, "old", "merge"), (3, "s3", "merge"), (4, "s4", "close"), (5, "s5", "skip"), (9, "s9", "merge")]
    stream = decided(spark, path, rows)
    with pytest.raises(Exception, match="the executor is lost"):
        mutations.exactly_once(stream, log, dies_after_sending, f"{tmp_path}/at").awaitTermination()
    assert sorted(server.merges) == [1, 3]
    mutations.exactly_once(stream, log, send, f"{tmp_path}/at").awaitTermination()
    decided(spark, path, [(1, "s1", "merge"), (6, "s6", "merge"), (2, "s2", "merge")])

    def dies(_):
        raise RuntimeError("before the stream notes the batch")

    with pytest.raises(Exception, match="before the stream notes"):
        mutations.exactly_once(stream, log, send, f"{tmp_path}/at", after=dies).awaitTermination()
    mutations.exactly_once(stream, log, send, f"{tmp_path}/at").awaitTermination()
    assert sorted(server.merges) == [1, 2, 3, 6]
    got = sorted((r["epoch"], r["number"], r["done"], r["result"], r["reason"], r["error"]) for r in mutations.outcomes(spark, log).collect())
    assert [g[:3] for g in got] == [(0, 1, True), (0, 2, False), (0, 3, True), (0, 4, True), (0, 9, False), (1, 2, True), (1, 6, True)]
    assert got[0][3:] == ("merge", "squash merge completed at expected head SHA", None) and got[3][3:] == ("close", "conflict detected", None)
    assert got[1][3:5] == ("skip", "merge request failed") and got[1][5].startswith("PR #2: merge failed: PUT /repos/o/r/pulls/2/merge: API error status=409")
    assert got[4][5] == "PR #9: merge failed: merge of PR #9 was not confirmed: not today"
    assert [b for m, p, _, b in server.asked if m == "PUT" and p.endswith("/1/merge")] == [{"merge_method": "squash", "sha": "s1"}]
    assert [b for m, _, _, b in server.asked if m == "PATCH"] == [{"state": "closed"}]


def test_attempts_double_their_pause(spark, tmp_path):
    def put(*rows):
        made = spark.createDataFrame(rows, "key string, second long, payload string").select("key", F.timestamp_seconds("second").alias("ts"), "payload")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return made.schema

    def go(schema):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = retries.attempts(stream, lambda key, payload, n: None if n > int(payload) else f"{key} {n}")
        out.writeStream.option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet").awaitTermination()
        rows = spark.read.schema(retries.OUT).parquet(f"{tmp_path}/out").filter("key <> 'clock'")
        return sorted((r["key"], r["attempt"], r["due_ms"] // 1000, r["outcome"], r["error"]) for r in rows.collect())

    schema = put(("a", 105, "0"), ("a", 100, "2"), ("b", 101, "9"), (None, 100, "0"), ("c", None, "0"))
    put(("clock", 104, "0"))
    first = go(schema)
    assert first == [("a", 1, 102, "failed", "a 1"), ("b", 1, 103, "failed", "b 1")]
    put(("clock", 131, "0"), ("a", 131, "0"))  # a is still being tried
    put(("clock", 132, "0"))
    put(("clock", 500, "0"))
    put(("clock", 501, "0"), ("a", 501, "0"))  # a has ended
    put(("clock", 502, "0"))
    a = [("a", 1, 102, "failed", "a 1"), ("a", 2, 106, "failed", "a 2"), ("a", 3, 114, "made", None)]
    b = [("b", n, 101 + 2 ** (n + 1) - 2, "failed", f"b {n}") for n in range(1, 5)] + [("b", 5, 163, "given up", "failed after 5 attempts: b 5")]
    assert go(schema) == a + b


def test_attempts_that_the_clock_has_passed_are_made_together(spark, tmp_path):
    for rows in ((("a", 100, "9"), ("b", 101, "2")), (("clock", 500, "0"),)):
        made = spark.createDataFrame(rows, "key string, second long, payload string").select("key", F.timestamp_seconds("second").alias("ts"), "payload")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = retries.attempts(stream, lambda key, payload, n: None if n > int(payload) else f"{key} {n}")
    out.writeStream.option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet").awaitTermination()
    got = sorted((r["key"], r["attempt"], r["due_ms"] // 1000, r["outcome"]) for r in spark.read.schema(retries.OUT).parquet(f"{tmp_path}/out").filter("key <> 'clock'").collect())
    assert got == [("a", n, 98 + 2 ** (n + 1), "failed" if n < 5 else "given up") for n in range(1, 6)] + [("b", 1, 103, "failed"), ("b", 2, 107, "failed"), ("b", 3, 115, "made")]


# --- publication ----------------------------------------------------------------------------------


def seen(spark, root):
    return {r["path"]: bytes(r["content"]).decode() for r in publish.published(spark, root).collect()}


def files(spark, **named):
    return spark.createDataFrame([(k.replace("_", "/"), v) for k, v in named.items()], "path string, content string").repartition(2)


def test_publication_replaces_whole_versions(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    assert publish.current(spark, root) is None and seen(spark, root) == {}
    first = publish.publish(files(spark, a="1", d_e="2"), root)
    assert seen(spark, root) == {"a": "1", "d/e": "2"}
    second = publish.publish(files(spark, a="3"), root)
    assert seen(spark, root) == {"a": "3"} and publish.whole_versions(spark, root) == [first, second]
    half = publish.write_version(files(spark, a="4", b="5"), root)  # a crash between the phases
    assert seen(spark, root) == {"a": "3"}
    assert publish.sweep(spark, root) == [half]
    assert publish.roll_back(spark, root) == first and seen(spark, root) == {"a": "1", "d/e": "2"}
    with pytest.raises(publish.PublicationError, match="no version to go back to"):
        publish.roll_back(spark, root)
    third = publish.publish(files(spark, z="6"), root, keep=0)
    assert publish.whole_versions(spark, root) == [third] and os.listdir(tmp_path / "site/versions") == [third]
    assert [f for f in os.listdir(tmp_path / "site") if f.startswith(".CURRENT.") and f != ".CURRENT.crc"] == []


def test_publication_that_fails_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    publish.publish(files(spark, a="1"), root)
    for path in ("../x", "/x", "a//b", "a/./b", "", "a/", None, "a\\b"):
        with pytest.raises(publish.PublicationError, match="no path below"):
            publish.publish(spark.createDataFrame([(path, "x"), ("ok", "y")], "path string, content string"), root)
    with pytest.raises(publish.PublicationError, match="a is written twice"):
        publish.publish(spark.createDataFrame([("a", "x"), ("a", "y")], "path string, content string"), root)
    broken = files(spark, a="2", b="3").withColumn("content", F.when(F.col("path") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        publish.publish(broken, root)
    with pytest.raises(publish.PublicationError, match="is not whole"):
        publish.make_current(spark, root, "v9")
    assert seen(spark, root) == {"a": "1"} and len(os.listdir(tmp_path / "site/versions")) == 1
    with pytest.raises(publish.PublicationError, match="root of a file system"):
        publish.publish(files(spark, a="1"), "file:///")


# --- hosts ----------------------------------------------------------------------------------------


def test_addresses_as_numbers(spark):
    rng, texts = random.Random(7), ["", "::", "::1", "1::", "1::8", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1::2::3", ":::", ":1", "1:", "12345::", "g::", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.4 ", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "fe80::1%eth0", "1.2.3.4::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "FE80::A", "8000::", "::8000:0:0:0", "localhost", "1:2:3:4::5:6:7:8"]
    for _ in range(400):
        texts.append(str(ipaddress.ip_address(rng.getrandbits(rng.choice([8, 32, 64, 128])) if rng.random() < 0.7 else rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))))
        texts.append("".join(rng.choice("0123:.a") for _ in range(rng.randrange(12))))
    got = {r["t"]: (r["ip"], r["net"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", hosts.address(F.col("t")).alias("ip"), hosts.in_any(hosts.address(F.col("t")), ("10.0.0.0/8", "8000::/1")).alias("net")).collect()}
    for t in texts:
        try:
            ip = ipaddress.ip_address(t if "%" not in t else "no zones")
            if ip.version == 6 and t.count(":") - t.count("::") * 1 >= 7 and "::" in t and len([g for g in t.replace("::", ":").split(":") if g]) + t.count(".") // 3 >= 8:
                raise ValueError
        except ValueError:
            assert got[t] == (None, False), t
            continue
        n = int(ip) | (0xFFFF << 32 if ip.version == 4 else 0)
        assert tuple(x & (1 << 64) - 1 for x in got[t][0]) == (n >> 64, n & (1 << 64) - 1), t
        assert got[t][1] == (n >> 127 == 1 or n >> 24 == (0xFFFF << 8 | 10)), t


def test_loopback_and_allowed_hosts(spark):
    loopback = {"localhost": True, "LOCALHOST:80": True, "127.0.0.1": True, "http://127.9.9.9:8080/": True, "[::1]:1234": True, "::1": True, "[::1]": True, "https://u:p@localhost/x": True, "http://": True, "/": True, "": False, "10.0.0.1": False, "127.0.0.1.example.org": False, "example.org/127.0.0.1": False, "http://[::ffff:127.1.2.3]/": True, "localhost.": False, "[::2]:1": False, " localhost ": True, "http://evil@127.0.0.1@x.org/": False, "0.0.0.0": False, None: False}
    allowed = {"": False, " ": False, "localhost:7474": True, "site.test:80": True, "SITE.TEST": True, "evil.test": False, "[::1]": True, "[]": False, ":80": False, None: False}
    rows = spark.createDataFrame([(t,) for t in {**loopback, **allowed}], "t string")
    got = {r["t"]: r for r in rows.select("t", hosts.is_loopback(F.col("t")).alias("l"), hosts.host_allowed(F.col("t"), "[site.test]").alias("a")).collect()}
    assert {t: got[t]["l"] for t in loopback} == loopback
    assert {t: got[t]["a"] for t in allowed} == allowed


# --- bags and rules -------------------------------------------------------------------------------


def test_typed_getters(spark):
    texts = ['{"a": "x", "n": 7, "f": -2.9, "big": 1e300, "b": true, "l": ["p", "", 3, null, "q"], "o": {"k.1": {"z": "deep"}}, "e": []}', "[1]", '"text"', "not json", None, '{"a": null, "n": "7", "l": "p", "b": "true"}']
    at = lambda *p: bags.value(F.col("v"), *p)
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("v", bags.bag(F.col("t"))).select("k", bags.string(at("a")).alias("a"), bags.string(at("n")).alias("ns"), bags.integer(at("n")).alias("n"), bags.integer(at("f")).alias("f"), bags.integer(at("a")).alias("an"), bags.boolean(at("b")).alias("b"), bags.boolean(at("x"), True).alias("x"), bags.strings(at("l")).alias("l"), bags.strings(at("e")).alias("e"), bags.string(at("o", "k.1", "z")).alias("z"), bags.keys(F.col("v")).alias("keys")).orderBy("k").collect()
    assert tuple(got[0])[1:] == ("x", "", 7, -2, 0, True, True, ["p", "q"], None, "deep", ["a", "b", "big", "e", "f", "l", "n", "o"])
    assert all(tuple(r)[1:] == ("", "", 0, 0, 0, False, True, None, None, "", None) for r in got[1:5])
    assert tuple(got[5])[1:] == ("", "7", 0, 0, 0, False, True, None, None, "", ["a", "b", "l", "n"])


def test_front_matter_keeps_unknown_keys(spark):
    pages = [("a.md", "---\ntitle: T\nweight: 12\nparams:\n  hero: [x, y]\ndate: 2024-01-02\n---\nbody"), ("b.md", "no block"), ("c.md", "---\n: : :\n- x\n---\n"), ("d.md", None)]
    got = {r["rel_path"]: r for r in bags.front_matter(spark.createDataFrame(pages, "rel_path string, content string")).select("rel_path", "content", bags.integer(bags.value(F.col("bag"), "weight")).alias("w"), bags.strings(bags.value(F.col("bag"), "params", "hero")).alias("h"), bags.string(bags.value(F.col("bag"), "date")).alias("d"), F.col("bag").isNull().alias("none")).collect()}
    assert tuple(got["a.md"])[2:] == (12, ["x", "y"], "2024-01-02", False) and got["a.md"]["content"] == pages[0][1]
    assert all(got[p]["none"] for p in ("b.md", "c.md", "d.md"))


def test_rules(spark):
    said = {"Template: address already in use": rules.GUIDANCE[0].result, "bad LAYOUT": rules.GUIDANCE[1].result, "yaml": rules.GUIDANCE[2].result, "No such file": rules.GUIDANCE[3].result, "": rules.NO_GUIDANCE}
    rows = spark.createDataFrame([(t,) for t in [*said, None]], "t string").select("t", rules.guidance(F.col("t")).alias("g")).collect()
    assert {r["t"]: r["g"] for r in rows} == {**said, None: None}
    hints = {"frontmatter parse warning in docs/a.md: x": "fix frontmatter in docs/a.md", "frontmatter warning in  : x": "fix frontmatter in offending file", "Frontmatter broken IN b.md: y": "fix frontmatter in b.md", "bad frontmatter in x: y in z.md: q": "fix frontmatter in offending file", "output path collision on a case-insensitive disk": "case-only collision", "Output path collision": rules.NEXT_ACTIONS[-1].result, "an asset went missing": rules.NEXT_ACTIONS[3].result, "fine": ""}
    rows = spark.createDataFrame([(t,) for t in hints], "t string").select("t", rules.next_action(F.col("t")).alias("g")).collect()
    assert {r["t"]: r["g"] for r in rows} == hints
    types = {"a.HTML": ".html", "x/y.tar.gz": ".tar.gz", "y.gz": ".gz", "dir.js/file": "?", ".css": ".css", "a.": "?", "": "?"}
    table = {k: k for k in (".html", ".tar.gz", ".gz", ".css", ".js")}
    rows = spark.createDataFrame([(t,) for t in types], "t string").select("t", rules.by_suffix(F.col("t"), table, "?").alias("g")).collect()
    assert {r["t"]: r["g"] for r in rows} == types
    made = rules.rules_of(spark.createDataFrame([(2, [["b"]], "second"), (1, [["a", "c"], ["z"]], "first")], "position int, any_of array<array<string>>, result string"))
    rows = spark.createDataFrame([("abC",), ("ab",), ("x",)], "t string").select(rules.first_match(F.col("t"), made, "none").alias("g")).collect()
    assert [r["g"] for r in rows] == ["first", "second", "none"]


def test_binding(spark):
    rows = spark.createDataFrame([("127.0.0.1", 80, True), ("", 80, False), ("10.0.0.1", 80, True), ("10.0.0.1", 80, False), ("x", 0, True)], "h string, p int, l boolean")
    got = [r[0] for r in rows.select(hosts.binding_error(F.col("h"), F.col("p"), F.col("l"))).collect()]
    assert got[0] is None and got[1] == "ask: host cannot be empty" and got[2].startswith('ask: refusing non-loopback host "10.0.0.1"') and got[3] is None and got[4] == "ask: port must be between 1 and 65535, got 0"


def test_stored_responses(spark, tmp_path):
    root = f"file://{tmp_path}/pages"
    rows = [("repos/o/r/pulls?base=main&page=1&per_page=100&state=open", 200, "OK", json.dumps([request(4)])), ("repos/o/s/pulls?base=main&page=1&per_page=100&state=open", 429, "Slow down", "")]
    listings.store_responses(spark.createDataFrame(rows, "path string, status int, reason string, body string"), root)
    got = listings.open_requests(spark, f"{root}/responses", ["o/r", "o/s"], [], "main", transport="docweave.sources.listings:stored", errors="rows").orderBy("listing").collect()
    assert got[0]["number"] == 4 and got[1]["error"].endswith("API error status=429: 429 Slow down")


def test_stored_responses_share_files(spark, tmp_path):
    root, n = f"file://{tmp_path}/many", 3000
    path = F.format_string("repos/o/r/commits/c%d/check-runs?page=1&per_page=100", "id")
    said = F.format_string('{"total_count": 1, "check_runs": [{"status": "é\n%d", "conclusion": "%s"}]}'.replace("\n", "\\n"), "id", F.repeat(F.lit("x"), 3000))
    listings.store_responses(spark.range(n).select(path.alias("path"), F.lit(200).alias("status"), F.lit("OK").alias("reason"), said.alias("body")), root)
    assert sum(f.name.startswith("part-") for f in tmp_path.rglob("*")) <= listings.FILES
    commits = spark.range(n + 10).select(F.concat(F.lit("c"), "id").alias("sha"))
    service = listings.Service(f"{root}/responses", transport="docweave.sources.listings:stored_object")
    got = {r["sha"]: r["status"] for r in listings.check_runs(commits, service, "o/r").collect()}
    assert got == {f"c{k}": f"é\n{k}" if k < n else None for k in range(n + 10)}


def test_stored_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_folder", lambda _: f"file://{tmp_path}/mine")
    kept = storage.stored(spark.range(5).toDF("n"), "five")
    assert kept.count() == 5 and os.listdir(tmp_path / "mine")
    storage.clear(spark)
    assert not (tmp_path / "mine").exists()
    storage.clear(spark)
    assert storage.scratch_path(spark, "x").startswith(f"file://{tmp_path}/mine/x-")
