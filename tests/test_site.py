"""Golden shapes: small sites read from files, and operators on them."""

import json
import math
import random

import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import answers, build, checks, graph, manifest, policy, retrieval, site
from docweave.plans import site_queries
from docweave.sources import bundles, markdown, sinks
from docweave.streaming import changes

PAGES = {
    "index.md": "---\ntitle: Home\ndate: 2024-01-02\ntags: [Go, go, C++]\n---\n# Home\n[a](a.md) [a again](a.md?q=1#f) [gone](/gone.md) ![img](b.md) `[no](b.md)`\n",
    "a.md": "---\nTitle: lower\ntitle: A page\nslug: post\ncategory: News\ncategories: [x]\n---\ntext [up](index.md) [ref][r] [ext](https://e.org/x.md)\n\n[r]: sub/b.md\n",
    "sub/b.md": "---\nrender: false\ndate: 2024-13-01\nslug: s\ntags: one\n---\nraw [rel](../gone.md) [self](b.md)\n",
    "broken.md": "---\ntitle: [unclosed\n---\nbody\n",
    "alone.md": "no front matter, five words\n",
}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    for name, body in PAGES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(body)
    (root / "note.txt").write_text("not a page")
    return markdown.documents(markdown.read_files(spark, str(root))).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_documents(docs):
    got = {r["rel_path"]: r for r in docs.collect()}
    assert set(got) == set(PAGES)
    assert got["index.md"]["tags"] == ["go", "c"] and got["index.md"]["date"] == "2024-01-02"
    assert got["a.md"]["title"] == "A page" and got["a.md"]["categories"] == ["x", "news"] and got["a.md"]["warnings"]
    assert got["sub/b.md"]["render"] is False and got["sub/b.md"]["date"] is None and got["sub/b.md"]["tags"] == ["one"]
    assert got["broken.md"]["parse_error"] and got["broken.md"]["body"] == PAGES["broken.md"]


def test_edges_and_stubs(docs):
    edge = graph.edges(docs)
    assert rows(edge, "src", "dst") == [("a", "index"), ("a", "sub/b.md"), ("index", "a"), ("index", "a"), ("index", "gone"), ("sub/b.md", "gone"), ("sub/b.md", "sub/b.md")]
    assert [tuple(r)[:2] for r in graph.ordered_edges(edge).filter("src = 'index'").collect()] == [("index", "a"), ("index", "a"), ("index", "gone")]
    assert rows(graph.missing_targets(docs), "target", F.array_join("referenced_by", ",")) == [("gone.md", "index.md,sub/b.md")]
    assert rows(graph.backlinks(edge).filter("id = 'a'"), F.array_join("sources", ",")) == [("index,index",)]
    adj = {r["id"]: r for r in graph.adjacency(graph.nodes(docs).select("id"), edge).collect()}
    assert adj["a"]["inbound"] == ["index"] and adj["alone"]["inbound"] == [] and adj["sub/b.md"]["outbound"] == ["gone", "sub/b.md"]


def test_three_kinds_of_orphans(docs):
    edge = graph.edges(docs)
    assert rows(graph.orphans_health(docs, edge), "id") == [("alone",), ("broken",)]
    assert rows(graph.orphans_explorer(graph.nodes(docs), edge), "id") == [("alone",), ("broken",)]
    assert rows(graph.orphans_checker(docs), "rel_path") == [("alone.md",), ("broken.md",)]


def test_site_tables(docs, tmp_path):
    assert rows(site.tag_counts(docs), "tag", "n") == [("c", 1), ("go", 1), ("one", 1)]
    assert rows(site.taxonomy_groups(docs), "kind", "term") == [("category", "news"), ("category", "x"), ("tag", "c"), ("tag", "go")]
    items = site.search_index(docs)
    assert [r["u"] for r in site.search(items, "HOME").collect()] == ["/"]
    assert site.search(items, "  ").count() == 0
    health = site.health(docs, graph.edges(docs), graph.nodes(docs)).first()
    words = sum(len(r["body"].split()) for r in docs.filter("rel_path <> 'sub/b.md'").collect())
    assert (health["pages"], health["total_word_count"], health["edge_count"], health["node_count"], health["orphaned_pages"]) == (4, words, 7, 6, ["alone", "broken"])
    assert health["missing_dates"] == ["a", "alone", "broken"] and len(health["missing_descriptions"]) == 4
    with sinks.Publication(str(tmp_path / "out")) as staging:
        sinks.write_json(site.search_order(items), f"{staging}/search.json", pretty=False)
        sinks.write_json(site.page_meta(docs), f"{staging}/meta.json", key="id")
        build.graph_json({"nodes": graph.nodes(docs), "edges": graph.edges(docs)}, f"{staging}/graph.json")
    assert json.loads((tmp_path / "out/meta.json").read_text())["a"]["url"] == "/post/"
    assert json.loads((tmp_path / "out/graph.json").read_text())["nodes"]["gone"]["referenced_by"] == ["index.md", "sub/b.md"]
    with pytest.raises(RuntimeError):
        with sinks.Publication(str(tmp_path / "out")) as staging:
            raise RuntimeError
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_checks(docs):
    found = {(r["file"], r["level"], r["category"]) for r in checks.validate(docs).collect()}
    assert ("broken.md", "ERROR", "missing_metadata") in found
    assert ("sub/b.md", "ERROR", "missing_metadata") in found and ("index.md", "ERROR", "broken_links") in found
    lines = [r["value"] for r in checks.report_lines(checks.broken_links(docs)).collect()]
    assert any(x.startswith("[ERROR] index.md:7: broken internal link") for x in lines)


def test_bundles(spark, tmp_path):
    files = spark.createDataFrame([("b.md", "x\n</content>\n\\<file \n"), ("a.md", "hello")], "path string, content string")
    sinks.write_text(bundles.bundle_text(files), str(tmp_path / "rag-content.md"))
    got = bundles.read_bundles(spark, str(tmp_path))
    assert rows(got, "path", "text") == [("a.md", "hello"), ("b.md", "x\n</content>\n\\<file \n")]
    bad = ["", "<content>\n", "<file path=\"a\">\n<file path=\"b\">\n", "<file >\n", "<file path=\"a\">\n<content>\nx\n</file>\n", "<file path=\"a\">\n<content>\nx\n"]
    for b in bad:
        with pytest.raises(bundles.MalformedBundle):
            list(bundles.parse_bundle("x", b))


def test_chunks_and_enrichment(spark):
    page = spark.createDataFrame([("content/p.md", "T", "intro\n## One\ntext\n### Two ##\n"), ("q.md", "Q", "plain"), ("r.md", "R", None)], "source_path string, title string, body string")
    got = retrieval.chunks(page).orderBy("source_path", "position").collect()
    assert [(c["id"], c["heading_path"], c["text"]) for c in got] == [("p#h0", [], "intro"), ("p#h2-one", ["One"], "text"), ("p#h3-two", ["Two", "One"], ""), ("q#h0", [], "plain"), ("r#h0", [], "")]


def test_ranking(spark):
    docs = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "x", "x"]), ("c", [])], "id string, tokens array<string>")
    assert [r["id"] for r in retrieval.rank_one(docs, "x x").collect()] == ["b", "a"]
    assert retrieval.rank_one(docs, "nonsense").count() == 0 and retrieval.rank_one(docs, "").count() == 0
    asked = spark.createDataFrame([(1, "x x"), (2, "y zzz")], "query_id int, query string")
    one = {r["id"]: r["score"] for r in retrieval.rank_one(docs, "x x").collect()}
    many = {r["id"]: r["score"] for r in retrieval.rank_batch(docs, asked).filter("query_id = 1").collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_answers(spark):
    docs = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "id string, tokens array<string>")
    asked = spark.createDataFrame([(1, "x"), (2, "zzz"), (3, " ")], "question_id int, question string")
    status = lambda mode: {r["question_id"]: r["status"] for r in answers.answers(asked, docs, answers.FakeProvider(mode)).collect()}
    assert status("cite") == {1: "answered", 2: "no_answer", 3: "error"}
    assert status("miss")[1] == "no_answer" and status("empty")[1] == "answered"
    hits = spark.createDataFrame([(1, r, "w" * 300) for r in range(1, 12)], "question_id int, rank int, text string")
    blocks = answers.prompt_blocks(hits, 0, 400).orderBy("rank").collect()
    assert [b["kept_bytes"] for b in blocks] == [168, 168, 64] and blocks[0]["block"].startswith("\n[1]\nwww")


def test_policy_gates(spark):
    good = dict(author="Bot", base_ref="main", draft=False, labels=["AUTOMERGE"], head_ref="deps/x", mergeable=True, check_state="passing")
    cases = [({}, "would_merge"), ({"author": "me"}, "skip"), ({"base_ref": "dev"}, "skip"), ({"draft": True}, "skip"), ({"labels": []}, "skip"), ({"head_ref": "x"}, "skip"), ({"mergeable": None}, "skip"), ({"mergeable": False}, "skip"), ({"check_state": "none"}, "skip"), ({"check_state": "failed"}, "skip")]
    schema = "author string, base_ref string, draft boolean, labels array<string>, head_ref string, mergeable boolean, check_state string, want string"
    df = spark.createDataFrame([tuple((good | c).values()) + (w,) for c, w in cases], schema)
    p = policy.Policy(authors=["bot"], prefixes=["deps/"])
    assert [(r["want"], r["action"]) for r in policy.decide(df, p).collect() if r["want"] != r["action"]] == []
    closing = policy.Policy(authors=["bot"], close_conflicts=True, apply=True)
    assert [r["action"] for r in policy.decide(df.filter("mergeable = false"), closing).collect()] == ["close"]


def test_manifest_cache(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    m = manifest.manifest(files)
    assert manifest.difference(m, m).count() == 0
    assert manifest.fingerprint(m, "v").first() == manifest.fingerprint(m.orderBy(F.desc("path")), "v").first()
    assert manifest.fingerprint(m, "v").first() != manifest.fingerprint(m, "w").first()


def test_ignore_rules_and_patterns(spark):
    import re

    paths = ["a.tmp", "keep/a.tmp", "x/y/build/z", "x.go", "testdata/q", "docs/a/b.txt", "docs/b.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rules = bundles.ignore_rules(["*.tmp", "!keep/*.tmp", "build/", "/docs/*.txt"])
    got = {r["path"]: r["i"] for r in df.select("path", bundles.ignored(F.col("path"), rules).alias("i")).collect()}
    assert got == {"a.tmp": True, "keep/a.tmp": False, "x/y/build/z": True, "x.go": True, "testdata/q": True, "docs/a/b.txt": False, "docs/b.txt": True}
    assert re.match(bundles.pattern_regex("a/**/*.md"), "a/b/c.md") and not re.match(bundles.pattern_regex("a/*.md"), "a/b/c.md")


def test_pages_of_a_listing(spark):
    fetch = lambda page, size: [json.dumps({"n": k}) for k in range(250)][(page - 1) * size : page * size]
    assert bundles.paginated(spark, fetch, pages=4).count() == 250
    with pytest.raises(Exception, match="more than 2 pages"):
        bundles.paginated(spark, fetch, pages=2).count()


def test_streamed_sessions_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = changes.sessions(stream, "user_id", "30 minutes", "1 hour").writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("sess").collect()}
    whole = {tuple(r) for r in changes.sessions(events, "user_id", "30 minutes").collect()}
    assert got <= whole and len(whole - got) <= 5


def test_rebuild_calls_reload_after_success_only(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("x")
    built, reloaded = [], []
    stream = changes.changed_files(spark, str(src))

    def build(batch, epoch):
        built.append(batch.count())
        if (src / "bad.md").exists():
            raise RuntimeError

    changes.rebuild_on_change(stream, build, reloaded.append, str(tmp_path / "ck")).awaitTermination()
    (src / "bad.md").write_text("y")
    failed = []
    changes.rebuild_on_change(stream, build, reloaded.append, str(tmp_path / "ck"), failed=lambda epoch, e: failed.append(type(e))).awaitTermination()
    assert built == [1, 1] and len(reloaded) == 1 and failed == [RuntimeError]


def test_explorer_query(spark):
    node = spark.createDataFrame([("a/x", "Alpha", ["go"], ["c1"], "Ann"), ("b", "Beta", ["rust"], [], None)], "id string, title string, tags array<string>, categories array<string>, author string")
    hits = lambda q: [r["id"] for r in node.filter(graph.explorer_filter(q)).orderBy("id").collect()]
    assert hits("") == ["a/x", "b"] and hits("tag:GO") == ["a/x"] and hits("tag:") == [] and hits("cat:c1 author:ann") == ["a/x"]
    assert hits("id:b") == ["b"] and hits("ru") == ["b"] and hits("x:y") == []


def test_asset_and_publish_rules(spark):
    assets = spark.createDataFrame([("a.png", 6 << 20, False), ("A.png", 1, False), ("l", 1, True), ("../out.png", 9, False), ("x.psd", 1, False)], "path string, size long, symlink boolean")
    assert sorted(r["message"] for r in checks.asset_files(assets).collect()) == [
        'asset case-collision / duplicate destination risk: "A.png" and "a.png" map to the same destination "a.png"',
        'asset path "../out.png" escapes configured asset root "assets"',
        "symlink in asset directory skipped: l",
        'unsupported or suspicious image extension ".psd": prefer web-optimized formats (.png, .jpg, .webp, .svg, .avif)',
        "unusually large raster asset (6.0 MB > 5.0 MB threshold)",
    ]
    pages = spark.createDataFrame([("x/index.html", '<a href="/y/">y</a><img src="i.png"><a href="z.html">z</a><a href="#q">q</a><a href="mailto:a@b.c">m</a><a href="../..">up</a>')], "path string, html string")
    files = spark.createDataFrame([("y/index.html",), ("x/z/index.html",)], "path string")
    assert rows(checks.missing_references(pages, files), "path", "reference") == [("x/index.html", "../.."), ("x/index.html", "i.png")]
    named = spark.createDataFrame([(".staging-1/a", False), ("a", True), ("ok", False)], "path string, symlink boolean")
    assert checks.forbidden_files(named).count() == 2
    assert [r["path"] for r in checks.published_manifest(named.filter("path = 'ok'")).collect()] == ["ok"]
    with pytest.raises(Exception, match="not to be published"):
        checks.published_manifest(named).collect()


def test_one_tokenisation_in_ranking_plans(spark, sf, capsys):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))
    for plan in (retrieval.rank_one(docs, "the thing is ation", 8), retrieval.term_idf(docs)):
        plan.explain("formatted")
        assert capsys.readouterr().out.count("regexp_replace(lower(") == 1


def test_builds_of_a_single_slot(spark):
    import random

    rng = random.Random(1)
    rows_ = [(k, sorted(rng.uniform(0, 300) for _ in range(rng.randint(0, 40)))) for k in range(20)]
    flat = spark.createDataFrame([(k, t) for k, ts in rows_ for t in ts], "k int, s double").select("k", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    got = {(r["k"], round(r["s"], 3), r["triggers"]) for r in changes.single_slot_builds(flat.repartition(4), "k", 10).select("k", (F.unix_micros("start") / 1e6).alias("s"), "triggers").collect()}
    want = set()
    for k, ts in rows_:  # a builder that is stepped through time
        free, queued, start = 0.0, 0, None
        for t in ts:
            t = int(t * 1_000_000) / 1e6
            if start is not None and t <= start:
                queued += 1
                continue
            if start is not None:
                want.add((k, round(start, 3), queued))
            start, queued = max(t, free), 1
            free = start + 10
        if start is not None:
            want.add((k, round(start, 3), queued))
    assert got == want


def test_polling_sees_all_kinds_of_changes(spark, tmp_path):
    (tmp_path / "content/sub").mkdir(parents=True)
    (tmp_path / "public").mkdir()
    (tmp_path / "content/_index.md").write_text("a")
    (tmp_path / "content/b.md").write_text("b")
    folders = [str(tmp_path / "content"), str(tmp_path / "public"), str(tmp_path / "none")]
    found, last = changes.poll(spark, folders, None, str(tmp_path / "public"))
    assert found.count() == 0 and last.count() == 2
    (tmp_path / "content/b.md").unlink()
    (tmp_path / "content/_index.md").write_text("changed")
    (tmp_path / "content/sub/new.md").write_text("n")
    (tmp_path / "public/x.html").write_text("not watched")
    found, last = changes.poll(spark, folders, last, str(tmp_path / "public"))
    assert sorted((r["path"].rpartition("/")[2], r["change"]) for r in found.collect()) == [("_index.md", "modified"), ("b.md", "removed"), ("new.md", "added")]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "in/_x").mkdir(parents=True)
    for name in ("a b+c.md", "_index.md", ".hidden.md", "_x/d.md", "no.txt"):
        (tmp_path / "in" / name).write_text(f"# {name}")
    (tmp_path / "in/empty.md").write_text("")
    (tmp_path / "in/_empty.md").write_text("")
    (tmp_path / "far.md").write_text("far")
    (tmp_path / "in/link.md").symlink_to(tmp_path / "far.md")
    (tmp_path / "in/links").symlink_to(tmp_path / "in/_x")
    got = {r["rel_path"]: r["content"] for r in markdown.read_files(spark, str(tmp_path / "in")).collect()}
    assert got == {n: f"# {n}" for n in ("a b+c.md", "_index.md", ".hidden.md", "_x/d.md")} | {"empty.md": "", "_empty.md": ""}
    (tmp_path / "root").symlink_to(tmp_path / "in")
    assert markdown.read_files(spark, str(tmp_path / "root"), "*", binary=True).count() == 7


def test_corpus_load(spark, tmp_path):
    files = [("content/a.md", "---\ntitle: A\n---\nintro\n## One\ntext"), ("content/raw.md", "---\nrender: off\n---\nx"), ("content/", "content/a.md (size: 1 bytes)")]
    rag = tmp_path / "rag"
    rag.mkdir()
    with pytest.raises(retrieval.EmptyCorpus):
        retrieval.load(spark, str(rag))
    with pytest.raises(ValueError):
        retrieval.load(spark, str(tmp_path / "none"))
    sinks.write_text(bundles.bundle_text(spark.createDataFrame(files, "path string, content string")), str(rag / "rag-content.md"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out/meta.json").write_text('{"a": {"title": "Meta", "url": "/b/a/"}}')
    (tmp_path / "out/search.json").write_text('[{"t": "S", "u": "/b/a/"}]')
    corpus = retrieval.load(spark, str(rag), output_dir=str(tmp_path / "out"))
    assert corpus.missing == ["rag-system.md", "rag-config.md"]
    assert [(c["id"], c["title"], c["url"], c["source_kind"]) for c in corpus.chunks.collect()] == [("a#h0", "A", "/b/a/", "rag-content"), ("a#h2-one", "A", "/b/a/", "rag-content")]
    assert corpus.report.first().asDict() == {"version": "v1", "documents": 2, "site_documents": 2, "chunks": 2, "ready": True}
    (rag / "rag-system.md").write_text("<file path='x'>\n")
    with pytest.raises(bundles.MalformedBundle):
        retrieval.load(spark, str(rag))


def test_bundles_of_a_project(spark):
    files = spark.createDataFrame([("content/a.md", "x"), ("content/jules/b.md", "y"), ("cmd/m.go", "package m"), ("internal/config/c.go", "package c"), ("README.md", "r")], "path string, content string")
    text_of = lambda df: "\n".join(r["value"] for r in df.collect()) + "\n"
    paths_of = lambda df: [p for p, _ in bundles.parse_bundle("b", text_of(df))]
    assert paths_of(bundles.content_bundle(files)) == ["content/a.md"] and paths_of(bundles.system_bundle(files)) == ["README.md", "cmd/m.go"]
    listing = spark.createDataFrame([("assets/x.png (size: 3 bytes)",), ("assets/",)], "value string")
    both = bundles.config_bundle(files, {"assets": listing})
    assert list(bundles.parse_bundle("b", text_of(both))) == [("internal/config/c.go", "package c"), ("assets/", "assets/\nassets/x.png (size: 3 bytes)")]
    assert [bundles.bundle_folder(f, "content", "/p") for f in ("docs", "/p/docs", "../x", "")] == ["docs", "docs", "content", "content"]


def plain_bm25(docs, query, k):
    """(score rounded, id) of the best k by a plain sum."""
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in query:
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            if term in d:
                tf = d.count(term)
                scores[i] = scores.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
    return sorted(((-round(s, 9), i) for i, s in scores.items()))[:k]


def test_pruned_batches_equal_a_plain_ranking(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    pick = lambda: words[min(299, int(rng.paretovariate(0.6)) - 1)]
    docs = {i: [pick() for _ in range(rng.randrange(0, 60))] for i in range(600)}
    docs |= {600 + i: docs[5] for i in range(20)}  # ties
    asked = {q: [pick() for _ in range(rng.randrange(0, 9))] + [rng.choice(words)] for q in range(40)} | {40: ["absent"], 41: ["w0"], 42: docs[5][:4]}
    made, kept = {}, retrieval.stored

    def counted(df, label):
        out = kept(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(retrieval, "stored", counted)
    tokens = spark.createDataFrame(list(docs.items()), "id long, tokens array<string>").repartition(3)
    questions = spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "query_id long, query string")
    for k, plain in ((1, 0), (5, 0), (50, 0), (5, 10**9)):
        made.clear()
        got = {}
        for r in retrieval.rank_batch(tokens, questions, k, plain).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], -round(r["score"], 6), r["id"]))
        for q, terms in asked.items():
            want = [(n + 1, round(s, 6), i) for n, (s, i) in enumerate(plain_bm25(docs, terms, k))]
            assert sorted(got.get(q, [])) == want, (k, q)
        pairs = sum(sum(t in d for t in set(terms)) for terms in asked.values() for d in docs.values())
        if k == 5 and not plain:
            assert made["partial-scores"] < pairs / 3 and made["candidates"] < pairs / 4


def test_tasks_of_batches_do_not_grow_with_the_table(spark, monkeypatch):
    most, kept = {}, retrieval.stored

    def watched(df, label):
        if label == "postings":
            assert "keys=[id" not in df._jdf.queryExecution().executedPlan().toString()
        if label == "partial-scores":
            most[n] = max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        return kept(df, label)

    monkeypatch.setattr(retrieval, "stored", watched)
    monkeypatch.setattr(retrieval, "TASK_ROWS", 500, raising=False)
    asked = spark.createDataFrame([(q, f"w{q % 7} w{q % 5} all") for q in range(10)], "query_id long, query string")
    for n in (300, 2400):
        docs = spark.range(n).select("id", F.array(F.lit("all"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")), F.concat(F.lit("w"), (F.col("id") % 5).cast("string"))).alias("tokens"))
        assert retrieval.rank_batch(docs, asked, 3, 0).count() == 30
    assert most[2400] < 2 * most[300]


def test_batches_over_repeated_ids_and_rows_without_tokens(spark):
    rows = [(1, ["x", "y"]), (1, ["x", "y"]), (1, ["x", "z", "z"]), (2, ["x"]), (2, ["y"] * 9), (3, ["z", "q"]), (4, []), (5, None)] + [(10 + i, ["x", "q", "q", f"u{i}"]) for i in range(30)]
    n, avg = len(rows), sum(len(t or []) for _, t in rows) / (len(rows) - 1)
    post = {}
    for i, tokens in rows:
        for t in tokens or []:
            post[t, i, len(tokens)] = post.get((t, i, len(tokens)), 0) + 1
    asked = {1: ["x"], 2: ["x", "y", "y"], 3: ["q", "z", "u7"], 4: ["x", "q"]}
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    questions = spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "query_id long, query string")
    for k, plain in ((1, 0), (3, 0), (3, 10**9)):
        got = {}
        for r in retrieval.rank_batch(df, questions, k, plain).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 5)))
        for q, terms in asked.items():
            scores = {}
            for t in terms:
                hits = {p: tf for p, tf in post.items() if p[0] == t}
                for (_, i, size), tf in hits.items():
                    scores[i] = scores.get(i, 0) + math.log(1 + (n - len(hits) + 0.5) / (len(hits) + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avg))
            want = sorted((-round(s, 9), i) for i, s in scores.items())[:k]
            assert sorted(got[q]) == [(r + 1, i, round(-s, 5)) for r, (s, i) in enumerate(want)], (k, plain, q)


def test_lists_of_hubs_are_cut(spark):
    rows = [(f"s{k:05}", "hub") for k in range(5000)] + [(f"s{k:05}", "hub") for k in range(10)] + [("a", "b"), ("b", "a"), ("a", "a")]
    edge = spark.createDataFrame(rows, "src string, dst string").repartition(6)
    got = {(r["id"], r["chunk"]): r["sources"] for r in graph.backlink_chunks(edge, 100).collect()}
    hub = [x for i in range(52) for x in got.get(("hub", i), [])]
    assert hub == sorted(s for s, d in rows if d == "hub") and max(map(len, got.values())) == 100
    assert got["b", 0] == ["a"] and got["a", 0] == ["a", "b"]
    whole = {r["id"]: r for r in graph.adjacency(spark.createDataFrame([("alone",)], "id string"), edge).collect()}
    lists = {}
    for r in sorted(graph.adjacency_chunks(spark.createDataFrame([("alone",), ("a",)], "id string"), edge, 100).collect(), key=lambda r: r["chunk"]):
        lists.setdefault((r["id"], r["direction"]), []).extend(r["neighbours"])
    assert lists.pop(("alone", None)) == []
    assert lists == {(i, way): r[way] for i, r in whole.items() for way in ("inbound", "outbound") if r[way]}


def test_postings_of_rows_and_of_repeated_ids(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c"] * 300 + ["a"]), (None, ["x"])]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    once = {("b", 1, 2), ("a", 1, 1), ("c", 4, 300), ("a", 4, 1), ("x", None, 1)}
    plain = retrieval.postings(docs)
    assert {tuple(r) for r in plain.collect()} == once and "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    twice = {tuple(r) for r in retrieval.postings(docs.unionByName(docs.filter("id = 1"))).collect()}
    assert twice == once - {("b", 1, 2), ("a", 1, 1)} | {("b", 1, 4), ("a", 1, 2)}


def test_both_yaml_loaders_give_the_same():
    rng = random.Random(3)
    pieces = ["title", "tags", "a b", "é: ü", ": ", ":", "\n", "\n  ", "\n- ", "- ", "[", "]", "{", "}", ", ", "1", "0x1f", "yes", "~", "'", '"', "#", " # c", "&a ", "*a", "!", "!t ", ">", "|", "?", "%", "@", "\\", "\t", "\x85", "\ufeff", "---\n", "<<: ", "=", "2024-01-02", "1:30", ".inf"]

    def value(load, block):
        try:
            return repr(load(block))
        except (yaml.YAMLError, ValueError) as e:
            return str(e)

    blocks = ["title: " * (k % 2) + "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for k in range(5000)]
    assert [b for b in blocks if value(markdown.load_yaml, b) != value(lambda x: yaml.load(x, Loader=markdown._Loader), b)] == []
    assert sum(bool(markdown._COMMON.match(b)) for b in blocks) > 500 and issubclass(markdown._FastLoader, yaml.CSafeLoader)


def test_pages_of_a_small_file_are_parsed_in_many_tasks(spark, sf):
    for pages in (site_queries.varied_pages(spark, sf), site_queries._front_files(spark, sf)):
        assert markdown.documents(pages).select(F.spark_partition_id()).distinct().count() > 3


def test_files_of_bundles_leave_in_bounded_batches():
    values = [f'<file path="{k}">\n<content>\n{"x" * 1_000_000}\n</content>\n</file>\n' for k in range(13)] + ["<file >\n"]
    batch = pa.RecordBatch.from_pydict({"bundle": [f"b{k}" for k in range(14)], "value": values})
    got = list(bundles.parsed_batches(iter([batch]), keep_errors=True))
    assert len(got) > 2 and max(b.nbytes for b in got) < 2 * bundles.BATCH_CHARS
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["bundle"], r["path"], len(r["text"] or "")) for r in rows[:13]] == [(f"b{k}", str(k), 1_000_000) for k in range(13)]
    assert rows[13]["path"] is None and rows[13]["error"]
