"""Configuration, the whole build with its cache."""

import json

import pytest

from docweave import config
from docweave.operators.build import OutputCollision, build, cache_path


def test_config(tmp_path):
    assert config.load(str(tmp_path / "none.yaml")) == config.Config()
    f = tmp_path / "c.yaml"
    f.write_text("siteurl: https://x.org/b/\nport: 99\nunknown: 1\n")
    c = config.load(str(f))
    assert (c.port, c.base_path, c.content_dir) == (99, "/b", "content")
    for bad in ("port: x\n", "a: [\n", "- 1\n"):
        f.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(f))


@pytest.mark.parametrize("changes", [{"port": 0}, {"siteurl": "ftp://x"}, {"content_dir": ""}, {"content_dir": "/abs"}, {"asset_dir": "../x"}, {"output_dir": "."}, {"content_dir": "public/c"}, {"output_dir": "content/out"}, {"asset_dir": "public"}])
def test_config_errors(changes):
    with pytest.raises(config.ConfigError):
        config.Config(**changes).validated()


def test_config_allows_bundles_in_the_output():
    assert config.Config(rag_dir="public/rag").validated()
    assert config.Config().resolved("/p", port=1).content_dir == "/p/content"


def site(root, files, **settings):
    for name, body in files.items():
        (root / "content" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "content" / name).write_text(body)
    return config.Config(**settings).resolved(str(root))


def test_build_and_cache(spark, tmp_path):
    c = site(tmp_path, {"index.md": "---\ntitle: Home\ndate: 2024-01-02\ntags: [a]\n---\n[x](x.md) [gone](gone.md)\n", "x.md": "# X\n\ntext\n", "_raw.md": "---\nrender: false\n---\nraw\n"}, siteurl="https://x.org")
    (tmp_path / "assets/sub").mkdir(parents=True)
    (tmp_path / "assets/sub/pic.png").write_bytes(b"\x89PNG\xff")
    (tmp_path / "assets/skip.tmp").write_text("x")
    (tmp_path / ".gitignore").write_text("*.tmp\n")
    made = build(spark, c)
    assert (made["cached"], made["pages"], made["warnings"]) == (False, 4, [])  # two pages, a tag, the list of tags
    assert made["health"]["top_tags"] == [{"tag": "a", "count": 1}] and made["health"]["node_count"] == 4
    out = tmp_path / "public"
    assert sorted(p.relative_to(out).as_posix() for p in out.rglob("*") if p.is_file()) == ["_raw.md", "assets/sub/pic.png", "backlinks.json", "feed.xml", "gone/index.html", "graph.json", "graph/data.json", "meta.json", "robots.txt", "search.json", "sitemap.xml"]
    assert (out / "_raw.md").read_text() == "---\nrender: false\n---\nraw\n" and (out / "assets/sub/pic.png").read_bytes() == b"\x89PNG\xff"
    assert '<a href="../">index.md</a>' in (out / "gone/index.html").read_text()
    assert (tmp_path / ".build-cache.json").exists()
    assert build(spark, c) == made | {"cached": True}
    (out / "meta.json").write_text("{}")
    assert build(spark, c)["cached"] is False
    (tmp_path / "content/_raw.md").write_text("---\nrender: false\n---\nother\n")
    assert build(spark, c)["cached"] is False
    (tmp_path / "assets/sub/pic.png").write_bytes(b"\x89PNG\xfe")
    assert build(spark, c)["cached"] is False and build(spark, c)["cached"] is True
    (tmp_path / ".build-cache.json").write_text("{")
    assert build(spark, c)["cached"] is False


def test_golden_documents(spark, tmp_path):
    c = site(
        tmp_path,
        {
            "index.md": "---\ntitle: A & B <i>\ndate: 2024-03-05\ndescription: d\n---\n[one](post.md) [two](post.md?q=1#f) [again][p] [gone](/gone-far.md) [raw](raw.md) [out](https://x.org/a.md)\n\n[p]: post.md\n",
            "post.md": "---\nauthor: Ann\ntags: [go, Test]\nslug: my-post\n---\n# Head\nwords here [back](index.md)\n",
            "raw.md": "---\nrender: false\n---\nx [self](raw.md)\n",
        },
        siteurl="https://x.org/base",
        site_name="S & T",
    )
    build(spark, c)
    read = lambda name: (tmp_path / "public" / name).read_text()
    assert json.loads(read("graph.json")) == {
        "nodes": {"gone-far": {"type": "stub", "referenced_by": ["index.md"], "render": True, "missing": True}, "index": {"type": "page", "render": True}, "post": {"type": "page", "render": True}, "raw.md": {"type": "page", "render": False}},
        "edges": [["index", "post"], ["index", "post"], ["index", "post"], ["index", "gone-far"], ["index", "raw.md"], ["post", "index"], ["raw.md", "raw.md"]],
    }
    assert read("graph.json").startswith('{\n  "nodes": {\n    "gone-far": {\n      "type": "stub",\n      "referenced_by": [\n        "index.md"\n      ],\n      "render": true,\n      "missing": true\n    },\n    "index": {')
    assert read("graph.json").endswith('    [\n      "raw.md",\n      "raw.md"\n    ]\n  ]\n}\n')
    assert read("backlinks.json") == '{\n  "gone-far": [\n    "index"\n  ],\n  "index": [\n    "post"\n  ],\n  "post": [\n    "index",\n    "index",\n    "index"\n  ],\n  "raw.md": [\n    "index",\n    "raw.md"\n  ]\n}\n'
    assert read("meta.json") == (
        '{\n  "index": {\n    "date": "2024-03-05",\n    "render": true,\n    "title": "A \\u0026 B \\u003ci\\u003e",\n    "url": "/base/",\n    "word_count": 8\n  },\n'
        '  "post": {\n    "author": "Ann",\n    "render": true,\n    "tags": [\n      "go",\n      "test"\n    ],\n    "title": "post.md",\n    "url": "/base/my-post/",\n    "word_count": 5\n  },\n'
        '  "raw.md": {\n    "render": false,\n    "title": "raw.md",\n    "word_count": 2\n  }\n}\n'
    )
    assert read("search.json") == (
        '[{"t":"A \\u0026 B \\u003ci\\u003e","u":"/base/","s":"one two againp gone raw out p: post.md"},{"t":"post.md","u":"/base/my-post/","g":["go","test"],"s":"Head words here back","h":["Head"]},'
        '{"t":"Tags","u":"/base/tags/"},{"t":"Tag: go","u":"/base/tags/go/","g":["go"]},{"t":"Tag: test","u":"/base/tags/test/","g":["test"]}]\n'
    )
    data = json.loads(read("graph/data.json"))
    assert (data["base_path"], data["large_site_threshold"]) == ("/base", 500)
    assert data["edges"] == [["index", "gone-far"], ["index", "post"], ["index", "raw.md"], ["post", "index"], ["raw.md", "raw.md"]]
    assert [n["id"] for n in data["nodes"]] == ["gone-far", "index", "post", "raw.md"]
    assert data["nodes"][0] == {"type": "stub", "id": "gone-far", "title": "Gone Far", "inbound": ["index"], "outbound": [], "word_count": 0, "orphan": False, "stub": True, "render": True}
    assert list(data["nodes"][2].items()) == [("author", "Ann"), ("url", "/base/my-post/"), ("type", "page"), ("id", "post"), ("title", "post.md"), ("inbound", ["index"]), ("tags", ["go", "test"]), ("outbound", ["index"]), ("word_count", 5), ("orphan", False), ("stub", False), ("render", True)]
    assert read("sitemap.xml") == '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n' + "".join(f"  <url>\n    <loc>https://x.org/base/{u}</loc>\n  </url>\n" for u in ("", "my-post/", "tags/", "tags/go/", "tags/test/")) + "</urlset>\n"
    assert read("robots.txt") == "User-agent: *\nAllow: /\n\nSitemap: https://x.org/base/sitemap.xml\n"
    assert read("feed.xml") == (
        '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n  <channel>\n    <title>S &amp; T</title>\n    <link>https://x.org/base/</link>\n    <item>\n      <title>A &amp; B &lt;i&gt;</title>\n'
        "      <link>https://x.org/base/</link>\n      <guid>https://x.org/base/</guid>\n      <pubDate>Tue, 05 Mar 2024 00:00:00 +0000</pubDate>\n      <description>one two againp gone raw out p: post.md</description>\n    </item>\n  </channel>\n</rss>\n"
    )


def test_a_site_without_an_address(spark, tmp_path):
    c = site(tmp_path, {"index.md": "[q](#a) [r](?x=1)\n", "a/b.md": "plain\n"}, graph_explorer=False)
    build(spark, c)
    read = lambda name: (tmp_path / "public" / name).read_text()
    assert read("backlinks.json") == "{}\n" and json.loads(read("graph.json"))["edges"] == []
    assert "<loc>/</loc>" in read("sitemap.xml") and "<loc>/a/b/</loc>" in read("sitemap.xml") and read("robots.txt") == "User-agent: *\nAllow: /\n"
    assert not (tmp_path / "public/feed.xml").exists() and not (tmp_path / "public/graph").exists()


@pytest.mark.parametrize(
    "files,settings,message",
    [
        ({"a.md": "---\nslug: x\n---\n", "x.md": ""}, {}, 'output path collision: "a.md" and "x.md" both map to "x/index.html"'),
        ({"graph/index.md": ""}, {}, 'output path collision: "graph/index.md" and the knowledge graph explorer (disable with graph_explorer: false) both map to "graph/index.html"'),
        ({"a.md": "---\ntags: go\n---\n", "tags/go.md": ""}, {}, 'output path collision: "tags/go.md" and the generated taxonomy page both map to "tags/go/index.html"'),
        ({"graph/index.md": ""}, {"graph_explorer": False}, None),
        ({"A.md": "", "a.md": ""}, {}, "warning"),
        ({"index.md": "[t](tags.md)", "x.md": "---\ntags: go\n---\n"}, {}, None),
    ],
)
def test_writers_of_the_same_file(spark, tmp_path, files, settings, message):
    c = site(tmp_path, files, **settings)
    if message and message != "warning":
        with pytest.raises(OutputCollision) as e:
            build(spark, c)
        assert str(e.value) == message and not (tmp_path / "public").exists()
    else:
        warnings = build(spark, c)["warnings"]
        assert [w.startswith('output path warning: "A.md" maps to "A/index.html" and "a.md" maps to "a/index.html"') for w in warnings] == [True] * (message is not None)
        assert not (tmp_path / "public/tags/index.html").exists()  # no stub stands in the place of a listing


def test_assets_that_hold_the_output_and_cache_places(spark, tmp_path):
    from docweave.sources import bundles

    (tmp_path / "a/public").mkdir(parents=True)
    with pytest.raises(ValueError):
        bundles.site_assets(spark, str(tmp_path / "a"), str(tmp_path), str(tmp_path / "a/public"))
    assert cache_path(config.Config(project_root="/p", output_dir="/p/public")) == "/p/.build-cache.json"
    assert cache_path(config.Config(project_root="", output_dir="/q/out")) == "/q/.out.build-cache.json"
