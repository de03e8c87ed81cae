"""Artifacts: JSON, XML and text documents from DataFrames, and their atomic publication."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs that JSON documents of a site write as escapes, so that they may stand in HTML.
_ESCAPES = (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"))


def _json(value, pretty: bool) -> str:
    out = json.dumps(value, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))
    for sign, escape in _ESCAPES:
        out = out.replace(sign, escape)
    return out


def filled(c: Column) -> Column:
    """Null, which JSON leaves out, for an empty text."""
    return F.when(c != "", c)


def some(c: Column) -> Column:
    """Null, which JSON leaves out, for an empty list."""
    return F.when(F.size(c) > 0, c)


def rows_json(rows: DataFrame, key: str | None = None, value: Column | None = None) -> Iterator[tuple[str | None, object]]:
    """(key, value) of rows in their order (with a key: in its order). Rows are streamed to the driver, which never
    holds more than one partition."""
    value = F.to_json(F.struct(*[c for c in rows.columns if c != key])) if value is None else F.to_json(value)
    lines = rows.orderBy(key).select(key, value.alias("v")) if key else rows.select(F.lit(None).cast("string"), value.alias("v"))
    for row in lines.toLocalIterator():
        yield row[0], json.loads(row["v"])


def _nested(f, items: Iterator[tuple[str | None, object]], keyed: bool, pretty: bool, depth: int) -> None:
    pad, first = "\n" + "  " * (depth + 1), True
    f.write("{" if keyed else "[")
    for k, v in items:
        body = _json(v, pretty)
        if pretty:
            body = body.replace("\n", pad)
        f.write(("" if first else ",") + (pad if pretty else "") + (_json(k, pretty) + (": " if pretty else ":") if keyed else "") + body)
        first = False
    f.write(("" if first or not pretty else "\n" + "  " * depth) + ("}" if keyed else "]"))


def write_json(rows: DataFrame, path: str, key: str | None = None, pretty: bool = True, value: Column | None = None) -> None:
    """K1, K2: one JSON document: an object by key, or an array in the rows' order."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        _nested(f, rows_json(rows, key, value), key is not None, pretty, 0)
        f.write("\n")


def write_document(parts: dict, path: str) -> None:
    """K3, K5: one JSON object whose parts are plain values or streams: ("map" or "list", items of rows_json())."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for k, (name, part) in enumerate(parts.items()):
            f.write(("," if k else "") + "\n  " + _json(name, True) + ": ")
            if isinstance(part, tuple):
                _nested(f, part[1], part[0] == "map", True, 1)
            else:
                f.write(_json(part, True).replace("\n", "\n  "))
        f.write("\n}\n")


def escaped(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def _element(name: str, c: Column, depth: int) -> Column:
    return F.concat(F.lit("\n" + "  " * depth + f"<{name}>"), escaped(c), F.lit(f"</{name}>"))


def rss_items(feed: DataFrame) -> DataFrame:
    """K6: one <item> for each feed row (title, url, pub_date, description), in its order."""
    said = F.when(F.coalesce("description", F.lit("")) != "", _element("description", F.col("description"), 3)).otherwise("")
    parts = [_element("title", F.col("title"), 3), _element("link", F.col("url"), 3), _element("guid", F.col("url"), 3), _element("pubDate", F.col("pub_date"), 3), said]
    return feed.select(F.concat(F.lit("    <item>"), *parts, F.lit("\n    </item>")).alias("value"))


def sitemap_items(urls: DataFrame) -> DataFrame:
    """K7."""
    return urls.select(F.concat(F.lit("  <url>"), _element("loc", F.col("loc"), 2), F.lit("\n  </url>")).alias("value"))


def plain_escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&#34;").replace("'", "&#39;")


def rss_frame(title: str, link: str) -> tuple[str, str]:
    """What stands before and after the items of a feed."""
    head = f'{XML}<rss version="2.0">\n  <channel>\n    <title>{plain_escaped(title)}</title>\n    <link>{plain_escaped(link)}</link>\n'
    return head, "  </channel>\n</rss>\n"


def write_text(lines: DataFrame, path: str, head: str = "", tail: str = "") -> None:
    """One text file from rows (value), in their order, between head and tail."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(head)
        for row in lines.toLocalIterator():
            f.write(row["value"] + "\n")
        f.write(tail)


def write_files(files: DataFrame, folder: str) -> int:
    """Files (path, content) below a folder that all executors see, each written by the task that holds it; how many
    there are. A task that runs again writes the same bytes, and no file is seen half written."""
    from pyarrow import fs

    root = folder if "://" in folder else os.path.abspath(folder)

    def run(batches):
        system, where = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                target = f"{where}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                fresh = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(fresh) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                system.move(fresh, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    written = files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long")
    return written.agg(F.sum("n")).first()[0] or 0


def copy_files(files: DataFrame, source: str, target: str) -> int:
    """The files (path) of a folder copied below another by the tasks that hold their names; how many were not
    there already."""

    def run(batches):
        for batch in batches:
            n = sum(copy_file(f"{source}/{p}", f"{target}/{p}") for p in batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return files.select("path").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def copy_file(source: str, target: str) -> bool:
    """A copy with the time of the source; False if the target has its size and time already."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if os.path.exists(target):
        a, b = os.stat(source), os.stat(target)
        if (a.st_size, a.st_mtime_ns) == (b.st_size, b.st_mtime_ns):
            return False
    shutil.copy2(source, target)
    return True


def replace_file(path: str, text: str) -> None:
    """The new text appears whole or not at all."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    with open(fresh, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(fresh, path)


def escaped(c: Column) -> Column:
    """plain_escaped() of a column."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def listing_pages(rows: DataFrame) -> DataFrame:
    """Path, content of a page for each path with a list of links; rows: path, title, target, name, link."""
    one = F.struct("target", "name", F.concat(F.lit('<li><a href="'), escaped(F.col("link")), F.lit('">'), escaped(F.col("name")), F.lit("</a></li>\n")).alias("line"))
    pages = rows.groupBy("path").agg(F.min("title").alias("title"), F.array_sort(F.collect_list(one)).alias("links"))
    title = escaped(F.col("title"))
    head = F.concat(F.lit("<!DOCTYPE html>\n<title>"), title, F.lit("</title>\n<h1>"), title, F.lit("</h1>\n<ul>\n"))
    return pages.select("path", F.concat(head, F.array_join(F.transform("links", lambda x: x["line"]), ""), F.lit("</ul>\n")).alias("content"))


XML = '<?xml version="1.0" encoding="UTF-8"?>\n'
SITEMAP = (XML + '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n', "</urlset>\n")
NO_SITEMAP = (XML + '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>\n")


class Publication:
    """Files are staged beside the target and take its place in one rename; on an error the old state
    stays."""

    def __init__(self, target: str):
        self.target = target.rstrip("/")
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        os.makedirs(self.staging)
        return self.staging

    def __exit__(self, kind, *_):
        if kind:
            shutil.rmtree(self.staging, ignore_errors=True)
            return
        old = f"{self.target}.old-{uuid.uuid4().hex}"
        had = os.path.exists(self.target)
        if had:
            os.rename(self.target, old)
        try:
            os.rename(self.staging, self.target)
        except OSError:
            if had:
                os.rename(old, self.target)
            raise
        shutil.rmtree(old, ignore_errors=True)
