"""Bundles of files as text: readers, writers, path patterns, ignore rules, listings."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text
from docweave.sources import markdown

#: Folders that bundles never take in (S3), and what assets always leave out.
SKIPPED = (".git", "test-results", "public", "vendor", "node_modules")


class MalformedBundle(ValueError):
    """A bundle whose structure is broken."""


def unescape(line: str) -> str:
    return line[1:] if re.match(rf"\\+(?:{'|'.join(text.MARKERS)})", line) else line


def parse_bundle(name: str, content: str) -> Iterator[tuple[str, str]]:
    """path, text of the files of a bundle, by lines. Leading blank lines of a file are lost, as the format
    joins lines only after the first that is not empty."""
    path, inside, held, seen = None, False, "", False
    lines = content.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for line in (x.removesuffix("\r") for x in lines):
        seen = True
        if line.startswith("<file "):
            if path is not None:
                raise MalformedBundle(f"{name}: <file> before {path!r} ended")
            got = re.search(r'path="([^"]*)"', line)
            if not got or not got[1]:
                raise MalformedBundle(f"{name}: <file> without a path")
            path, inside, held = got[1], False, ""
        elif line.startswith("<content>"):
            if path is None:
                raise MalformedBundle(f"{name}: <content> outside of <file>")
            inside, held = True, ""
        elif line.startswith("</content>") and path is not None:
            yield path, held
            path, inside = None, False
        elif line.startswith("</file>"):
            if path is not None:
                raise MalformedBundle(f"{name}: </file> inside the content of {path!r}")
        elif path is not None:
            held = f"{held}\n{unescape(line)}" if held else unescape(line)
    if path is not None:
        raise MalformedBundle(f"{name}: the block of {path!r} has no end")
    if not seen:
        raise MalformedBundle(f"{name}: empty")


FILES = pa.schema([("bundle", pa.string()), ("path", pa.string()), ("nth", pa.int32()), ("text", pa.string()), ("error", pa.string())])


#: Characters of bundles whose files a task holds at once.
BATCH_CHARS = 1 << 22


def parsed_batches(batches: Iterator[pa.RecordBatch], keep_errors: bool = False) -> Iterator[pa.RecordBatch]:
    """The files of batches of bundles, handed on as soon as BATCH_CHARS of bundles are parsed, however many rows a batch has."""
    for batch in batches:
        rows, held = [], 0
        for name, value in zip(batch.column("bundle"), batch.column("value")):
            name, value = name.as_py(), value.as_py() or ""
            try:
                rows += [{"bundle": name, "path": p, "nth": k, "text": t, "error": None} for k, (p, t) in enumerate(parse_bundle(name, value))]
            except MalformedBundle as e:
                if not keep_errors:
                    raise
                rows.append({"bundle": name, "path": None, "nth": None, "text": None, "error": str(e)})
            held += len(value)
            if held >= BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(rows, FILES)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, FILES)


def parsed_bundles(raw: DataFrame, keep_errors: bool = False) -> DataFrame:
    """bundle, path, nth, text of the files in bundles (bundle, value); a malformed bundle fails the query, or with
    keep_errors is one row with an error (S6)."""
    run = lambda batches: parsed_batches(batches, keep_errors)
    out = raw.select("bundle", "value").mapInArrow(run, "bundle string, path string, nth int, text string, error string")
    return out if keep_errors else out.drop("error")


def read_bundles(spark: SparkSession, folder: str, pattern: str = "*.md", keep_errors: bool = False) -> DataFrame:
    """parsed_bundles() of the bundles of a folder."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("bundle"), "value")
    return parsed_bundles(raw, keep_errors)


def file_block(path: Column, content: Column) -> Column:
    """The text of one file in a bundle; lines that would read as structure are escaped."""
    return F.concat(F.lit('<file path="'), path, F.lit('">\n<content>\n'), text.escape_lines(content), F.lit("\n</content>\n</file>\n\n"))


def bundle_text(files: DataFrame) -> DataFrame:
    """One text row (value) for each file (path, content), in path order (K8)."""
    return files.orderBy("path").select(F.regexp_replace(file_block(F.col("path"), F.col("content")), "\n$", "").alias("value"))


# What the two bundles beside that of the content take in.
SYSTEM = (("cmd/**/*.go", "internal/**/*.go", "pkg/**/*.go", "*.go", "go.mod", "go.sum", "README.md", "playwright_test.js", ".github/workflows/*.yml"), ("internal/config",))
CONFIG = (("internal/config/**/*.go", ".jules/**/*.md"), ())


def system_bundle(files: DataFrame) -> DataFrame:
    """K8: of the files (path, content) of a project."""
    return bundle_text(selected(files, list(SYSTEM[0]), list(SYSTEM[1])))


def content_bundle(files: DataFrame, content_dir: str = "content") -> DataFrame:
    """K8: Markdown files below the content folder."""
    return bundle_text(selected(files, [f"{content_dir}/**/*.md"], [f"{content_dir}/jules"]))


def config_bundle(files: DataFrame, listings: dict[str, DataFrame]) -> DataFrame:
    """K8: the files of the configuration, then a listing (inventory(), value) for each folder name, in order."""
    out = bundle_text(selected(files, list(CONFIG[0]), list(CONFIG[1]))).select(F.lit(0).alias("part"), F.lit("").alias("place"), "value")
    for k, (folder, listing) in enumerate(listings.items(), 1):
        one = listing.agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("listed"))
        out = out.unionByName(one.select(F.lit(k).alias("part"), F.lit(folder).alias("place"), file_block(F.lit(f"{folder}/"), F.col("listed")).alias("value")))
    return out.orderBy("part", F.regexp_extract("value", 'path="([^"]*)"', 1)).select("value")


def bundle_folder(folder: str, fallback: str, project_root: str) -> str:
    """K9: a folder as bundles name it: relative to the project's root, or the usual name if it lies elsewhere."""
    if not folder:
        return fallback
    rel = os.path.relpath(os.path.join(project_root, folder), project_root).replace(os.sep, "/")
    return fallback if rel == ".." or rel.startswith("../") else rel


def pattern_regex(pattern: str) -> str:
    """prefix**/suffix is a path prefix and a suffix match of the base name; other patterns match the
    whole path, * within a folder."""

    def glob(p: str) -> str:
        return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p)

    if "**/" in pattern:
        prefix, _, suffix = pattern.partition("**/")
        return f"^{re.escape(prefix)}(?:.*/)?{glob(suffix)}$"
    return f"^{glob(pattern)}$"


def selected(files: DataFrame, patterns: list[str], excludes: list[str]) -> DataFrame:
    """Files of any pattern, without excluded prefixes and skipped folders, each once, in order."""
    path = F.col("path")
    wanted = path.rlike("|".join(f"(?:{pattern_regex(p)})" for p in patterns)) if patterns else F.lit(False)
    for e in excludes:
        wanted = wanted & ~path.startswith(e)
    skipped = "|".join(map(re.escape, SKIPPED))
    return files.filter(wanted & ~path.rlike(f"(^|/)(?:{skipped})/")).dropDuplicates(["path"]).orderBy("path")


def inventory(files: DataFrame) -> DataFrame:
    """Folders as name/ and files with their size (path, length)."""
    folders = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda i: F.when(i < F.size(F.split("path", "/")), F.concat(F.array_join(F.slice(F.split("path", "/"), 1, i), "/"), F.lit("/")))))
    listed = files.select(folders.alias("value")).filter("value IS NOT NULL").distinct()
    return listed.unionByName(files.select(F.format_string("%s (size: %d bytes)", "path", "length").alias("value"))).orderBy("value")


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file."""

    negated: bool
    folders_only: bool
    regex: str


def ignore_rules(lines: list[str]) -> list[Rule]:
    """Blank lines and comments go; ! negates, a closing / means folders, an inner / anchors, ** spans
    folders and * does not."""
    rules = []
    for raw in lines:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        folders_only, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        parts = ["(?:.*/)?" if p == "**" else "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p) + "/" for p in line.split("/")]
        body = "".join(parts)
        body = body[:-1] if body.endswith("/") else body + ".*"
        rules.append(Rule(negated, folders_only, ("^" if anchored else "^(?:.*/)?") + body))
    return rules


def ignored(path: Column, rules: list[Rule]) -> Column:
    """The last rule that matches a path, or a folder above it, decides; .go files and testdata always go."""
    decision = F.lit(False)
    for r in rules:
        tail = "/.*$" if r.folders_only else "(?:/.*)?$"
        decision = F.when(path.rlike(r.regex + tail), F.lit(not r.negated)).otherwise(decision)
    return decision | path.endswith(".go") | path.rlike(r"(^|/)testdata(/|$)")


def asset_listing(spark: SparkSession, folder: str, rules: list[Rule] = (), prefix: str = "") -> DataFrame:
    """path, size, modified, symlink, ignored of all files and symbolic links below a folder, contents unread.
    Rules are relative to a folder above, `prefix` leads from there."""
    root = markdown.root_of(spark, folder)
    odd, links = markdown.listed(spark, root, "*")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tail = F.substring_index(F.col("path"), root.split(":", 1)[-1].lstrip("/"), -1)
    files = raw.select(F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(False).alias("symlink"))
    files = markdown.without(files, "path", links)
    others = [(p, os.path.getsize(f"{local}/{p}") if (local := markdown.local_path(root)) else None, None, False) for p in odd] + [(p, 0, None, True) for p in links]
    if others:
        files = files.unionByName(spark.createDataFrame(others, "path string, size long, modified timestamp, symlink boolean"))
    return files.withColumn("ignored", ignored(F.concat(F.lit(f"{prefix}/" if prefix else ""), "path"), list(rules)))


def site_assets(spark: SparkSession, folder: str, project_root: str, output_dir: str, explorer: bool = True) -> DataFrame | None:
    """The assets that a site takes in: regular files that no rule of the project's ignore file names. None
    without a folder; one that holds the output is an error."""
    if not os.path.isdir(folder):
        return None
    real, out = os.path.realpath(folder), os.path.realpath(output_dir)
    if out == real or out.startswith(real + os.sep):
        raise ValueError(f"the asset folder {folder} holds the output")
    rules, ignore = [], os.path.join(project_root, ".gitignore")
    if os.path.exists(ignore):
        with open(ignore, encoding="utf-8") as f:
            rules = ignore_rules(f.read().splitlines())
    prefix = os.path.relpath(real, os.path.realpath(project_root)).replace(os.sep, "/")
    listing = asset_listing(spark, real, rules, "" if prefix.startswith("..") else prefix).filter("NOT symlink AND NOT ignored")
    return listing if explorer else listing.filter(~F.col("path").rlike("^graph(/|$)"))


def missing_defaults(defaults: DataFrame, assets: DataFrame) -> DataFrame:
    """Defaults (path) that no asset of a site stands for."""
    return defaults.join(assets.select("path"), "path", "left_anti")


def json_map(frame: DataFrame, column: str, value_schema: str, *keep: str) -> DataFrame:
    """Key, value of a keyed JSON object, and the columns to keep."""
    return frame.select(*keep, F.explode(F.from_json(column, f"map<string,struct<{value_schema}>>")).alias("key", "value"))


def paginated(spark: SparkSession, fetch, pages: int = 20, size: int = 100) -> DataFrame:
    """All pages of a listing, `fetch(page, size)` giving lists of JSON texts, a task for each page. A
    full last page means that the listing is longer than allowed, which is an error."""

    def run(batches):
        for batch in batches:
            for page in batch.column("id").to_pylist():
                rows = fetch(page + 1, size)
                if page == pages - 1 and len(rows) >= size:
                    raise ValueError(f"more than {pages} pages")
                yield pa.RecordBatch.from_arrays([pa.array([page + 1] * len(rows), pa.int32()), pa.array(rows, pa.string())], ["page", "value"])

    return spark.range(0, pages, 1, pages).mapInArrow(run, "page int, value string")
