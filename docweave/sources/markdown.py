"""The document table from Markdown files with optional front matter, and adapters for other tables."""

from __future__ import annotations

import fnmatch
import os
import re

import pyarrow as pa
import pyarrow.fs
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from docweave.functions import text

FENCE = r"\A---[ \t]*\r?\n(?s:(.*?\n)?)---[ \t]*(?:\r?\n|\z)"
FIELDS = ("title", "author", "date", "video_script", "animation_cues", "soundtrack_theme", "layout", "compliance_modal", "slug", "description", "image")
LISTS = ("tags", "categories", "category")
PARSED = ", ".join([f"{f} string" for f in FIELDS] + [f"{c} array<string>" for c in LISTS] + ["render boolean", "error string", "warnings array<string>"])


def root_of(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"


def local_path(root: str) -> str:
    """The path of a file: URL, "" for another."""
    return re.sub("^file:/*", "/", root) if root.startswith("file:") else ""


def without(files: DataFrame, column: str, links: list[str]) -> DataFrame:
    """files but for links and what is reached through them."""
    for link in links:
        files = files.filter((F.col(column) != link) & ~F.startswith(column, F.lit(link + "/")))
    return files


def listed(spark: SparkSession, root: str, pattern: str) -> tuple[list[str], list[str]]:
    """Relative paths of files that Spark's listing leaves out (a name on the way begins with _ or ., or they are
    empty), and of symbolic links. Names only; a file system without links gives none."""
    odd, links = [], []
    if root.startswith("file:"):
        base = local_path(root)
        for at, folders, names in os.walk(base):
            rel = os.path.relpath(at, base)
            for name in [*folders, *names]:
                path = name if rel == "." else f"{rel}/{name}".replace(os.sep, "/")
                if os.path.islink(os.path.join(at, name)):
                    links.append(path)
                elif name in names and fnmatch.fnmatchcase(name, pattern) and (re.search(r"(^|/)[._]", path) or not os.path.getsize(os.path.join(at, name))):
                    odd.append(path)
        return odd, links
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while files.hasNext():
        status = files.next()
        rel = status.getPath().toString().removeprefix(root)
        if fnmatch.fnmatchcase(rel.rpartition("/")[2], pattern) and (re.search(r"(^|/)[._]", rel) or not status.getLen()):
            odd.append(rel)
    return odd, links


def read_files(spark: SparkSession, folder: str, pattern: str = "*.md", binary: bool = False) -> DataFrame:
    """rel_path, content of all regular files below a folder, those whose names begin with _ or . too; symbolic
    links are not followed, but the folder itself may be one (S1). Spark's reader takes what it lists; the other
    files are opened in executors by path."""
    if os.path.islink(folder):
        folder = os.path.realpath(folder)
    root = root_of(spark, folder)
    odd, links = listed(spark, root, pattern)
    kind = "binary" if binary else "string"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    tail = F.substring_index(F.col("_metadata.file_path"), root.split(":", 1)[-1].lstrip("/"), -1)
    files = raw.select(F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))).alias("rel_path"), F.col("content").cast(kind).alias("content"))
    files = without(files, "rel_path", links)
    if not odd:
        return files

    def run(batches):
        for batch in batches:
            for rel in batch.column("rel_path").to_pylist():
                system, path = pa.fs.FileSystem.from_uri(root + rel) if not root.startswith("file:") else (pa.fs.LocalFileSystem(), local_path(root) + rel)
                with system.open_input_stream(path) as f:
                    data = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([data if binary else data.decode("utf-8", "replace")], pa.binary() if binary else pa.string())], ["rel_path", "content"])

    named = spark.createDataFrame([(x,) for x in odd], "rel_path string")
    return files.unionByName(named.mapInArrow(run, f"rel_path string, content {kind}"))


#: Scalars but for dates, which stay as they are written.
_SCALARS = {k: [x for x in v if not x[0].endswith(":timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


class _Loader(yaml.SafeLoader):
    yaml_implicit_resolvers = _SCALARS


class _FastLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    yaml_implicit_resolvers = _SCALARS


#: Blocks that libyaml reads as the plain loader does: without tabs, block scalars, !, ? and rare white space, where they differ.
_COMMON = re.compile(r'[\w "-=@-{}~\n]*\Z')


def load_yaml(block: str):
    """The value of a block as the plain loader gives it; libyaml, about seven times as fast, reads the common ones. What
    it refuses is left to the plain loader, whose messages are shown."""
    if _COMMON.match(block):
        try:
            return yaml.load(block, Loader=_FastLoader)
        except (yaml.YAMLError, ValueError):
            pass
    return yaml.load(block, Loader=_Loader)


def parse_one(block: str | None) -> dict:
    """Fields of one front-matter block. Keys are case-insensitive, the exact lower-case one wins (W8);
    scalars are lists of one; values of a wrong type are left out with a warning (F13, F14)."""
    out: dict = {f: None for f in FIELDS} | {c: None for c in LISTS} | {"render": None, "error": None, "warnings": []}
    if block is None:
        return out
    try:
        raw = load_yaml(block)
    except (yaml.YAMLError, ValueError) as e:
        return out | {"error": " ".join(str(e).split())}
    if raw is None:
        return out
    if not isinstance(raw, dict):
        return out | {"error": "front matter is not a mapping"}
    keyed: dict[str, object] = {}
    for key in sorted((k for k in raw if isinstance(k, str)), key=lambda k: (k != k.lower(), k)):
        if key.lower() in keyed:
            out["warnings"].append(f"key {key} repeats {key.lower()}")
        else:
            keyed[key.lower()] = raw[key]
    plain = (str, int, float, bool)
    for f in FIELDS:
        v = keyed.get(f)
        if isinstance(v, plain):
            out[f] = str(v).lower() if isinstance(v, bool) else str(v)
        elif v is not None:
            out["warnings"].append(f"{f} is not a text")
    for c in LISTS:
        v = keyed.get(c)
        if isinstance(v, str):
            out[c] = [v]
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out[c] = [str(v)]
        elif isinstance(v, list):
            out[c] = [str(x) for x in v if isinstance(x, (str, int, float)) and not isinstance(x, bool)]
            if len(out[c]) < len(v):
                out["warnings"].append(f"{c} holds values that are not texts")
        elif v is not None:
            out["warnings"].append(f"{c} is not a list")
    if isinstance(keyed.get("render"), bool):
        out["render"] = keyed["render"]
    elif keyed.get("render") is not None:
        out["warnings"].append("render is not a boolean")
    return out


def parse_frontmatter(block: Column) -> Column:
    """The fields of front-matter blocks as a struct; blocks are parsed in Arrow batches."""
    kind = to_arrow_type(StructType.fromDDL(PARSED))

    @F.arrow_udf(PARSED)
    def read(blocks: pa.Array) -> pa.Array:
        return pa.array([parse_one(b) for b in blocks.to_pylist()], kind)

    return read(block)


def documents(files: DataFrame) -> DataFrame:
    """The document table of SURVEY 1.3 from rel_path, content. A block that cannot be parsed makes the
    whole file the body; dates that are not strict are blanked; categories come before category. Blocks are parsed where
    the rows are: rows of few partitions are dealt() first."""
    has = F.col("content").rlike(FENCE)
    parsed = files.withColumn("fm", parse_frontmatter(F.when(has, F.regexp_extract("content", FENCE, 1))))
    body = F.when(has & F.col("fm.error").isNull(), F.regexp_replace("content", FENCE, "")).otherwise(F.col("content"))
    lists = F.array().cast("array<string>")
    joined = F.concat(F.coalesce("fm.categories", lists), F.coalesce("fm.category", lists))
    kept = [F.col(f"fm.{f}").alias(f) for f in FIELDS if f != "date"]
    return parsed.select("rel_path", "content", body.alias("body"), *kept, text.valid_date(F.col("fm.date")).alias("date"), F.col("fm.date").alias("raw_date"), text.taxonomy_list(F.col("fm.tags")).alias("tags"), text.taxonomy_list(joined).alias("categories"), F.coalesce("fm.tags", lists).alias("raw_tags"), joined.alias("raw_categories"), F.col("fm.render").alias("render"), F.col("fm.error").alias("parse_error"), F.coalesce("fm.warnings", lists).alias("warnings"))


def corpus_front_matter(content: Column) -> tuple[Column, Column, Column]:
    """Title, body and render of a page in a bundle, by its own plain line format (F15): the last title
    counts, a false render sticks, and the first level-1 heading stands in for a title."""
    block = r"(?s)\A---\n(.*?)\n---\n?"
    has = content.rlike(block)
    body = F.when(has, F.regexp_replace(F.regexp_replace(content, block, ""), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")).otherwise(content)
    lines = F.filter(F.split(F.regexp_extract(content, block, 1), "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.regexp_replace(F.regexp_replace(x, "^[^:]*:", ""), r"""^[\s"']+|[\s"']+$""", "").alias("v")))
    titles = F.filter(pairs, lambda p: p["k"] == "title")
    title = F.coalesce(F.try_element_at(titles, F.lit(-1))["v"], F.lit(""))
    first = F.trim(F.regexp_extract(body, r"(?dm)^#\s+(.+?)\s*$", 1))
    hidden = F.exists(pairs, lambda p: (p["k"] == "render") & F.lower(p["v"]).isin("false", "no", "0", "off"))
    return F.when(title != "", title).otherwise(first), body, ~hidden


def from_table(docs: DataFrame, rel_path: Column, body: Column, **columns: Column) -> DataFrame:
    """A document table from any table; columns that are not given are empty."""
    strings = {f: F.lit(None).cast("string") for f in FIELDS}
    lists = {c: F.array().cast("array<string>") for c in ("tags", "categories", "raw_tags", "raw_categories", "warnings")}
    given = strings | lists | {"render": F.lit(None).cast("boolean"), "raw_date": F.lit(None).cast("string"), "parse_error": F.lit(None).cast("string")} | columns
    return docs.select(rel_path.alias("rel_path"), body.alias("content"), body.alias("body"), *[c.alias(n) for n, c in given.items()])
