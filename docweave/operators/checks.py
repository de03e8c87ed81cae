"""Validation rules: each gives findings (file, line, level, category, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths, text
from docweave.storage import stored

ERROR, WARN = "ERROR", "WARN"
METADATA, LINKS, ORPHAN, ASSETS = "missing_metadata", "broken_links", "orphan", "asset_health"
LARGE_ASSET = 5 << 20

# Raster formats, and image formats that browsers do not all show.
RASTER = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff", ".tif", ".ico", ".avif")
SUSPICIOUS = (
    ".psd", ".ai", ".eps", ".tiff", ".tif", ".raw", ".cr2", ".nef", ".heic", ".heif",
    ".xcf", ".indd", ".bmp", ".jp2", ".j2k", ".jpx", ".pnm", ".pbm", ".pgm", ".ppm",
)

# Files that a published site must have, one that it has with dated pages, and those that the
# explorer's page needs.
REQUIRED = ("sitemap.xml", "robots.txt", "search.json", "graph.json", "backlinks.json", "meta.json")
FEED = "feed.xml"
EXPLORER = "graph/index.html"
COMPANIONS = ("graph/data.json", "assets/graph/explorer.css", "assets/graph/explorer.js")


def finding(rows: DataFrame, file: Column, line: Column, level: str, category: str, *message: Column) -> DataFrame:
    return rows.select(file.alias("file"), line.cast("int").alias("line"), F.lit(level).alias("level"), F.lit(category).alias("category"), F.concat(*message).alias("message"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def line_of(content: Column, pattern: str) -> Column:
    """1 + the line ends before the first match of a field, 1 without a match."""
    head = F.regexp_extract(content, rf"(?ims)\A(.*?)^\s*{pattern}\s*:", 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def line_of_text(content: Column, needle: Column) -> Column:
    """The line of the first occurrence of a text."""
    at = F.position(needle, content)
    return F.when(at > 0, F.size(F.split(F.substring(content, F.lit(1), at), "\n"))).otherwise(0)


def _finding(line: Column, level: str, category: str, *message: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), F.lit(level).alias("level"), F.lit(category).alias("category"), F.concat(*message).alias("message"))


def _malformed(column: str, what: str, line: Column) -> Column:
    """Findings for the values of a list that are not in normal form."""
    bad = F.filter(F.coalesce(f"raw_{column}", F.array().cast("array<string>")), lambda v: ~v.rlike("^[a-z0-9-]+$"))
    normal = lambda v: F.regexp_replace(F.lower(v), "[^a-z0-9-]", "")
    return F.transform(bad, lambda v: _finding(line, WARN, METADATA, F.lit(f"malformed {what} "), quoted(v), F.lit(" (normalized to "), quoted(normal(v)), F.lit(")")))


def frontmatter(docs: DataFrame) -> DataFrame:
    """V1-V7, as one list of findings for each document. docs: the document table with content, raw_date,
    raw_tags, raw_categories, parse_error."""
    content = F.col("content")
    line = lambda f: line_of(content, f)
    shown = paths.rendered(F.col("render"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    slug, date = F.coalesce(F.col("slug"), F.lit("")), F.coalesce("raw_date", F.lit(""))
    at_category = F.when(F.lower(content).contains("\ncategory:") | F.startswith(F.lower(F.trim(content)), F.lit("category:")), line("category")).otherwise(line("categories"))
    rules = [
        F.when(F.col("parse_error").isNotNull(), _finding(F.lit(1), ERROR, METADATA, F.lit("invalid frontmatter: "), F.col("parse_error"))),
        F.when((date != "") & text.valid_date(date).isNull(), _finding(line("date"), ERROR, METADATA, F.lit("invalid date format "), quoted(date), F.lit(": must be YYYY-MM-DD"))),
        F.when(~shown & (slug != ""), _finding(line("slug"), ERROR, METADATA, F.lit("invalid render/slug combination: slug "), quoted(slug), F.lit(" specified when render is false"))),
        F.when((slug != "") & ~paths.usable_slug(slug), _finding(line("slug"), ERROR, METADATA, F.lit("invalid slug "), quoted(slug), F.lit(": slug must be a simple local name without slashes or dots"))),
        F.when(shown & blank("title"), _finding(F.lit(0), WARN, METADATA, F.lit('missing title: <meta property="og:title"> will fallback to filename'))),
        F.when(shown & blank("description"), _finding(F.lit(0), WARN, METADATA, F.lit("missing description: page will use default_description if configured"))),
    ]
    every = F.concat(F.filter(F.array(*rules), lambda f: f.isNotNull()), _malformed("tags", "tag", line("tags")), _malformed("categories", "category", at_category))
    return docs.select(F.col("rel_path").alias("file"), F.explode(every).alias("f")).select("file", "f.*")


def broken_links(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One finding for each link to a missing file."""
    from docweave.operators.graph import links

    found = links(docs) if found is None else found
    gone = found.join(docs.select(F.col("rel_path").alias("target")), "target", "left_anti").join(docs.select("rel_path", "content"), "rel_path")
    return finding(gone, F.col("rel_path"), line_of_text(F.col("content"), F.col("dest")), ERROR, LINKS, F.lit("broken internal link "), quoted(F.col("dest")), F.lit(" -> "), quoted(F.col("target")))


def collisions(docs: DataFrame) -> DataFrame:
    """V9."""
    from docweave.operators.graph import first_owner

    claims = docs.filter(paths.rendered(F.col("render"))).select(paths.output_path(F.col("rel_path"), F.col("slug"), F.col("render")).alias("path"), F.col("rel_path").alias("owner"))
    return finding(first_owner(claims), F.col("owner"), F.lit(0), ERROR, LINKS, F.lit("output path collision: "), quoted(F.col("first")), F.lit(" and "), quoted(F.col("owner")), F.lit(" both map to "), quoted(F.col("path")))


def orphans(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """V10."""
    from docweave.operators.graph import orphans_checker

    return finding(orphans_checker(docs, found), F.col("rel_path"), F.lit(0), WARN, ORPHAN, F.lit("orphaned page: no inbound links"))


def extension(path: Column) -> Column:
    """The lower-case extension of the last name, with its dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def asset_files(assets: DataFrame, limit: int = LARGE_ASSET, root: str = "assets") -> DataFrame:
    """V11-V15. assets: path, size, symlink, ignored (optional). A link or a path out of the root has that one
    finding and is no asset."""
    path, ext = F.col("path"), extension(F.col("path"))
    linked = F.coalesce("symlink", F.lit(False))
    skipped = F.coalesce("ignored", F.lit(False)) if "ignored" in assets.columns else F.lit(False)
    away = ~linked & (~paths.is_local(path) | path.startswith(".."))
    limit = limit if limit > 0 else LARGE_ASSET
    mine = valid_assets(assets)
    firsts = mine.groupBy(F.lower("path").alias("folded")).agg(F.min("path").alias("first"), F.max("path").alias("last")).filter("first <> last")
    twice = mine.join(firsts, F.lower("path") == F.col("folded")).filter("path <> first")
    rules = [
        F.when(linked, _finding(F.lit(0), WARN, ASSETS, F.lit("symlink in asset directory skipped: "), path)),
        F.when(away, _finding(F.lit(0), WARN, ASSETS, F.lit("asset path "), quoted(path), F.lit(f' escapes configured asset root "{root}"'))),
        F.when(~linked & ~away & ~skipped & ext.isin(*SUSPICIOUS), _finding(F.lit(0), WARN, ASSETS, F.lit("unsupported or suspicious image extension "), quoted(ext), F.lit(": prefer web-optimized formats (.png, .jpg, .webp, .svg, .avif)"))),
        F.when(~linked & ~away & ~skipped & ext.isin(*RASTER) & (F.col("size") > limit), _finding(F.lit(0), WARN, ASSETS, F.lit("unusually large raster asset ("), text.byte_size(F.col("size")), F.lit(" > "), text.byte_size(F.lit(limit)), F.lit(" threshold)"))),
    ]
    each = assets.select(path.alias("file"), F.explode(F.filter(F.array(*rules), lambda f: f.isNotNull())).alias("f")).select("file", "f.*")
    return each.unionByName(finding(twice, path, F.lit(0), WARN, ASSETS, F.lit("asset case-collision / duplicate destination risk: "), quoted(F.col("first")), F.lit(" and "), quoted(path), F.lit(" map to the same destination "), quoted(F.col("folded"))))


def valid_assets(assets: DataFrame) -> DataFrame:
    """Those that a document may refer to."""
    skipped = F.coalesce("ignored", F.lit(False)) if "ignored" in assets.columns else F.lit(False)
    return assets.filter(~F.coalesce("symlink", F.lit(False)) & ~skipped & paths.is_local(F.col("path")) & ~F.startswith("path", F.lit("..")))


def asset_links(docs: DataFrame) -> DataFrame:
    """File, dest, target of the references of documents to assets: images, and links into the asset folder
    or to a file with the extension of an image. Targets are paths below the asset root."""
    from docweave.sources.commonmark import parsed_references

    refs = docs.select(F.col("rel_path").alias("file"), F.explode(parsed_references(F.col("body"))).alias("r")).select("file", "r.*")
    dest = F.col("dest")
    into = dest.startswith("/assets/") | dest.startswith("assets/") | extension(dest).isin(*RASTER, *SUSPICIOUS, ".svg")
    path = F.try_url_decode(F.replace(paths.link_path(dest), F.lit("+"), F.lit("%2B")))
    refs = refs.filter((F.col("image") | into) & ~dest.rlike(r"^(//|[a-zA-Z][a-zA-Z0-9+.-]*:)")).withColumn("p", path).filter("p <> ''")
    inside, p = paths.folder(F.col("file")), F.col("p")
    near = F.regexp_replace(F.concat_ws("/", F.when(inside != "", inside), p), "^assets/", "")
    target = F.when(p.rlike("^/?assets/"), F.regexp_replace(p, "^/?assets/", "")).when(p.startswith("/"), F.regexp_replace(p, "^/", "")).otherwise(near)
    return refs.select("file", "dest", paths.clean_path(target).alias("target"))


def _bad_references(references: DataFrame, assets: DataFrame) -> DataFrame:
    """The references that are findings, with their message."""
    dest, target = F.col("dest"), F.col("target")
    away = ~paths.is_local(target) | target.startswith("..") | dest.contains("%2E%2E")
    mine = valid_assets(assets) if "symlink" in assets.columns else assets
    folded = mine.groupBy(F.lower("path").alias("folded")).agg(F.min("path").alias("actual"))
    rest = references.filter(~away).join(mine.select(F.col("path").alias("target")), "target", "left_anti").join(folded, F.lower("target") == F.col("folded"), "left")
    message = F.when(F.col("actual").isNotNull(), F.concat(F.lit("referenced asset "), quoted(dest), F.lit(" has case mismatch with existing asset "), quoted(F.col("actual")))).otherwise(F.concat(F.lit("missing referenced asset "), quoted(dest)))
    out = references.filter(away).withColumn("message", F.concat(F.lit("referenced asset path "), quoted(dest), F.lit(" escapes asset root")))
    return out.unionByName(rest.withColumn("message", message).drop("folded", "actual"))


def asset_references(references: DataFrame, assets: DataFrame) -> DataFrame:
    """V16, V17, J13. references: file, line, dest, target (path below the asset root, cleaned)."""
    return finding(_bad_references(references, assets), F.col("file"), F.col("line"), WARN, ASSETS, F.col("message"))


def asset_health(docs: DataFrame, assets: DataFrame, limit: int = LARGE_ASSET, root: str = "assets") -> DataFrame:
    """V11-V18. Lines are looked up only for references that are findings."""
    bad = _bad_references(asset_links(docs), assets).join(docs.select(F.col("rel_path").alias("file"), "content"), "file")
    return asset_files(assets, limit, root).unionByName(finding(bad, F.col("file"), line_of_text(F.col("content"), F.col("dest")), WARN, ASSETS, F.col("message")))


def validate(docs: DataFrame, assets: DataFrame | None = None, limit: int = LARGE_ASSET, root: str = "assets") -> DataFrame:
    """V1-V10 over documents, with assets V11-V18 too, in the order of reports (U5, O3). Links are read
    once and stored."""
    from docweave.operators.graph import links

    found = stored(links(docs).select("rel_path", "dest", "target"), "links")
    every = [frontmatter(docs), broken_links(docs, found), collisions(docs), orphans(docs, found)]
    if assets is not None:
        every.append(asset_health(docs, assets, limit, root))
    return reduce(DataFrame.unionByName, every).orderBy("file", "line", "level", "message")


def summary(findings: DataFrame) -> DataFrame:
    """Counts by level and category."""
    return findings.groupBy("level", "category").agg(F.count("*").alias("n"))


def totals(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, orphans, and findings whose message tells of missing descriptions or dates."""
    says = lambda x: F.lower("message").contains(x)
    return findings.agg(F.count_if(F.col("level") == ERROR).alias("errors"), F.count_if(F.col("level") == WARN).alias("warnings"), F.count_if(F.col("category") == ORPHAN).alias("orphans"), F.count_if(says("missing description")).alias("descriptions"), F.count_if(says("missing date")).alias("dates"))


def footer(findings: DataFrame) -> DataFrame:
    """The last line of a report."""
    many = lambda c, one, more: F.concat(F.col(c).cast("string"), F.lit(" "), text.plural(F.col(c), one, more))
    sign = F.when(F.col("errors") > 0, "✗").otherwise("✓")
    tail = F.concat_ws(", ", many("orphans", "orphaned page", "orphaned pages"), many("descriptions", "missing description", "missing descriptions"), many("dates", "missing date", "missing dates"))
    return totals(findings).select(F.concat(sign, F.lit(" "), many("errors", "error", "errors"), F.lit(", "), many("warnings", "warning", "warnings"), F.lit(" | "), tail).alias("value"))


def report_lines(findings: DataFrame) -> DataFrame:
    """The text of a report, one line for each finding."""
    place = F.when(F.col("line") > 0, F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"))).otherwise(F.col("file"))
    return findings.orderBy("file", "line", "level", "message").select(F.format_string("[%s] %s: %s", F.col("level"), place, F.col("message")).alias("value"))


# --- publishing -----------------------------------------------------------------------------------


def missing_references(pages: DataFrame, files: DataFrame) -> DataFrame:
    """References of published pages (path, html) without a file among candidates: the path itself, its
    index.html if it has no extension, or for x.html the folder's. Paths out of the site are missing."""
    from docweave.operators.graph import html_references

    refs = pages.select("path", F.explode(html_references(F.col("html"))).alias("reference")).withColumn("reference", F.trim("reference")).filter((F.col("reference") != "") & ~paths.is_external(F.col("reference"))).distinct()
    p = F.try_url_decode(F.replace(paths.link_path(F.col("reference")), F.lit("+"), F.lit("%2B")))
    near = F.concat_ws("/", F.when(paths.folder(F.col("path")) != "", paths.folder(F.col("path"))), F.when(p != "", p))
    target = paths.clean_path(F.when(p.startswith("/"), F.regexp_replace(p, "^/", "")).otherwise(near))
    refs = refs.withColumn("target", F.when(target == ".", "index.html").otherwise(target))
    ext = extension(F.col("target"))
    more = F.when(ext == "", F.concat("target", F.lit("/index.html"))).when(ext == ".html", F.regexp_replace("target", r"\.html$", "/index.html"))
    tries = F.filter(F.array(F.col("target"), more), lambda t: t.isNotNull() & ~t.rlike(r"^\.\.(/|$)"))
    found = refs.select("path", "reference", F.explode(tries).alias("file")).join(files.select(F.col("path").alias("file")), "file", "left_semi")
    return refs.join(found.select("path", "reference").distinct(), ["path", "reference"], "left_anti").select("path", "reference")


def missing_artifacts(files: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """J16."""
    wanted = files.sparkSession.createDataFrame([(r,) for r in required], "path string")
    return wanted.join(files.select("path"), "path", "left_anti")


def dated_pages(meta: DataFrame) -> DataFrame:
    """One row: whether a rendered page has a date. meta: render, date."""
    return meta.agg(F.coalesce(F.bool_or(F.col("render") & (F.trim(F.coalesce("date", F.lit(""))) != "")), F.lit(False)).alias("dated"))


def publish_problems(files: DataFrame, pages: DataFrame, meta: DataFrame) -> DataFrame:
    """Problem texts of a published site. files: path; pages: path, html; meta: render, date."""
    refs = missing_references(pages, files).select(F.concat(F.col("path"), F.lit(" references missing local file "), quoted(F.col("reference"))).alias("problem"))
    core = missing_artifacts(files).select(F.concat(F.lit("publish artifact is missing required file "), quoted(F.col("path"))).alias("problem"))
    feed = missing_artifacts(files, (FEED,)).join(dated_pages(meta)).filter("dated").select(F.lit(f'publish artifact is missing required file "{FEED}": meta.json lists a dated rendered page').alias("problem"))
    explorer = missing_artifacts(files, COMPANIONS).join(files.filter(F.col("path") == EXPLORER).select(F.lit(1))).select(F.concat(F.lit("graph explorer is missing required artifact "), quoted(F.col("path"))).alias("problem"))
    return refs.unionByName(core).unionByName(feed).unionByName(explorer)


def forbidden_files(files: DataFrame) -> DataFrame:
    """Staging folders, symlinks and caches that must not be published."""
    reason = F.when(F.col("path").rlike(r"(^|/)\.[^/]*staging[^/]*(/|$)"), "staging directory").when(F.coalesce(F.col("symlink"), F.lit(False)), "symlink").when(F.col("path").rlike(r"(^|/)\.[^/]*cache[^/]*\.json$"), "cache file")
    return files.select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def published_manifest(files: DataFrame) -> DataFrame:
    """The sorted paths of a site; a file that must not be published fails the query."""
    bad = F.when(F.col("path").rlike(r"(^|/)\.[^/]*staging[^/]*(/|$)"), "staging directory").when(F.coalesce(F.col("symlink"), F.lit(False)), "symlink").when(F.col("path").rlike(r"(^|/)\.[^/]*cache[^/]*\.json$"), "cache file")
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("not to be published: "), bad, F.lit(" "), F.col("path")))).otherwise(F.col("path"))
    return files.select(checked.alias("path")).orderBy("path")
