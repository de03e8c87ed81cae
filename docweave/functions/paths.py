"""Paths and URLs of pages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rendered(render: Column) -> Column:
    return F.coalesce(render, F.lit(True))


def page_id(rel_path: Column, render: Column) -> Column:
    """A rendered page's path without .md; a raw page keeps it."""
    return F.when(rendered(render), F.regexp_replace(rel_path, r"\.md$", "")).otherwise(rel_path)


def usable_slug(slug: Column) -> Column:
    """A single local name without dots."""
    return F.coalesce((slug != "") & ~slug.rlike(r"[./\\]"), F.lit(False))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def output_path(rel_path: Column, slug: Column, render: Column) -> Column:
    """Where a page is written."""
    name = F.when(usable_slug(slug), slug).otherwise(F.regexp_replace(F.regexp_extract(rel_path, "([^/]*)$", 1), r"\.md$", ""))
    index = rel_path.rlike(r"(^|/)index\.md$")
    tail = F.when(index, "index.html").otherwise(F.concat(name, F.lit("/index.html")))
    return F.when(~rendered(render), rel_path).otherwise(F.concat_ws("/", F.when(folder(rel_path) != "", folder(rel_path)), tail))


def public_path(output: Column, base_path: str = "") -> Column:
    """The root-relative URL of an output file (P5)."""
    return F.concat(F.lit(base_path), F.lit("/"), F.regexp_replace(output, r"(^|/)index\.html$", "$1"))


def canonical_url(output: Column, site: str) -> Column:
    """The absolute URL, or "" without a site."""
    return F.concat(F.lit(site.rstrip("/")), public_path(output)) if site else F.lit("")


def local_url(output: Column) -> Column:
    """Pages as folders."""
    return F.when(output.rlike(r"(^|/)index\.html$"), public_path(output)).when(output.endswith(".html"), F.concat(F.lit("/"), F.regexp_replace(output, r"\.html$", "/"))).otherwise(F.concat(F.lit("/"), output))


def valid_site(url: Column) -> Column:
    """http(s) with a host, without user, query, fragment or dot segments."""
    ok = url.rlike(r"^https?://[^/?#@\s]+(/[^?#\s]*)?$") & ~url.rlike(r"/\.{1,2}(/|$)")
    return F.coalesce(ok, F.lit(False))


def clean_path(path: Column) -> Column:
    """The path without empty, . and resolvable .. segments; "." if nothing is left."""

    def step(acc, seg):
        back = (seg == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        return F.when(seg.isin("", "."), acc).when(back, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(seg)))

    out = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(out == "", ".").otherwise(out)


def is_local(path: Column) -> Column:
    """Whether a cleaned path stays below its root."""
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"^\.\.(/|$)")


def is_external(reference: Column) -> Column:
    """P25: fragments, //host and anything with a scheme."""
    return reference.rlike(r"^(#|//|[a-zA-Z][a-zA-Z0-9+.-]*:)")


def link_path(destination: Column) -> Column:
    """A destination without query and fragment."""
    return F.regexp_replace(destination, r"[?#].*$", "")


def resolve_link(destination: Column, source: Column) -> Column:
    """The content path that a link of a page means, or null if it is none."""
    p = F.try_url_decode(F.replace(link_path(destination), F.lit("+"), F.lit("%2B")))
    absolute = p.startswith("/")
    joined = F.when(absolute, F.regexp_replace(p, "^/", "")).otherwise(F.concat_ws("/", F.when(folder(source) != "", folder(source)), p))
    target = clean_path(joined)
    ok = p.endswith(".md") & ~is_external(destination) & ~destination.contains("%2E%2E") & is_local(target)
    return F.when(ok, target)


def relative_link(source: Column, target: Column) -> Column:
    """From one output file's folder to another output path, index.html dropped, ./ for itself."""
    a, b = F.filter(F.split(folder(source), "/"), lambda s: s != ""), F.filter(F.split(target, "/"), lambda s: s != "")
    n = F.least(F.size(a), F.size(b) - 1)
    same = F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(0), lambda acc, i: F.when((acc == i) & (i < n) & F.get(a, i).eqNullSafe(F.get(b, i)), acc + 1).otherwise(acc))
    path = F.concat(F.repeat(F.lit("../"), (F.size(a) - same).cast("int")), F.array_join(F.slice(b, same + 1, F.greatest(F.size(b) - same, F.lit(0))), "/"))
    path = F.regexp_replace(path, r"(^|/)index\.html$", "$1")
    return F.when(path == "", "./").otherwise(path)


def corpus_page_id(source_path: Column, content_dir: str = "content") -> Column:
    """The path below the content folder without its extension."""
    base = F.regexp_replace(source_path, r"^\./", "")
    base = F.regexp_replace(base, "^" + content_dir.strip("/") + "/", "")
    base = F.regexp_replace(base, r"\.[^./]*$", "")
    return F.when(base == "", "index").otherwise(base)


def corpus_url(page: Column) -> Column:
    return F.when(page == "", "/").otherwise(F.concat(F.lit("/"), F.regexp_replace(page, "^/+", ""), F.lit("/")))


def bundle_kind(path: Column) -> Column:
    """What a bundle holds, by its file name."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(base.startswith("rag-content"), "rag-content").when(base.startswith("rag-system"), "rag-system").when(base.startswith("rag-config"), "rag-config").otherwise("content")


def chunk_id(page: Column, position: Column, heading: Column) -> Column:
    """F10."""
    from docweave.functions.text import slugify

    named = F.concat(F.lit("h"), (position + 1).cast("string"), F.lit("-"), slugify(heading))
    return F.concat(page, F.lit("#"), F.when(F.coalesce(heading, F.lit("")) == "", "h0").otherwise(named))


def owner_repo(remote: Column) -> Column:
    """owner/name of a git remote."""
    return F.regexp_extract(remote, r"[:/]([^/:]+/[^/]+?)(?:\.git)?/?$", 1)
