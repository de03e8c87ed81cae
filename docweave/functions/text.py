"""Text functions as Column expressions: tokens, excerpts, snippets, headings, slugs, archive escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of elements that count as markup when text is stripped of tags.
ELEMENTS = (
    "a", "abbr", "address", "area", "article", "aside", "audio", "b", "base", "bdi", "bdo", "blockquote", "body",
    "br", "button", "canvas", "caption", "cite", "code", "col", "colgroup", "data", "datalist", "dd", "del",
    "details", "dfn", "dialog", "div", "dl", "dt", "em", "embed", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "i", "iframe", "img",
    "input", "ins", "kbd", "label", "legend", "li", "link", "main", "map", "mark", "menu", "meta", "meter", "nav",
    "noscript", "object", "ol", "optgroup", "option", "output", "p", "param", "picture", "pre", "progress", "q", "rp",
    "rt", "ruby", "s", "samp", "script", "section", "select", "slot", "small", "source", "span", "strong", "style",
    "sub", "summary", "sup", "table", "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "time", "title",
    "tr", "track", "u", "ul", "var", "video", "wbr", "svg", "path", "circle", "ellipse", "line", "polygon",
    "polyline", "rect", "text", "tspan", "g", "defs", "use", "symbol", "marker", "mask", "clippath", "lineargradient",
    "radialgradient", "stop", "pattern", "desc", "foreignobject", "animate", "animatetransform", "textpath",
)

# Lines that are structure in an archive of files.
MARKERS = ("<file ", "<content>", "</content>", "</file>")

# Phrases of an answer that declines.
REFUSALS = ("not enough information", "i don't know", "cannot answer", "i'm not sure", "no information")

SPACE = r"\p{IsWhite_Space}"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order (F1)."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "), " "), "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def word_count(text: Column) -> Column:
    """Runs of anything but white space (F2)."""
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def collapse(text: Column) -> Column:
    """White space runs to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def truncate(text: Column, n: int) -> Column:
    """At most n code points, the last an ellipsis if something is cut."""
    if n <= 0:
        return F.lit("")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def excerpt(text: Column, n: int) -> Column:
    """truncate() of the collapsed text."""
    return truncate(collapse(text), n)


# Markup that is never prose, attributes that tell a tag, inline links.
MARKUP = r"(?s)<!--.*?-->|<![^<>]*>|<\?[^<>]*>"
ATTRIBUTE = r'\s[a-zA-Z_:][-a-zA-Z0-9_:.]*\s*=\s*"[^"<>\n]*"'
INLINE_LINK = r"!?\[([^\]]*)\]\([^)]+\)"


def strip_tags(text: Column) -> Column:
    """Drop comments, declarations, known elements and anything tag-like with a quoted attribute; other angle
    brackets are prose. A tag never spans lines (F7)."""
    text = F.regexp_replace(text, MARKUP, "")
    known = "|".join(ELEMENTS)
    return F.regexp_replace(text, rf"(?i)</?(?:(?:{known})(?![a-z0-9-])[^<>\n]*|[a-z][a-z0-9-]*[^<>\n]*?{ATTRIBUTE}[^<>\n]*)>", "")


def unlink(text: Column) -> Column:
    """Inline links and images to their text."""
    return F.regexp_replace(text, INLINE_LINK, "$1")


def unmark(text: Column) -> Column:
    """Without emphasis, heading and bracket signs, collapsed."""
    return collapse(F.regexp_replace(text, r"[#*\[\]`_~]", ""))


def snippet(text: Column, n: int = 160) -> Column:
    """The first n code points of the prose of a Markdown text, with three dots if cut."""
    text = F.regexp_replace(text, "(?s)```[^\\n]*\\n(.*?)```", "")
    text = F.regexp_replace(strip_tags(unlink(text)), r"(?dm)^[ \t]*>+[ \t]?", "")
    clean = unmark(text)
    return F.when(F.length(clean) > n, F.concat(F.substring(clean, 1, n), F.lit("..."))).otherwise(clean)


def headings(text: Column) -> Column:
    """ATX headings outside fences, cleaned, distinct, in order (F8). A fence that is never closed hides
    the rest, so lines are folded with the fence's state."""
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("kept"))
    strip = f"^{SPACE}+|{SPACE}+$"

    def step(acc, line):
        line = F.regexp_replace(line, strip, "")
        fence = line.startswith("```")
        heading = ~fence & ~acc["fenced"] & line.rlike(r"^#{1,6}([ \t]|$)")
        return F.struct((acc["fenced"] != fence).alias("fenced"), F.when(heading, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"^{SPACE}*(#|```)"))
    found = F.aggregate(lines, start, step, lambda acc: acc["kept"])
    clean = F.transform(found, lambda h: unmark(strip_tags(unlink(F.regexp_replace(F.regexp_replace(h, "^#+", ""), "[# \t]+$", "")))))
    return F.array_distinct(F.filter(clean, lambda h: h != ""))


def slugify(text: Column) -> Column:
    """Lower-case a-z and 0-9 with single dashes, at most 48, "section" if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "section").otherwise(F.regexp_replace(F.substring(s, 1, 48), "-+$", ""))


def taxonomy_value(text: Column) -> Column:
    """A tag or category in its normal form, small letters, digits and dashes; null if nothing or more than 255
    characters are left (F12). A value that has the form already is its own."""
    t = F.regexp_replace(F.lower(text), "[^a-z0-9-]", "")
    return F.when((t != "") & (F.length(t) <= 255), t)


def taxonomy_list(values: Column) -> Column:
    """Normal forms in first-seen order. The form is made in one step and judged in the next, so it is made once."""
    forms = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.regexp_replace(F.lower(v), "[^a-z0-9-]", ""))
    return F.array_distinct(F.filter(forms, lambda t: (t != "") & (F.length(t) <= 255)))


def title_from_name(name: Column) -> Column:
    """Words of a file name, first letters raised, the rest as they are."""
    base = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"\.md$", "")
    parts = F.filter(F.split(base, "[-_ ]+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def title_from_id(node: Column) -> Column:
    """A title for a page without one: runs of - and _ become spaces, first letters are raised (F16)."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(node, "^.*/", ""), r"\.md$", ""), "^[-_]+", "")
    return F.array_join(F.transform(F.split(base, "[-_]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def valid_date(text: Column) -> Column:
    """The strict YYYY-MM-DD text or null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def byte_size(n: Column) -> Column:
    """1.5 MB and the like."""
    step = lambda k, unit: F.format_string(f"%.1f {unit}", F.bround(n / float(1 << (10 * k)), 1))
    return F.when(n >= 1 << 30, step(3, "GB")).when(n >= 1 << 20, step(2, "MB")).when(n >= 1 << 10, step(1, "KB")).otherwise(F.format_string("%d B", n))


def normal_url(url: Column) -> Column:
    """Trimmed, lower-case, without closing slashes."""
    return F.lower(F.regexp_replace(F.trim(url), "/+$", ""))


_MARKED = "|".join(MARKERS)


def escape_lines(text: Column) -> Column:
    """One more backslash before each line that is, or was escaped from, an archive marker."""
    return F.regexp_replace(text, rf"(?dm)^(\\*(?:{_MARKED}))", r"\\$1")


def unescape_lines(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?dm)^\\(\\*(?:{_MARKED}))", "$1")


def heading_label(trail: Column, title: Column) -> Column:
    return F.when(F.size(trail) <= 0, title).otherwise(F.array_join(trail, " > "))


def refuses(answer: Column) -> Column:
    """Whether an answer is empty or declines."""
    low = F.lower(collapse(answer))
    found = low == ""
    for phrase in REFUSALS:
        found = found | low.contains(phrase)
    return found


def emoji_mashups(text: Column, base: str = "https://emojik.vercel.app/s/") -> Column:
    """!ek[a+b] to an image of both emoji, by code points."""
    found = F.regexp_extract_all(text, F.lit(r"!ek\[[^\[\]+]+\+[^\[\]+]+\]"), F.lit(0))

    def code(emoji: Column) -> Column:
        points = F.transform(F.filter(F.split(emoji, ""), lambda c: c != ""), lambda c: F.lower(F.ltrim(F.hex(F.encode(c, "UTF-32")), F.lit("0"))))
        return F.array_join(points, "-")

    def one(acc, m):
        a, b = F.regexp_extract(m, r"\[([^+]+)\+", 1), F.regexp_extract(m, r"\+([^\]]+)\]", 1)
        return F.replace(acc, m, F.concat(F.lit(f"![]({base}"), code(F.trim(a)), F.lit("_"), code(F.trim(b)), F.lit(")")))

    return F.aggregate(found, text, one)


def plural(n: Column, one: str, more: str) -> Column:
    """F28."""
    return F.when(n == 1, one).otherwise(more)
