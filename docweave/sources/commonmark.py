"""Links and images of Markdown texts as CommonMark has them; runs in Arrow batches.

Blocks are told line by line: fenced and indented code, HTML blocks and reference definitions hold no
links; quotes and lists are entered. Inline text is read once with a stack of open brackets, so nested
brackets, images inside links, code spans, autolinks, raw HTML and escapes take the precedence that
CommonMark gives them. A link holds no other link.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
HEADING = re.compile(r" {0,3}#{1,6}([ \t]|$)")
BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])([ \t]+|$)")
QUOTE = re.compile(r" {0,3}> ?")
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<][^\s]*)(?:[ \t]*\n?[ \t]+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)", re.S)
PLAIN_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<][^\s]*)[ \t]*(?:\n|$)", re.S)
HTML_START = re.compile(r" {0,3}<(?:script|pre|style|textarea|!--|\?|![A-Za-z]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))", re.I)
HTML_UNTIL = ((re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile(r" {0,3}<!--"), re.compile("-->")), (re.compile(r" {0,3}<\?"), re.compile(r"\?>")))
AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
RAW_TAG = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|!--.*?--|\?.*?\?|![A-Za-z][^>]*)>", re.S)
TICKS = re.compile("`+")
TITLE = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)", re.S)
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def _plain(text: str) -> str:
    return html.unescape(ESCAPE.sub(r"\1", text))


def _name(label: str) -> str:
    return " ".join(label.split()).casefold()


def _blocks(body: str) -> Iterator[str]:
    """Runs of inline text: paragraphs (with definitions still in them), headings, table rows."""
    held: list[str] = []
    fence = until = None
    quoted = False  # whether the open fence stands in a quote
    lists: list[int] = []  # columns where the contents of open list items begin
    blank = True
    for raw in body.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = raw.expandtabs(4)
        inside = False
        while (not fence or quoted) and (q := QUOTE.match(line)):
            line, inside = line[q.end() :], True
        if fence and quoted and not inside:
            fence = None  # the quote has ended, and its code with it
        if fence:
            close = line.strip()
            if close and close[0] == fence[0] and len(close) >= len(fence) and not close.strip(fence[0]):
                fence = None
            continue
        if until:
            if until == "blank" and not line.strip() or until != "blank" and until.search(line):
                until = None
            continue
        if not line.strip():
            if held:
                yield "\n".join(held)
            held, blank = [], True
            continue
        indent = len(line) - len(line.lstrip())
        if blank or not held:
            while lists and indent < lists[-1]:
                lists.pop()
        inner = line[lists[-1] :] if lists and indent >= lists[-1] else line
        if not held and len(inner) - len(inner.lstrip()) >= 4:
            blank = False
            continue  # indented code
        blank = False
        while (m := ITEM.match(inner)) and not BREAK.match(inner):
            if held:
                yield "\n".join(held)
                held = []
            if lists and indent < lists[-1]:
                lists.pop()
            width = m.end() if m[3] and len(m[3]) <= 4 else m.end(2) + 1
            lists.append((lists[-1] if lists else 0) + width)
            inner = inner[width:]
            indent = lists[-1]
            if len(inner) - len(inner.lstrip()) >= 4:
                inner = ""  # indented code in the item
        if not inner.strip():
            continue
        if f := FENCE.match(inner):
            if held:
                yield "\n".join(held)
                held = []
            fence, quoted = f[1], inside
            continue
        if not held and HTML_START.match(inner) and not AUTOLINK.match(inner.strip()) and (RAW_TAG.match(inner.strip()) is None or RAW_TAG.match(inner.strip()).end() == len(inner.strip()) or _block_tag(inner)):
            ends = next((end for start, end in HTML_UNTIL if start.match(inner)), "blank")
            until = None if ends != "blank" and ends.search(inner) else ends
            continue
        if HEADING.match(inner) or BREAK.match(inner):
            if held:
                yield "\n".join(held)
                held = []
            yield inner.strip()
            continue
        held.append(inner.strip(" "))
    if held:
        yield "\n".join(held)


# Names of elements that begin an HTML block whatever follows them on the line.
BLOCK_TAGS = (
    "address", "article", "aside", "base", "basefont", "blockquote", "body", "caption", "center", "col", "colgroup",
    "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "frame", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "iframe", "legend", "li",
    "link", "main", "menu", "menuitem", "nav", "noframes", "ol", "optgroup", "option", "p", "param", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "track", "ul",
)


def _block_tag(line: str) -> bool:
    m = re.match(r" {0,3}</?([A-Za-z][A-Za-z0-9-]*)", line)
    return not m or m[1].lower() in BLOCK_TAGS


def _definitions(block: str, known: dict[str, str]) -> str:
    """Take the definitions off the beginning of a paragraph; the first one of a name counts."""
    while m := DEFINITION.match(block) or PLAIN_DEFINITION.match(block):
        if not m[1].strip():
            break
        place = m[2][1:-1] if m[2].startswith("<") else m[2]
        known.setdefault(_name(m[1]), _plain(place))
        block = block[m.end() :]
    return block


def _destination(text: str, at: int) -> tuple[str, int] | None:
    """The destination of an inline link whose bracket ends before `at` and the place after its closing bracket."""
    n = len(text)
    skip = lambda k: next((j for j in range(k, n) if not text[j].isspace()), n)
    k = skip(at + 1)
    if k < n and text[k] == "<":
        end = k + 1
        while end < n and text[end] not in "<>\n":
            end += 2 if text[end] == "\\" else 1
        if end >= n or text[end] != ">":
            return None
        place, k = text[k + 1 : end], end + 1
    else:
        start, depth = k, 0
        while k < n and not text[k].isspace() and text[k] >= " ":
            if text[k] == "\\" and k + 1 < n:
                k += 1
            elif text[k] == "(":
                depth += 1
                if depth > 32:
                    return None
            elif text[k] == ")":
                if not depth:
                    break
                depth -= 1
            k += 1
        if depth:
            return None
        place = text[start:k]
    after = skip(k)
    if after > k and after < n and text[after] in "\"'(":
        t = TITLE.match(text, after)
        if not t:
            return None
        after = skip(t.end())
    return (_plain(place), after + 1) if after < n and text[after] == ")" else None


def _inline(text: str, known: dict[str, str]) -> Iterator[tuple[int, bool, str]]:
    """(place, is an image, destination) of the links and images of a run of inline text."""
    stack: list[list] = []  # place, is an image, may be a link
    unclosed: set[int] = set()  # lengths of back-tick runs that do not come again
    k, n = 0, len(text)
    while k < n:
        c = text[k]
        if c == "\\":
            k += 2
        elif c == "`":
            run = TICKS.match(text, k).end() - k
            close = None if run in unclosed else re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(text, k + run)
            if not close:
                unclosed.add(run)
            k = close.end() if close else k + run
        elif c == "<":
            tag = AUTOLINK.match(text, k) or RAW_TAG.match(text, k)
            k = tag.end() if tag else k + 1
        elif c == "!" and text.startswith("![", k):
            stack.append([k, True, True])
            k += 2
        elif c == "[":
            stack.append([k, False, True])
            k += 1
        elif c == "]" and stack:
            start, image, live = stack.pop()
            k += 1
            if not live:
                continue
            found = _destination(text, k) if text.startswith("(", k) else None
            if found is None:
                label = LABEL.match(text, k)
                inner = text[start + 1 + image : k - 1]
                full = label and label[1].strip()
                place = known.get(_name(label[1] if full else inner))
                if place is None or not full and not LABEL.fullmatch(f"[{inner}]"):
                    continue
                found = place, label.end() if label else k
            yield start, image, found[0]
            k = found[1]
            if not image:  # a link holds no other link
                for s in stack:
                    s[2] = s[2] and s[1]
        else:
            k += 1


def references(body: str | None) -> list[dict]:
    """dest and image of all links and images of a Markdown text, in the order in which they begin."""
    if not body or "[" not in body:
        return []
    known: dict[str, str] = {}
    blocks = [_definitions(b, known) for b in _blocks(body)]
    return [{"dest": dest, "image": image} for b in blocks if "[" in b for _, image, dest in sorted(_inline(b, known), key=lambda x: x[0])]


REFERENCES = "array<struct<dest: string, image: boolean>>"

#: Inline links and images on one line whose texts hold no brackets, and code spans on one line.
SIMPLE = r"""!?\[[^\[\]\n]*\]\([^\s()<>\[\]"'`]*(?: +"[^"\[\]\n]*")?\)"""
SPAN = r"`[^`\n]+`"
#: What gives brackets another meaning: HTML, escapes, entities, longer code, indented code, ticks in destinations.
ODD = r"(?m)[<\\&\r]|``|~~~|^[ \t>*+0-9.)-]*(?: {4}|\t)|\]\([^)\n]*`"


def _without_code(body: Column) -> Column:
    return F.regexp_replace(body, SPAN, "")


def _simple(body: Column) -> Column:
    """Whether all brackets of a text belong to simple links, images and code spans."""
    rest = F.regexp_replace(_without_code(body), SIMPLE, "")
    return ~body.rlike(ODD) & ~rest.rlike(r"[\[\]`]")


def _simple_references(body: Column) -> Column:
    found = F.regexp_extract_all(_without_code(body), F.lit(SIMPLE), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"""\]\(([^\s()"]*)""", 1).alias("dest"), m.startswith("!").alias("image")))


def parsed_references(body: Column) -> Column:
    """references() of a column. Texts without brackets and those with simple ones never leave the JVM; the others are
    parsed in Arrow batches."""

    @F.arrow_udf(REFERENCES)
    def read(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("dest", pa.string()), ("image", pa.bool_())]))
        return pa.array([references(t) for t in texts.to_pylist()], kind)

    linked = F.coalesce(body.contains("["), F.lit(False))
    odd = linked & ~_simple(body)
    return F.when(odd, read(F.when(odd, body))).when(linked, _simple_references(body)).otherwise(F.array().cast(REFERENCES))
