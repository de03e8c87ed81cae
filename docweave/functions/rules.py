"""Ordered rules, first match wins: rows of a small table compiled to one expression over a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """What the lower-cased text must hold: one of the alternatives, each a list of parts that all occur. The result may
    name {0}, which is group 1 of the first of the patterns that is found in the text as it stands; a rule whose
    patterns all fail says `otherwise`."""

    any_of: tuple[tuple[str, ...], ...]
    result: str
    patterns: tuple[str, ...] = ()
    otherwise: str = ""


def holds(lower: Column, rule: Rule) -> Column:
    out = F.lit(False)
    for parts in rule.any_of:
        every = F.lit(True)
        for p in parts:
            every = every & F.contains(lower, F.lit(p))
        out = out | every
    return out


def said(text: Column, rule: Rule) -> Column:
    if not rule.patterns:
        return F.lit(rule.result)
    head, _, tail = rule.result.partition("{0}")
    out = F
    for k, p in enumerate(rule.patterns):
        found = F.regexp_replace(F.regexp_extract(text, p, 1), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
        out = (F if k == 0 else out).when(found != "", F.concat(F.lit(head), found, F.lit(tail)))
    return out.otherwise(rule.otherwise)


def first_match(text: Column, rules: list[Rule], default: str) -> Column:
    """The result of the first rule that holds; null texts have none."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    lower, out = F.lower(text), F.when(text.isNull(), F.lit(None).cast("string"))
    for r in rules:
        out = out.when(holds(lower, r), said(text, r))
    return out.otherwise(default)


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules of a table: position, any_of (array of arrays of texts), result; a bounded number of rows."""
    rows = table.orderBy("position").limit(MOST_RULES + 1).collect()
    return [Rule(tuple(map(tuple, r["any_of"])), r["result"]) for r in rows]


def by_suffix(name: Column, table: dict[str, str], default: str) -> Column:
    """The entry with the longest suffix of a file name, letters of either case: one look-up for each number of dots
    that a suffix has. A suffix is cut from the last path element."""
    base = F.lower(F.regexp_extract(name, r"([^/]*)$", 1))
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = [F.try_element_at(entries, F.regexp_extract(base, rf"((?:\.[^.]*){{{n}}})$", 1)) for n in sorted({k.count(".") for k in table}, reverse=True)]
    return F.when(name.isNotNull(), F.coalesce(*found, F.lit(default)))


# Types that files are served with, and hints for messages.
CONTENT_TYPES = {
    ".html": "text/html; charset=utf-8",
    ".css": "text/css; charset=utf-8",
    ".js": "application/javascript; charset=utf-8",
    ".svg": "image/svg+xml",
    ".json": "application/json; charset=utf-8",
}
OTHER_TYPE = "application/octet-stream"
GUIDANCE = [
    Rule((("address already in use",), ("bind",)), "Port conflict: update 'port' in config.yaml or stop the existing process using the port."),
    Rule((("template",), ("layout",)), "Template syntax error: inspect layout templates for missing tags or invalid formatting."),
    Rule((("frontmatter",), ("yaml",), ("markdown",)), "Content syntax error: check YAML frontmatter formatting and key delimiters in content files."),
    Rule((("no such file",), ("not found",)), "Path missing: ensure content, template, and asset directories exist as configured."),
]
NO_GUIDANCE = "Check configuration in config.yaml and inspect detailed logs in Diagnostics drawer (press 'd')."
#: The command that the hints name is this engine's own; what they say about a message is fixed.
CHECK = "run `docweave check"
NEXT_ACTIONS = [
    Rule((("case-insensitive filesystem",), ("would be the same file on a case-insensitive",)), "case-only collision is same file on case-insensitive filesystem; rename one path"),
    Rule((("frontmatter",),), "fix frontmatter in {0}", (r"frontmatter (?:parse )?warning in ([^:]+):", r"(?si)^(?:(?! in ).)* in ((?-i:(?=[^:]*\.md)[^:]*)):"), "fix frontmatter in offending file"),
    Rule((("broken internal link",),), f"{CHECK}` to list broken links"),
    Rule((("missing referenced asset",), ("missing asset",), ("asset", "missing")), f"{CHECK} --asset-health` to diagnose asset issues"),
    Rule((("unusually large raster",),), f"{CHECK} --asset-health` to diagnose large raster assets (consider optimizing)"),
    Rule((("suspicious image extension",), ("unsupported or suspicious image",)), f"{CHECK} --asset-health` to diagnose unsupported image formats"),
    Rule((("case mismatch",), ("case-collision",), ("case collision",)), f"{CHECK} --asset-health` — asset case mismatch"),
    Rule((("output path collision", "case-insensitive"),), "case-only collision"),
    Rule((("output path collision",),), f"{CHECK}` — output collision: rename one source or slug"),
]


def content_type(name: Column) -> Column:
    """by the extension of a file name."""
    return by_suffix(name, CONTENT_TYPES, OTHER_TYPE)


def guidance(message: Column) -> Column:
    """what to do about a failed build."""
    return first_match(message, GUIDANCE, NO_GUIDANCE)


def next_action(message: Column) -> Column:
    """what to do about a diagnostic; empty if there is nothing to say."""
    return first_match(message, NEXT_ACTIONS, "")
