"""Personal data: patterned entities, and the terms that disclose them.

Entities of four kinds are found by pattern. Protected are each different value, what values share (the host of
addresses, the first two numbers of IPs, the first digits of cards and phones) and each kind as such. With N the number
of different texts, n(e) those that hold the entity e, n(t) those with the term t and n(t, e) those with both,

    PMI(t; e) = log2(n(t, e) * N / (n(t) * n(e))),   IC(e) = log2(N / n(e)).

PMI equals IC if every text with the term holds the entity: the term then tells all there is to know. A term
discloses an entity from GENERALISE * IC(e) on, if at least SUPPORT different texts hold both, so that no single
text and its copies prove anything. In every text that holds the entity the disclosing terms are generalised;
from REMOVE * IC(e) on they are removed. All statistics are over different texts of the whole corpus.

Entities that stand in the same set of texts have the same statistics, so terms are paired with such sets, not
with entities: a list of a thousand addresses that occurs in five texts is one set. Sets are told by count, sum
and xor of hashes of their texts. Before they are paired, terms go that too few texts with entities hold, or too large
a share of texts without: n(t, e) is at most the number h(t) of texts with entities that hold t, so a term with
h(t) / n(t) < (SUPPORT / N) ^ (1 - GENERALISE) discloses nothing.

All expressions are Spark's own. Patterns are possessive and running sums are taken in parts of PART values, so a text
takes time in proportion to its length and PART times its matches.

Defined results: null counts as empty; a document without entities has no further spans; further spans that
touch an entity are dropped; rows that repeat a text count once in all shares and have the same spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import small, stored

GENERALISE, REMOVE, SUPPORT = 0.8, 0.95, 3
PART = 256
KINDS = ("email", "ip", "card", "phone")
ADDED = ("generalise", "remove")

LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # a match can begin only where a run of its first characters begins, or where the last match ended
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BYTE = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
SPAN = "array<struct<start: long, end: long, kind: int, value: string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(total, i):
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals from 0 of an array of longs, in parts whose totals are added up first."""
    zero = F.lit(0).cast("long")

    def totals(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<long>").alias("out"))
        step = lambda acc, x: let(add(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    cuts = lambda v: F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / PART).cast("int"))
    parts = lambda v: F.transform(cuts(v), lambda c: F.slice(v, c * PART + 1, F.lit(PART)))
    joined = lambda p: lambda ends: F.flatten(F.transform(p, lambda q, i: totals(q, F.when(i > 0, F.get(ends, i - 1)).otherwise(zero))))
    return let(let(values, parts), lambda p: let(totals(F.transform(p, lambda q: F.aggregate(q, zero, add)), zero), joined(p)))


def matches(text: Column, pattern: Column, kind: int) -> Column:
    """Places of all matches: the lengths of the matches and of what lies between them, added up."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: (F.length(b) + F.length(m)).cast("long"))
    held = F.struct(found.alias("found"), running(steps, lambda a, b: a + b).alias("ends"))

    def spans(x: Column) -> Column:
        one = lambda m, i: F.struct((F.get(x["ends"], i) - F.length(m)).alias("start"), F.get(x["ends"], i).alias("end"), F.lit(kind).alias("kind"), m.alias("value"))
        return F.transform(x["found"], one)

    return let(held, spans).cast(SPAN)


def _keeps(kind: str):
    return lambda s: VALID[kind](s["value"])


def _of(kind: int):
    return lambda s: s["kind"] == kind


def entities(text: Column) -> Column:
    """All entities of a text by start, then kind."""
    none = F.array().cast(SPAN)
    parts = []
    for k, kind in enumerate(KINDS):
        gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GATES[kind])
        parts.append(F.when(gate, F.filter(matches(text, F.lit(PATTERNS[kind]), k), _keeps(kind))).otherwise(none))
    return F.array_sort(F.concat(*parts), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS + ADDED))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


TERM = r"\p{L}{3,}+"


def terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def shared_part(span: Column) -> Column:
    """What values of one kind may share: the host of an address, the network of an IP, first digits of numbers."""
    value, kind = span["value"], span["kind"]
    host = F.lower(F.regexp_extract(value, "@(.*)$", 1))
    return F.when(kind == 0, host).when(kind == 1, F.regexp_extract(value, r"^[0-9]+\.[0-9]+", 0)).otherwise(F.substring(_digits(value), F.lit(1), F.when(kind == 2, 6).otherwise(4)))


def protected(spans: Column) -> Column:
    """Hashes of all entities of a text: values, shared parts, kinds."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.array(F.xxhash64(s["kind"], s["value"]), F.xxhash64(F.lit("part"), s["kind"], shared_part(s)), F.xxhash64(F.lit("kind"), s["kind"])))))


def disclosing_terms(texts: DataFrame, found: DataFrame, generalise: float, remove_at: float, support: int) -> DataFrame:
    """doc, text_key, term, out (removed or generalised) of one row of each text with entities. texts: doc,
    text_key, text; found: doc, text_key, base."""
    # entities in `support` texts or more, with the set of their texts
    each = found.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc").alias("doc"), F.first("base").alias("base"))
    each = stored(each.filter((F.col("copies") > 1) | (F.size("base") > 0)).select("text_key", "copies", "doc", protected(F.col("base")).alias("entities")), "holders")
    n = found.count() - (each.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    held = each.select("text_key", "doc", F.explode("entities").alias("entity"))
    mark = F.xxhash64("text_key", F.lit("set"))
    sets = held.groupBy("entity").agg(F.count("*").alias("n_set"), F.sum(mark.cast("decimal(38,0)")).alias("total"), F.bit_xor(mark).alias("parity"))
    sets = sets.filter(F.col("n_set") >= support).select("entity", "n_set", F.xxhash64("n_set", "total", "parity").alias("entity_set"))
    members = stored(held.join(small(stored(sets, "entity-sets")), "entity").select("text_key", "doc", "entity_set", "n_set").distinct(), "members")
    # terms of one row of each text that holds such a set, if enough of these texts hold them
    rows = small(members.select("doc", "text_key").distinct())
    seen = stored(texts.join(rows, ["doc", "text_key"]).select("text_key", F.explode(terms(F.col("text"))).alias("term")).distinct(), "held-terms")
    often = stored(seen.groupBy("term").agg(F.count("*").alias("n_held")).filter(F.col("n_held") >= support), "often-held")
    # texts with each of these terms; a text that repeats is told by its key
    again = small(each.filter("copies > 1").select("text_key", F.lit(True).alias("again")))
    every = texts.join(again, "text_key", "left").select(F.when(F.col("again"), F.col("text_key")).alias("repeat"), F.explode(terms(F.col("text"))).alias("term"))
    counted = every.join(small(often.select("term")), "term", "left_semi").groupBy("term", "repeat").agg(F.count("*").alias("n"))
    n_term = counted.groupBy("term").agg(F.sum(F.when(F.col("repeat").isNull(), F.col("n")).otherwise(1)).alias("n_term"))
    least = (support / max(float(n), support)) ** (1 - generalise)
    telling = stored(often.join(n_term, "term").filter(F.col("n_held") >= F.lit(least * (1 - 1e-9)) * F.col("n_term")).select("term", "n_term"), "telling-terms")
    pairs = seen.join(small(telling), "term").join(small(members.drop("doc")), "text_key")
    together = pairs.groupBy("term", "entity_set").agg(F.count("*").alias("n_both"), F.first("n_set").alias("n_set"), F.first("n_term").alias("n_term"))
    ic = F.log2(F.lit(float(n)) / F.col("n_set"))
    pmi = F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_term") * F.col("n_set")))
    told = together.filter(F.col("n_both") >= support).select("term", "entity_set", pmi.alias("pmi"), ic.alias("ic")).filter((F.col("ic") > 0) & (F.col("pmi") >= generalise * F.col("ic")))
    told = small(stored(told, "disclosing"))
    out = seen.join(told, "term").join(small(members.drop("doc")), ["text_key", "entity_set"]).groupBy("text_key", "term").agg(F.max(F.col("pmi") >= remove_at * F.col("ic")).alias("out"))
    return out.join(small(members.select("doc", "text_key").distinct()), "text_key")


def term_spans(texts: DataFrame, told: DataFrame, found: DataFrame) -> DataFrame:
    """text_key, added: the places of the terms told (doc, text_key, term, out) for each text, but for those that touch
    an entity (found: doc, text_key, base). Places are sums of lengths over the runs of one text and entities are met
    in the order of their places, both in windows, so time stays in proportion to the text."""
    wanted = small(told.select("doc", "text_key").distinct())
    rows = texts.join(wanted, ["doc", "text_key"])
    runs, between = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    runs = rows.select("text_key", F.posexplode(F.arrays_zip(runs.alias("run"), F.slice(between, 1, F.size(runs)).alias("gap"))).alias("pos", "x")).dropDuplicates(["text_key", "pos"])
    until = Window.partitionBy("text_key").orderBy("pos")
    ends = runs.select("text_key", F.lower("x.run").alias("term"), F.length("x.run").alias("n"), F.sum(F.length("x.gap") + F.length("x.run")).over(until).alias("end"), F.col("x.run").alias("value"))
    kind = F.when(F.col("out"), len(KINDS) + 1).otherwise(len(KINDS))
    placed = ends.join(told.select("text_key", "term", "out"), ["text_key", "term"]).select("text_key", (F.col("end") - F.col("n")).cast("long").alias("start"), F.col("end").cast("long").alias("end"), kind.alias("kind"), "value", F.lit(False).alias("entity"))
    base = found.join(wanted, ["doc", "text_key"]).select("text_key", F.explode("base").alias("s")).select("text_key", "s.*", F.lit(True).alias("entity")).distinct()
    same = Window.partitionBy("text_key")
    before = same.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = same.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    both = placed.unionByName(base).withColumn("reach", F.max(F.when(F.col("entity"), F.col("end"))).over(before)).withColumn("next", F.min(F.when(F.col("entity"), F.col("start"))).over(behind))
    apart = both.filter("NOT entity AND coalesce(reach <= start, true) AND coalesce(next >= end, true)")
    return apart.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "value"))).cast(SPAN).alias("added"))


def personal_data(docs: DataFrame, generalise: float = GENERALISE, remove_at: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """doc_id, text_key, base (entities) and added (terms) for every row, as arrays of spans in code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.md5(text).alias("text_key"), text.alias("text"))
    found = stored(texts.select("doc_id", "doc", "text_key", entities(F.col("text")).alias("base")), "entities")
    told = stored(disclosing_terms(texts, found, generalise, remove_at, support), "told")
    added = term_spans(texts, told, found)
    out = found.join(small(stored(added, "added")), "text_key", "left")
    return out.select("doc_id", "text_key", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def sanitised(text: Column, base: Column, added: Column) -> Column:
    """The text with entities and generalised terms replaced by their kind and removed terms left out. Of spans that
    overlap the first counts. The text is cut into its characters once, so time stays in proportion to it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]"), F.lit(""))
    spans = F.array_sort(F.concat(base, added), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]))
    part = lambda x, a, b: F.array_join(F.slice(x["letters"], a.cast("int") + 1, (b - a).cast("int")), "")

    def joined(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["upto"], i - 1)).otherwise(0).cast("long")
        piece = lambda s, i: let(before(i), lambda at: F.when(s["start"] >= at, F.concat(part(x, at, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(""))
        end = before(F.size(x["upto"]))
        return F.concat(F.array_join(F.transform(x["spans"], piece), ""), part(x, end, F.size(x["letters"]).cast("long")))

    whole = lambda s: F.struct(s.alias("spans"), running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)).alias("upto"), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)).alias("letters"))
    return let(let(spans, whole), joined)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans."""
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    both = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]))
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(both).alias("spans"))
