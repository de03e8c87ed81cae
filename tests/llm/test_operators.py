"""The registered queries and operators on small tables: edge cases, brute force, SQL."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from docweave.llm import cuckoo, features, mixing, quality_fm, queries, sanitise, set_sketch, sql, token_counts, token_ids, toxicity, warc, wu_manber  # noqa: E402
from docweave.llm.common import scratch_path  # noqa: E402
from oracle import same_rows  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, word string, rank string, size string, start string, n string, row string, title string"
LONG = " ".join(f"w{k}" for k in range(30_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 1),
    (2, "one two three four five six seven eight nine ten", "en", "a", 1),
    (2, "one two three four five six seven eight nine ten", "en", "a", 1),
    (3, "", None, None, None),
    (4, None, None, "b", None),
    (5, "  \n\t ", "en", "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG + " end", "en", "c", None),
    (8, "x" * 50_000, "en", "a", 1),
    (None, "no id here", "en", "a", 1),
    (9, "one", None, None, 3),
    (10, "mail a@b.org or +1 (555) 123-4567, 4111 1111 1111 1111 and 10.0.0.255", "en", "a", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *["?"] * 9) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id > 1000")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same_rows(queries.queries()[name](spark, sf), sql.oracle_sql()[name], sf)


def test_no_operator_crashes_on_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    made = [token_counts.prefix_token_counts(none, byte), quality_fm.quality_scores(none, labels), token_ids.token_ids(none, word, 2), set_sketch.near_duplicates(none), warc.archived(pages), toxicity.toxicity(none, labels), cuckoo.exact_duplicates(none), sanitise.digests(sanitise.personal_data(none)), mixing.mixed(none), wu_manber.contamination(none, items)]
    assert [m.count() for m in made] == [0] * 10


def test_token_counts(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = by_id(token_counts.prefix_token_counts(odd, path, limit=5, keep_tables=True))
    assert (got[3]["n_tokens"], got[4]["n_tokens"], got[4]["n_bytes"]) == (0, 0, 0)
    assert got[1]["over_limit"] and token_counts.count_at(got[1]["prefix_deltas"], got[1]["cut_chars"]) == 5
    assert got[None]["n_tokens"] == 3


def test_token_counts_and_ids_of_the_whole_table(spark, sf, documents):
    from tokenizers import Tokenizer

    byte, word = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    counts = queries.op1_token_counts(spark, sf).collect()
    want = {(i, len(t.encode()), n := len(e.ids), n > 1024) for i, t, e in zip(documents.doc_id, documents.text, byte.encode_batch(documents.text.tolist(), add_special_tokens=False))}
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts} == want and len(counts) == len(documents)
    at, want = 0, []
    for i, t in sorted(zip(documents.doc_id, documents.text)):
        ids = [*word.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.op3_token_ids(spark, sf).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_token_ids(odd, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    block = token_ids.BLOCK
    token_ids.BLOCK = 1000  # so that documents span blocks
    try:
        got = sorted(token_ids.token_ids(odd, path, 2).collect(), key=lambda r: r["start"])
    finally:
        token_ids.BLOCK = block
    want = sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0]))
    at = 0
    for r, w in zip(got, want, strict=True):
        ids = [*lib.encode(w[1] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (w[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def brute_components(rows, width, percent):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w)} if 0 < len(w) < width else {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for k in sets:
        shared = Counter()
        for s in sets[k]:
            for j in where[s]:
                shared[j] += 1
            where[s].append(k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                up[find(k)] = find(j)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[find(k)] = min(i, smallest.get(find(k), i))
    return [(i, len(sets[k]), smallest[find(k)]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, sf, documents, width, percent):
    got = set_sketch.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), width, percent)
    want = brute_components(list(zip(documents.doc_id, documents.text)), width, percent)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(want)


def test_near_duplicates_in_one_large_group_and_small_blocks(spark):
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 120)]
    rows = []
    for k in range(260):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 7)):
            w[j] = f"n{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    size = set_sketch.BLOCK_ROWS
    set_sketch.BLOCK_ROWS = 40
    try:
        got = set_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    finally:
        set_sketch.BLOCK_ROWS = size
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, 3, 85))


@pytest.mark.parametrize("shape", ["drift", "two stars", "apart"])
def test_near_duplicates_in_groups_that_are_no_star(spark, shape):
    """Groups of several blocks of which a centre reaches all, some or none."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows, w = [], list(base)
    for k in range(230):
        if shape == "drift":  # each text is near the one before it
            w[(k * 7) % 150] = f"d{k}"
            rows.append((k, " ".join(w)))
        elif shape == "two stars":
            v = [*base[:100], *(f"{'ab'[k % 2]}{j}" for j in range(14)), *base[114:]]
            v[rng.integers(0, 150)] = f"n{k}"
            rows.append((k, " ".join(v)))
        else:  # a long shared passage, and as much of their own
            rows.append((k, " ".join([*base, *(f"x{k}y{j}" for j in range(60 + k % 5))])))
    size = set_sketch.BLOCK_ROWS
    set_sketch.BLOCK_ROWS = 30
    try:
        got = set_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    finally:
        set_sketch.BLOCK_ROWS = size
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, 3, 85))


@pytest.mark.parametrize("share", [0.5, 0.8, 0.85, 0.95])
def test_least_equal_registers_by_exact_tail(share):
    p, n = set_sketch.equal_chance(share), set_sketch.REGISTERS
    chance = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    least = set_sketch.least_equal(share)
    assert sum(chance[:least]) < 1e-6 <= sum(chance[: least + 1])


def template_pages(n, rng):
    """Pages that share half of their shingles with each other, a few near copies of some, and many of one."""
    head = " ".join(f"t{k}" for k in range(130))
    own = lambda k: [f"p{k}x{j}" for j in range(66)]
    rows = [(k, f"{head} {' '.join(own(k))}") for k in range(n)]
    rows += [(n + k, f"{head} {' '.join(own(k)[:-1])} q{k}") for k in range(0, n, 40)]
    rows += [(3 * n + k, f"{head} {' '.join(own(7))} r{k}") for k in range(n // 4)]
    rng.shuffle(rows)
    return rows


def test_large_buckets_of_unlike_texts_take_rows_in_proportion(spark, monkeypatch):
    rng, made = random.Random(4), {}
    kept = set_sketch.stored

    def counted(df, label, *a):
        out = kept(df, label, *a)
        if label in ("beams", "rare-lists", "stars"):
            made[label] = made.get(label, 0) + out.count()
        return out

    blocks = set_sketch._trees

    def trees(rows, group, percent):
        made["rows"] = made.get("rows", 0) + rows.count()
        return blocks(rows, group, percent)

    monkeypatch.setattr(set_sketch, "stored", counted)
    monkeypatch.setattr(set_sketch, "_trees", trees)
    monkeypatch.setattr(set_sketch, "BLOCK_ROWS", 20)
    seen = {}
    for n in (200, 800):
        made.clear()
        rows = template_pages(n, rng)
        got = {r["doc_id"]: r["component_id"] for r in set_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
        assert got == {i: c for i, _, c in brute_components(rows, 3, 85)}
        seen[n] = sum(made.values())
    assert seen[800] < 7 * seen[200]  # four times the texts; all pairs would be sixteen times


def test_components_that_are_not_settled_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        set_sketch.components(chain, max_rounds=1)
    assert {r["root"] for r in set_sketch.components(chain).collect()} == {0}


def test_near_duplicates_edges(odd):
    rows = set_sketch.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert [r["component_id"] for r in got[2]] == [1, 1] and not got[2][0]["kept"]
    assert got[7][0]["component_id"] == 6 and got[None][0]["kept"] and got[None][0]["component_id"] is None
    assert all(got[k][0]["n_shingles"] == 0 and got[k][0]["kept"] for k in (3, 4, 5))


def test_warc_rows(spark):
    big = "y" * 200
    rows = [(1, "u", big), (2, None, big), (3, "u v", ""), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (1, "u", big), (None, "u", big), (7, "u", "é" * 60)]
    got = warc.archived(spark.createDataFrame([(*r, "?") for r in rows], "page_id long, url string, html string, digest string")).collect()
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == [(0, "revisit", 1, 200), (1, "response", None, 200), (1, "response", None, 200), (2, "revisit", 1, 200), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 5), (6, "response", None, 5), (7, "response", None, 120)]
    assert all(r["payload_digest"] == hashlib.sha256(big.encode()).hexdigest() for r in got if r["payload_bytes"] == 200)


def test_warc_rows_that_repeat_in_other_tasks(spark, tmp_path):
    once = [(k, f"http://x/{k}", f"<p>{k}</p>" * 30 if k % 3 else None) for k in range(60)] + [(None, None, None)] * 5
    df = spark.createDataFrame(once, "page_id long, url string, html string").coalesce(1)
    for n in range(4):
        df.write.mode("append").parquet(f"{tmp_path}/pages")
    got = warc.archived(spark.read.parquet(f"{tmp_path}/pages")).collect()
    assert len(got) == 4 * len(once)
    assert Counter((r["page_id"], r["payload_bytes"]) for r in got) == Counter({(p, len(h or "")): 0 for p, _, h in once} | Counter([(p, len(h or "")) for p, _, h in once] * 4))


def test_warc_archives_of_empty_pages_are_bounded(spark):
    sizes = warc.ARCHIVE_BYTES, warc.FOLDER_ARCHIVES
    warc.ARCHIVE_BYTES, warc.FOLDER_ARCHIVES = 1 << 20, 3
    try:
        pages = spark.range(100_000).selectExpr("if(id < 50, id, null) AS page_id", "cast(null AS string) AS url", "cast(null AS string) AS html").repartition(3)
        root = scratch_path(spark, "warc-test")
        rows = warc.archived(pages, root)
        assert rows.count() == 100_000 and rows.filter("page_id IS NOT NULL").distinct().count() == 50
        index = spark.read.parquet(f"{root}/index").groupBy("archive").agg(F.count("*").alias("n"), F.countDistinct("folder").alias("folders")).collect()
        assert len(index) > 20 and max(r["n"] for r in index) < 6_000 and {r["folders"] for r in index} == {1}
    finally:
        warc.ARCHIVE_BYTES, warc.FOLDER_ARCHIVES = sizes


def test_warc_long_payloads_and_clashing_columns(spark):
    rows = [(k, "u", "<p>" + f"{k % 2}é" * 400_000, "?", k, "?", "?", "?") for k in range(4)] + [(9, "\r\nWARC/1.1", "\r\n\r\nWARC/1.1\r\n" * 20, "?", 1, "?", "?", "?")]
    got = by_id(warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string, payload_bytes long, text string, data string, record_type string")).withColumnRenamed("page_id", "doc_id"))
    for k, _, html, *_ in rows:
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
    assert [(got[k]["record_type"], got[k]["refers_to"]) for k in (0, 1, 2, 3, 9)] == [("response", None), ("response", None), ("revisit", 0), ("revisit", 1), ("response", None)]


def test_exact_duplicates(odd):
    rows = cuckoo.exact_duplicates(odd, shards=2).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in got[2]] == [(2, 3, True)] * 2
    assert (got[1][0]["keep_id"], got[1][0]["kept"]) == (2, False) and got[3][0]["keep_id"] == 4
    assert got[4][0]["text_sha256"] == hashlib.sha256(b"").hexdigest() and got[None][0]["kept"]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


ODD_TEXTS = ["a@b.c.@d.e x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 00001.2.3.004", "éé😀 me@x.org and 4111111111111111-1", "a@b.c-d@e.f @@ a@@b.c", "9" * 20_000, "a." * 9_000 + "@x.y", "+1+1+1 +12 345 678 901", "", None]
# a term of three texts with one address, a list of addresses, copies of one text, a term seen elsewhere too
PLANTED = [f"Contact ZZQuorvex today, page {'abc'[k]}xx: mail one@zz.org, ÉTÉzz" for k in range(3)] + ["other ÉTÉzz page"]
PLANTED += [f"list zzlist {'abcd'[k] * 4} of " + " ".join(f"p{j}@y.org" for j in range(200)) for k in range(4)]
PLANTED += ["copied zzcopy text with same@x.org in it"] * 9
PLANTED += ["zzlong one@zz.org " + " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}zz" for k in range(9_000))]


def protected(spans):
    """Values, what values share, and kinds of (start, span, value)."""
    digits = lambda v: re.sub("[^0-9]", "", v)
    part = {"email": lambda v: v.partition("@")[2].lower(), "ip": lambda v: ".".join(v.split(".")[:2]), "card": lambda v: digits(v)[:6], "phone": lambda v: digits(v)[:4]}
    kinds = {(x.split(":")[0], v) for _, x, v in spans}
    return {("value", k, v) for k, v in kinds} | {("part", k, part[k](v)) for k, v in kinds} | {("kind", k) for k, _ in kinds}


def plain_sanitised(texts):
    """All spans of each text: entities by a plain search, terms by sets of different texts."""
    base = {t: [(int(x.split(":")[1]), x, t[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in plain_spans(t).split(",") if x] for t in set(texts)}
    of_entity, of_term = defaultdict(set), defaultdict(set)
    runs = {t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", t)] for t in base}
    for t in base:
        for entity in protected(base[t]):
            of_entity[entity].add(t)
        for _, _, w in runs[t]:
            of_term[w].add(t)
    out, n = {}, len(base)
    for t in base:
        spans = {}
        for entity in protected(base[t]):
            have = of_entity[entity]
            ic = math.log2(n / len(have))
            if len(have) < 3 or ic <= 0:
                continue
            for a, b, w in runs[t]:
                both = len(have & of_term[w])
                told = math.log2(both * n / (len(of_term[w]) * len(have))) / ic if both >= 3 else 0
                if told >= 0.8 - 1e-12 and not any(a < int(x.split(":")[2]) and s < b for s, x, _ in base[t]):
                    kind = "remove" if told >= 0.95 - 1e-12 else "generalise"
                    spans[a, b] = "remove" if "remove" in (kind, spans.get((a, b))) else kind
        every = [(s, x) for s, x, _ in base[t]] + [(a, f"{k}:{a}:{b}") for (a, b), k in spans.items()]
        order = {k: i for i, k in enumerate(sanitise.KINDS + sanitise.ADDED)}
        out[t] = ",".join(x for _, x in sorted(every, key=lambda y: (y[0], order[y[1].split(":")[0]])))
    return out


def test_personal_data_equals_a_plain_search(spark, documents):
    texts = [*documents.text, *ODD_TEXTS, *PLANTED]
    rows = [(k, t, "?") for k, t in enumerate(texts)] + [(5, texts[5], "?"), (None, PLANTED[0], "?"), (None, None, "?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumn("base", F.lit(1)).withColumn("term", F.lit(2)).repartition(5)
    found = sanitise.personal_data(docs)
    got = sanitise.digests(found).collect()
    want = plain_sanitised([t or "" for _, t, _ in rows])
    assert Counter((r["doc_id"], r["spans"]) for r in got) == Counter((i, want[t or ""]) for i, t, _ in rows)
    hashes = Counter((i, hashlib.sha256(plain_spans(t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == hashes
    first = len(texts) - len(PLANTED)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert "remove:8:17" in spans[first] and "remove:5:11" in spans[first + 4]
    assert all(spans[k] == "email:24:34" for k in range(first + 8, first + 17))  # copies prove nothing
    text = found.filter(F.col("doc_id") == first).join(docs.select("doc_id", "text"), "doc_id").select(sanitise.sanitised(F.col("text"), F.col("base"), F.col("added")).alias("t")).first()["t"]
    assert "Quorvex" not in text and "[EMAIL]" in text and "[TERM]" in text


@pytest.mark.parametrize("size", ["0.01"])
def test_personal_data_of_a_whole_table(spark, size):
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = plain_sanitised([r["text"] or "" for r in rows])
    got = queries.op8_personal_data(spark, f"/root/testdata/sf{size}").collect()
    assert {(r["doc_id"], r["spans"]) for r in got} == {(r["doc_id"], want[r["text"] or ""]) for r in rows}
    added = sum(r["spans"].count("remove") + r["spans"].count("generalise") for r in got)
    assert added > 0
    plain = Counter((r["doc_id"], plain_spans(r["text"] or "")) for r in rows)
    base = Counter((r["doc_id"], ",".join(x for x in r["spans"].split(",") if x and x.split(":")[0] in sanitise.KINDS)) for r in got)
    assert base == plain


def test_a_text_with_very_many_matches(spark):
    n = 100_000
    mails = " ".join(f"é{k}@x.org" for k in range(n))
    began = time.time()
    df = spark.createDataFrame([(1, mails)], "doc_id long, text string")
    found = sanitise.personal_data(df)
    row = sanitise.digests(found).first()
    assert row["n_email"] == n and row["base_sha256"] == hashlib.sha256(plain_spans(mails).encode()).hexdigest()
    clean = df.join(found.drop("text_key"), "doc_id").select(sanitise.sanitised(F.col("text"), F.col("base"), F.col("added")).alias("t")).first()["t"]
    assert clean == " ".join(["é[EMAIL]"] * n)
    assert time.time() - began < 60


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_terms_that_disclose_at_two_sizes(spark, size):
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet").select("doc_id", "text")
    planted = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(PLANTED)], "doc_id long, text string")
    got = by_id(sanitise.digests(sanitise.personal_data(docs.unionByName(planted))).filter("spans LIKE '%remove%' OR spans LIKE '%generalise%'"))
    assert all("remove:8:17" in got[-1 - k]["spans"] for k in range(3)) and all("remove:5:11" in got[-5 - k]["spans"] for k in range(4))
    assert all(-9 - k not in got for k in range(9)) and -4 not in got
    assert sum(k >= 0 for k in got) > 0  # the table's own texts have some too
    assert all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got.values())


def test_mix(odd, spark, sf):
    got = mixing.mixed(odd)
    assert got.count() == len(ROWS) and got.filter("taken > 2 * size OR (size = 0 AND taken > 0)").count() == 0
    again = mixing.mixed(odd.repartition(5))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"), F.max("source_size").alias("own"))
    for r in made.collect():
        assert abs(r["taken"] - r["target"]) <= r["largest"] and r["target"] <= 2 * r["own"] + 1e-6


def test_mix_samples_in_proportion_to_size(spark):
    rows = [(k, " ".join(["w"] * (1, 4, 16)[k % 3]), "a") for k in range(9_000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=0.25).collect()
    share = {n: np.mean([r["copies"] for r in got if r["size"] == n]) for n in (1, 4, 16)}
    assert abs(share[4] / share[1] - 4) < 1 and abs(share[16] / share[4] - 4) < 0.6
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 16
    # whole copies first, then certain documents, then the sample
    got = mixing.mixed(spark.createDataFrame([*rows, (10**6, "w " * 5_000, "a")], "doc_id long, text string, source string"), weights=(1,), share=1.25).collect()
    assert min(r["copies"] for r in got) == 1 and {r["copies"] for r in got if r["size"] > 16} == {2}
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 16


def test_contamination(odd, spark):
    items = spark.createDataFrame([(1, "TWO three, four"), (2, "w1 w2 w3 w4"), (2, "w1 w2 w3 w4"), (None, "one"), (3, None), (4, "...")], "item_id long, text string")
    for size in (1 << 20, 10):
        got = by_id(wu_manber.contamination(odd, items, width=3, share=20, block_bytes=size))
        assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (4, 1, True)  # "one" has no id and hits
        assert (got[6]["n_hit"], got[6]["contaminated"]) == (4, False)
        assert got[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and got[4]["n_words"] == 0 and not got[3]["contaminated"]


def test_contamination_without_ids_as_sql_has_it(spark, sf, tmp_path):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    words = docs.filter("size(split(text, ' ')) > 40").orderBy("doc_id").first()["text"].split(" ")
    more = spark.createDataFrame([(None, " ".join(words[5:30])), (10**9, None), (None, "...")], "item_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    items.unionByName(more).coalesce(1).write.parquet(f"{tmp_path}/b")
    for name, folder in (("documents", "d"), ("benchmark", "b")):
        (tmp_path / f"{name}.parquet").write_bytes(next((tmp_path / folder).glob("part-*.parquet")).read_bytes())
    same_rows(queries.op10_decontamination(spark, str(tmp_path)), sql.CONTAMINATION, str(tmp_path))


def test_several_blocks_of_a_benchmark_take_one_pass(spark, tmp_path):
    items = spark.createDataFrame([(k, f"i{k} j{k} k{k} l{k}") for k in range(12)], "item_id long, text string")
    rows = [(k, f"x i{k} j{k} k{k} l{k} y i{k + 1} j{k + 1} k{k + 1} l{k + 1}", str(k)) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, n string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    many = wu_manber.contamination(read, items, width=3, block_bytes=10)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    want = {r["doc_id"]: r for r in wu_manber.contamination(read, items, width=3).collect()}
    got = {r["doc_id"]: r for r in many.collect()}
    assert got == want and got[3]["n_hit"] == 8 and got[11]["n_items"] == 1


def test_fits_gather_a_bounded_number_of_rows(spark):
    rows = spark.range(60_000).selectExpr("cast(1 as bigint) AS doc_id", "concat('word', id % 7, ' again') AS text")
    docs = rows.unionByName(spark.createDataFrame([(2, "bad words"), (3, None), (4, "good words")], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 5)], "doc_id long, quality int, toxic int")
    for module, column in ((quality_fm, "quality"), (toxicity, "toxic")):
        chosen = features.texts_of(docs, features.labelled_sample(labels, column, None, 10, by_class=False))
        assert chosen.count() == 4
        got, marks = module.training_rows(chosen)
        assert len(got) == len(marks) == 4
    slots = spark.createDataFrame([(k, 0, bytearray(40)) for k in range(9)], "doc_id long, label int, slots binary")
    assert features.bounded(slots, "slots", 100).count() == 2 and features.bounded(slots, "slots", 1000).count() == 9


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_fm.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got) / len(got)
    assert len(got) > 50 and right > 0.93
    ids = {r["doc_id"] for r in got}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)


def test_classifiers_take_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 0, 1), (7, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    q, t = quality_fm.quality_scores(odd, labels).collect(), toxicity.toxicity(odd, labels).collect()
    assert len(q) == len(t) == len(ROWS) and all(0 <= r["score"] <= 1 for r in q) and all(r["severity"] >= 0 for r in t)
    # null and empty texts have one score; repeated rows too; without labelled rows all scores are 0.5 and nothing is toxic
    of = lambda rows, c: [{r[c] for r in rows if r["doc_id"] in ids} for ids in ((3, 4), (1, 2))]
    assert all(len(x) == 1 for x in of(q, "score") + of(t, "severity") + of(t, "toxic"))
    bare = labels.filter("doc_id > 100")
    assert {round(r["score"], 1) for r in quality_fm.quality_scores(odd, bare).collect()} == {0.5}
    assert {r["toxic"] for r in toxicity.toxicity(odd, bare).collect()} == {False}


def test_scores_equal_a_plain_sum(spark, sf, documents, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(model.thresholds) > 1 and (np.diff(model.thresholds) > 0).all()

    def plain(text):
        z = sum(model.weights[s] for w in set((text or "").split()) for s in toxicity.slots_of(w))
        over = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        each = [a - b for a, b in zip([1, *over], [*over, 0])]
        return round(sum(over), 6), each.index(max(each)), over[0] >= 0.5

    rows = list(zip(documents.doc_id, documents.text)) + [r[:2] for r in ROWS]
    got = [*toxicity.graded_texts(docs, model).collect(), *toxicity.graded_texts(odd, model).collect()]
    assert Counter((r["doc_id"], round(r["severity"], 6), r["grade"], r["toxic"]) for r in got) == Counter((i, *plain(t)) for i, t in rows)
    low = plain("")
    assert low[1:] == (0, False) and {round(r["severity"], 6) for r in got if r["doc_id"] in (3, 4, 5)} >= {low[0]}


def test_toxicity_on_unseen_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd_ones = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = toxicity.toxicity(docs.filter(odd_ones | F.col("doc_id").isNotNull()), labels.filter(~odd_ones)).join(labels.filter(odd_ones).withColumnRenamed("toxic", "truth"), "doc_id").collect()
    caught = [r["toxic"] for r in got if r["truth"]]
    clean = [r["toxic"] for r in got if not r["truth"]]
    assert sum(caught) / len(caught) > 0.85 and sum(clean) / len(clean) < 0.01


def test_stages_tell_rows_of_one_id_apart(spark, sf, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    items = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(20)))], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = items.first()["text"]
    near = [" ".join(f"n{k}" for k in range(200)), " ".join(f"n{k}" for k in range(201))]
    rows = [(None, bad), (None, "clean without an id"), (None, None), (5, bad), (5, "clean with an id"), (5, None), (6, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in pipeline.decontaminate(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([r for r in rows if r[1] != bad], key=str)
    several = wu_manber.uncontaminated(docs, items.union(items), block_bytes=10)
    assert sorted(map(tuple, several.collect()), key=str) == sorted(left, key=str)
    # documents without labels but for two
    words = [(k, f"vile zzbad filth {k}") for k in range(20, 60)] + [(k, f"kind zzgood words {k}") for k in range(60, 100)]
    spark.createDataFrame([(k, int(k < 60), int(k < 60)) for k, _ in words], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = words + [(None, "vile zzbad filth"), (None, "kind zzgood words"), (7, "vile zzbad filth"), (7, "kind zzgood words")]
    left = pipeline.toxicity(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).filter("doc_id IS NULL OR doc_id = 7").collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(None, "kind zzgood words"), (7, "kind zzgood words")]))
    rows = [(3, near[0]), (5, near[1]), (5, "a text of its own"), (8, "a text of its own"), (None, near[1])]
    left = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [rows[0], rows[2], rows[4]]))
    # one row of a class stays, though rows repeat its smallest id or are the same
    rows = [(3, near[0]), (3, near[1]), (3, near[0]), (9, near[1]), (3, "a text of its own"), (4, "b"), (4, "b"), (6, ""), (6, ""), (None, "b"), (None, "b")]
    left = [tuple(r) for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()]
    assert Counter(left)[3, near[0]] + Counter(left)[3, near[1]] == 1
    assert Counter(r for r in left if r[1] not in near) == Counter([(3, "a text of its own"), (4, "b"), (6, ""), (6, ""), (None, "b"), (None, "b")])


def test_the_mix_has_all_copies_of_repeated_rows(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a b c", "s", "x"), (1, "a b c", "s", "x"), (None, "a b c", "s", "y"), (None, "a b c", "s", "y"), (2, "d e f g", "s", "z"), (3, None, "s", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    want = {(r["doc_id"], r["n"]) for r in mixing.mixed(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    got = pipeline.mix(spark, docs, sf)
    assert got.columns == docs.columns
    assert {(r["doc_id"], r["n"]) for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want
    assert sum(n for _, n in want) > len(rows)


def test_pipeline(spark, sf, documents, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == columns, name
        ids, old = {r[0] for r in kept.select("doc_id").collect()}, {r[0] for r in before.select("doc_id").collect()}
        assert ids <= old
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            assert ids == {c for _, _, c in brute_components(rows, 5, 80)}
    last = pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    for name, stage in pipeline.STAGES:
        stage(spark, odd, sf).count()
        stage(spark, odd.filter("doc_id > 1000"), sf).count()
