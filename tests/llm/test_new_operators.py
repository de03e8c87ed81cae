"""Hard negatives, packing and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from docweave.llm import hard_negatives, packing, periodic_runs, queries  # noqa: E402

WORD = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{k}" for k in range(30_000))
ROWS = [(1, "a b c d e f g h " * 9 + "tail", "x"), (1, "a b c d e f g h " * 9 + "tail", "x"), (2, "", "x"), (3, None, "x"), (None, "no id " * 40, "x"), (4, " \n\t ", "x"), (5, LONG, "x"), (6, "x" * 50_000, "x"), (7, "one", "x"), (8, "s t " * 12 + "u " + "s t " * 11, "x")]
SCHEMA = "doc_id long, text string, start string, length string, row string, group string, runs string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "?", "?", "?", "?") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# --- periodic runs --------------------------------------------------------------------------------


def brute_runs(x, least=24, exponent=3):
    n, out = len(x), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            length = i + q - s
            smaller = (d for d in range(1, q) if all(x[k] == x[k + d] for k in range(s, s + length - d)))
            if i > s and length >= max(least, exponent * q) and next(smaller, None) is None:
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda f: (f[0], f[2]))


def words_of(text):
    return (text or "").encode().split() if text else []


def planted(doc, x):
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not x:
        return x
    g, n = h // 10, len(x)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]


def brute_digest(doc, text):
    x = planted(doc, words_of(text))
    found = brute_runs(x)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for k, w in enumerate(x) if k not in gone)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def as_digests(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.collect()), key=str)


def test_runs_equal_a_plain_search():
    rng = random.Random(5)
    for _ in range(3000):
        x = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(40))]
        if x and rng.random() < 0.5:
            a, p = rng.randrange(len(x)), rng.randint(1, 5)
            x = [x[i] if i < a else x[min(len(x) - 1, a + (i - a) % p)] for i in range(len(x))]
        for least, exponent in ((24, 3), (6, 3), (2, 2)):
            assert periodic_runs.runs(x, least, exponent) == brute_runs(x, least, exponent), x


class Counted(int):
    made = 0
    __hash__ = int.__hash__

    def __eq__(self, other):
        Counted.made += 1
        return int(self) == int(other)


@pytest.mark.parametrize("sign", [1, -1])
def test_scan_compares_a_bounded_number_of_words(sign):
    fib, last = [0, 1], [0]
    while len(fib) < 5000:
        fib, last = fib + last, fib
    shapes = [fib, [0] * 5000, [bin(k).count("1") % 2 for k in range(5000)], [(k & -k).bit_length() for k in range(1, 5000)], [random.Random(k // 9).randrange(2) for k in range(5000)], ([0] * 50 + [1]) * 100]
    for x in shapes:
        Counted.made = 0
        periodic_runs.next_smaller_suffixes([Counted(sign * v) for v in x])
        assert Counted.made <= 2.1 * len(x)


def test_next_smaller_suffixes():
    rng = random.Random(3)
    for _ in range(500):
        x = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        up, match = periodic_runs.next_smaller_suffixes(x)
        for i in range(len(x)):
            j = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
            assert up[i] == j
            assert match[i] == next((k for k in range(len(x) - j) if x[i + k] != x[j + k]), len(x) - j)


def test_sieve_changes_no_result():
    rng = np.random.default_rng(2)
    for t in range(300):
        rows = np.sort(rng.integers(0, 4, 400))
        codes = rng.integers(0, [2, 5, 40][t % 3], 400)
        for _ in range(4):
            a, p, n = rng.integers(0, 380), rng.integers(1, 9), rng.integers(10, 60)
            for i in range(a + p, min(400, a + n)):
                codes[i] = codes[i - p]
        want = {(int(np.flatnonzero(rows == r)[0]) + s, n, q) for r in set(rows.tolist()) for s, n, q in brute_runs(codes[rows == r].tolist())}
        first, last = periodic_runs.sieve(codes, rows)
        got = {(int(a) + s, n, q) for a, b in zip(first, last) for s, n, q in periodic_runs.runs(codes[a:b].tolist())}
        assert got == want


def test_periodic_runs_of_the_whole_table(spark, sf, documents):
    got = as_digests(queries.op13_periodic_runs(spark, sf))
    assert got == sorted((brute_digest(d, t) for d, t in documents), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_periodic_runs_of_odd_rows(odd):
    got = as_digests(periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(odd))))
    assert [r for r in got if r[0] != 5] == sorted((brute_digest(r[0], r[1]) for r in ROWS if r[0] != 5), key=str)
    plain = {(r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic_runs.periodic_runs(odd).collect()}
    assert (1, 73, ((0, 72, 8),), "a b c d e f g h tail") in plain
    assert {(2, 0, (), ""), (3, 0, (), ""), (4, 0, (), ""), (None, 80, ((0, 80, 2),), "no id"), (7, 1, (), "one"), (5, 30_000, (), LONG)} <= plain
    assert (8, 47, ((0, 24, 2),), "s t u " + ("s t " * 11).strip()) in plain
    assert odd.count() == len(got) and periodic_runs.periodic_runs(odd.limit(0)).count() == 0


def test_exponent_two_and_long_periods(spark):
    x = [f"v{k}" for k in range(3000)]
    df = spark.createDataFrame([(1, " ".join(x * 2 + x[:5])), (2, " ".join(["q"] * 20_000))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(df, min_exponent=2).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 6005, 3000)] and got[1]["collapsed"] == " ".join(x)
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 20_000, 1)] and got[2]["collapsed"] == "q"


# --- packing --------------------------------------------------------------------------------------


def held_together(rows, texts, length=2048, end=1):
    """Checks every piece against the library's ids and the layout of sequences; the padding of all."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append([*lib.encode(text or "", add_special_tokens=False).ids, end])
    assert set(by_doc) == set(want)
    for doc, docs in want.items():
        pieces = sorted((r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc])
        if len(docs) == 1 or all(d == docs[0] for d in docs):
            ids, covered = docs[0], np.zeros(len(docs[0]), int)
            for total, start, n, crc in pieces:
                assert total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
                covered[start : start + n] += 1
            assert (covered == len(docs)).all()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_packing_of_the_whole_table(spark, sf, documents):
    rows = queries.op12_packing(spark, sf).collect()
    assert held_together(rows, documents) == 0
    full = sum(r["length"] for r in rows) / 2048
    assert len({r["sequence_id"] for r in rows}) <= full + 11


def test_packing_of_odd_rows(odd):
    rows = packing.packed(odd, WORD, 1, length=64, group_tokens=300).collect()
    assert held_together(rows, [r[:2] for r in ROWS], 64) == 0
    assert packing.packed(odd.limit(0), WORD, 1).count() == 0


def test_first_fit_decreasing_is_as_a_plain_search_has_it():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 50) for _ in range(rng.randrange(60))]
        bins = []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            home = next((b for b in bins if sum(sizes[i] for i in b) + sizes[k] <= 50), None)
            if home is None:
                bins.append(home := [])
            home.append(k)
        assert packing.first_fit_decreasing(sizes, 50) == bins
        parts = packing.packed_group(sizes, 50)
        whole = [sum(p[2] for p in s) for s in parts]
        assert sum(whole) == sum(sizes) and all(n == 50 or n & (n - 1) == 0 for n in whole)
        assert sum(n < 50 for n in whole) <= 6


# --- hard negatives -------------------------------------------------------------------------------


def brute_negatives(rows, anchor, label, scale=256, positives=5, negatives=10):
    """rows: vec_id, embedding, label."""
    ok = [(v, [int(np.floor(scale * float(x))) for x in e], label(v, y)) for v, e, y in rows if v is not None and y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, (a, x, la) in enumerate(ok):
        if not anchor(a):
            continue
        scored = [(-max(-(2**63) + 1, min(2**63 - 1, sum(p * q for p, q in zip(x, y)))), b, k, lb) for k, (b, y, lb) in enumerate(ok) if len(x) == len(y)]
        scored.sort()
        for s, p, _, _ in [t for t in scored if t[3] == la and t[2] != i][:positives]:
            fit = [(n, b) for n, b, _, lb in scored if lb != la and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a, p, r + 1, b, -s, -n) for r, (n, b) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def test_hard_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), rng.integers(-3, 4, 6).astype(float).tolist(), int(rng.integers(0, 4))) for k in range(150)]
    rows += rows[:7]  # repeated rows
    rows += [(k, [1.0] * 6, k % 3) for k in range(200, 260)]  # ties
    rows += [(300, None, 1), (301, [1.0, None, 1.0], 1), (302, [1.0, float("nan"), 1.0], 1), (303, [float("inf")] * 6, 1), (304, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(400, [], 1), (401, [], 2), (402, [2.0, 1.0], 1), (403, [1.0, 1.0], 1), (404, [1.0, 0.5], 2), (410, [1e6] * 6, 1), (411, [9e5] * 6, 1), (412, [5e5] * 6, 2)]
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "vec_id long, embedding array<double>, label int, row string, score string").repartition(4)
    anchor, label = F.col("vec_id") % 10 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    want = brute_negatives(rows, lambda v: v % 10 == 0, lambda v, y: (y + 1) % 4 if v % 7 == 0 else y)
    sizes = hard_negatives.ANCHOR_ROWS, hard_negatives.CANDIDATE_ROWS
    hard_negatives.ANCHOR_ROWS, hard_negatives.CANDIDATE_ROWS = 3, 8
    try:
        assert mined(hard_negatives.hard_negatives(df, anchor, label)) == want
        assert mined(hard_negatives.hard_negatives(df, anchor, label, anchor_bytes=9000)) == want  # several passes
    finally:
        hard_negatives.ANCHOR_ROWS, hard_negatives.CANDIDATE_ROWS = sizes
    assert mined(hard_negatives.hard_negatives(df.limit(0), anchor)) == []


def test_scores_beyond_float_precision_are_exact():
    big = hard_negatives.Block(np.arange(2), np.arange(2), np.zeros(2), np.array([[2.0**40, 1.0], [2.0**26, 3.0]]))
    assert hard_negatives.scores(big, big).tolist() == [[(1 << 63) - 1, (1 << 63) - 1], [(1 << 63) - 1, (1 << 52) + 9]]
