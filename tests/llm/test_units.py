"""Operators of the text-preparation subpackage on small inputs, against plain versions."""

import base64
import gzip
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from docweave.llm import cuckoo, quality_fm, set_sketch, token_counts, token_ids, toxicity, warc, wu_manber  # noqa: E402

BITS = ["a", "the", " ", "  ", "\n", "\n\n", "'re", "'s", "'", "!", "23", "é", " ", " ", "日本", "<|endoftext|>", "<|endo", "\x1d", "😀", "don't", " '", "\t", "...", "word "]


def texts(n, size, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, size))) for _ in range(n)] + ["", " ", "\n", "x" * 500, "ab" * 3000]


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"), keep=500)


def test_every_prefix_count_is_exact(counter):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts(300, 12):
        d = counter.deltas(t)
        assert len(d) == len(t)
        for p in range(0, len(t) + 1, 1 if len(t) < 100 else 997):
            assert token_counts.count_at(d, p) == len(lib.encode(t[:p], add_special_tokens=False).ids), (t[:p],)


def test_repeated_special_strings(counter):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("<|endoftext|>" * 40, "a b<|endoftext|>c  d\n\n<|endoftext|><|endo <|endoftext|>\n" * 6):
        d = counter.deltas(t)
        assert [token_counts.count_at(d, p) for p in range(len(t) + 1)] == [len(lib.encode(t[:p], add_special_tokens=False).ids) for p in range(len(t) + 1)]
    began = time.time()
    assert token_counts.count_at(counter.deltas("x<|endoftext|>" * 20_000), 10**9) == 40_000
    assert time.time() - began < 30


def test_cuts_are_the_longest_prefixes(counter):
    all_texts = texts(200, 60, 3)
    for limit in (1, 4, 11):
        n, cut = token_counts.counted(counter, pa.array(all_texts, pa.large_string()), limit)
        for t, a, b in zip(all_texts, n, cut):
            d = counter.deltas(t)
            assert a == token_counts.count_at(d, len(t)) and b == token_counts.longest_within(d, limit)


def test_ids_equal_the_library():
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = token_ids.WordIds(public_tokenizers.path("word_bpe_49k.json"), keep=50)
    all_texts = [t.replace("<|endo", "<|endoftext|>") for t in texts(300, 30, 2)] + ["ΑΣ ΣΑΣ İstanbul é ÀÉ THE,%%%", None]
    for _ in range(2):
        ids, counts = words.ids(pa.array([t or "" for t in all_texts], pa.large_string()))
        at = 0
        for t, n in zip(all_texts, counts):
            assert ids[at : at + n].tolist() == lib.encode(t or "", add_special_tokens=False).ids
            at += n


@pytest.mark.parametrize("symbols,limit", [(1, 20), (2, 20), (300, 9), (5000, 16)])
def test_code_round_trip_and_length_limit(symbols, limit):
    rng = np.random.default_rng(symbols)
    counts = (rng.pareto(0.6, symbols) * 10 + 1).astype(np.int64)
    bits = token_ids.code_lengths(counts, limit)
    assert bits.max() <= limit and (2.0 ** -bits.astype(float)).sum() <= 1 + 1e-12
    code = token_ids.Code(np.arange(symbols) * 7, bits)
    ids = rng.choice(symbols, 20_000, p=counts / counts.sum()) * 7
    stream, checkpoints = code.encode(ids)
    assert (code.decode(stream, checkpoints, len(ids)) == ids).all()


def test_code_is_optimal_without_a_binding_limit():
    import heapq

    counts = np.array([45, 13, 12, 16, 9, 5, 1, 1])
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (token_ids.code_lengths(counts, 20) * counts).sum() == cost
    with pytest.raises(ValueError):
        token_ids.code_lengths(np.ones(9, np.int64), 3)


def test_cuckoo_index():
    index = cuckoo.CuckooIndex(2)
    keys = [os.urandom(40) for _ in range(3000)]
    for k, key in enumerate(keys):
        index.put(key, k)
    assert index.resizes and len(index) == len(keys)
    assert [index.get(k) for k in keys] == list(range(len(keys)))
    assert cuckoo.retract(index, keys[:1000]) == 1000 and cuckoo.retract(index, keys[:1000]) == 0
    assert all(index.get(k) is None for k in keys[:1000]) and all(index.get(k) is not None for k in keys[1000:])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:3600], rng.integers(0, 1 << 63, 400).astype(np.uint64)]))
    sa, sb, both = set_sketch.sketch([a, b, np.union1d(a, b)])
    assert (set_sketch.merge(sa, sb) == both).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    found = set_sketch.estimate((sa > sb).sum(), (sa < sb).sum(), len(a), len(b))
    assert abs(found - true) < 0.12


def test_estimate_is_the_likeliest_similarity():
    rng = np.random.default_rng(1)
    m = set_sketch.REGISTERS
    left, right = rng.integers(50, 1000, 300).astype(float), rng.integers(50, 1000, 300).astype(float)
    true = rng.uniform(0.5, 1, 300) * np.minimum(left, right) / np.maximum(left, right)
    p = np.stack(set_sketch.chances(true, left, right), 1)
    larger, smaller, _ = np.array([rng.multinomial(m, x / x.sum()) for x in p]).T
    got = set_sketch.estimate(larger, smaller, left, right, steps=30)
    grid = np.linspace(0, 1, 2001)[:, None] * np.minimum(left, right) / np.maximum(left, right)
    best = set_sketch.log_likelihood(grid, larger, smaller, left, right).max(0)
    assert (set_sketch.log_likelihood(got, larger, smaller, left, right) >= best - 0.05).all()
    few = set_sketch.estimate(larger, smaller, left, right)
    near = true > 0.7
    assert (set_sketch.log_likelihood(few, larger, smaller, left, right) >= best - 0.1)[near].all()


@pytest.mark.parametrize("share,ratio", [(0.8, 1), (0.8, 0.9), (0.8, 0.805), (0.85, 1), (0.85, 0.86), (0.5, 0.7)])
def test_pairs_at_the_threshold_are_candidates(share, ratio):
    """The exact chance, over all register counts, that a pair at the threshold is not taken."""
    m = set_sketch.REGISTERS
    left, right = 1000.0, 1000.0 * ratio
    p = np.array([float(x) for x in set_sketch.chances(np.float64(share), left, right)])
    larger, smaller = (x.ravel().astype(float) for x in np.meshgrid(np.arange(m + 1), np.arange(m + 1)))
    some = larger + smaller <= m
    larger, smaller = larger[some], smaller[some]
    equal = m - larger - smaller
    fact = np.concatenate([[0], np.cumsum(np.log(np.arange(1, m + 1)))])
    chance = np.exp(fact[m] - fact[larger.astype(int)] - fact[smaller.astype(int)] - fact[equal.astype(int)] + larger * np.log(p[0]) + smaller * np.log(p[1]) + equal * np.log(p[2]))
    ok, _ = set_sketch.may_be_linked(share, larger, smaller, np.full(len(larger), left), np.full(len(larger), right))
    assert abs(chance.sum() - 1) < 1e-9
    assert chance[~(ok & (equal >= set_sketch.least_equal(share)))].sum() < 1.1e-6
    # a pair far below is mostly not taken
    q = np.array([float(x) for x in set_sketch.chances(np.float64(share * 0.5), left, right)])
    low = np.exp(fact[m] - fact[larger.astype(int)] - fact[smaller.astype(int)] - fact[equal.astype(int)] + larger * np.log(q[0]) + smaller * np.log(q[1]) + equal * np.log(q[2]))
    assert low[ok & (equal >= set_sketch.least_equal(share))].sum() < 0.5


def test_banding_keeps_its_promise():
    for share in (0.15, 0.3, 0.5, 0.7, 0.78, 0.8, 0.9):
        bands, rows = set_sketch.banding(share)
        assert bands * rows <= set_sketch.REGISTERS and (1 - set_sketch.equal_chance(share) ** rows) ** bands < 1e-6
    with pytest.raises(ValueError):
        set_sketch.banding(0.05)


def test_shingles():
    sets = set_sketch.shingle_sets(pa.array(["a b c d", "A  B\tc\nd", "a b", "", " \n", "a b c a b c", "a b c d"], pa.large_string()), 3)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 3, 1]
    assert (sets[0] == sets[1]).all()


def test_caches_are_bounded_in_bytes():

    rng = random.Random(1)
    texts = pa.array([" ".join(base64.b64encode(rng.randbytes(3_000)).decode() for _ in range(40)) for _ in range(3)], pa.large_string())
    words = token_ids.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, counts = words.ids(texts)
    assert ids.tolist() == [i for t in texts.to_pylist() for i in lib.encode(t, add_special_tokens=False).ids] and len(counts) == 3
    assert all(len(k) < 100 for c in (words.words, words.runs) for k in (*c.young, *c.old))
    table = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n, _ = token_counts.counted(table, texts, 1024)
    assert n.tolist() == [len(byte.encode(t, add_special_tokens=False).ids) for t in texts.to_pylist()]
    assert not table.long and all(len(k) < 100 for c in (table.words, table.old_words, table.pieces) for k in c)


def test_wu_manber_against_a_plain_search():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "bb", "abc", "é", "the"])
    items = [(str(k), " ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 6])))) for k in range(25)] + [("n", None)]
    windows = wu_manber.Windows(items, 4)
    for _ in range(150):
        text = " ".join(word() for _ in range(rng.randint(0, 40))).upper().replace(" ", rng.choice([" ", ", ", "\n"]))
        w = wu_manber.words(text)
        hit, found = set(), set()
        for item, body in items:
            iw = wu_manber.words(body or "")
            for p in [iw[k : k + 4] for k in range(max(1, len(iw) - 3))] if iw else []:
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit |= set(range(k, k + len(p)))
                        found.add(item)
        n, spans, got = windows.hits(text)
        assert (n, got) == (len(w), found)
        assert {k for a, b in wu_manber.union_spans(spans) for k in range(a, b)} == hit


def test_warc_normaliser():
    payloads = [b"", b"x" * 10, os.urandom(100_000), b"\r\n\r\nWARC/1.1\r\n"]
    records = [warc.record(k, "http://x/ y" if k else None, p, "d" * 64, None) for k, p in enumerate(payloads)] + [warc.record(9, "u", b"z" * 200, "e" * 64, 2)]
    for whole in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records)) + warc.EMPTY_MEMBER):
        data, index = warc.normalise(whole)
        assert [x[0] for x in index] == [0, 1, 2, 3, 9] and [x[3] for x in index] == ["response"] * 4 + ["revisit"]
        blocks = []
        for _, at, n, _ in index:
            head, block, raw = next(warc.records_of([zlib.decompress(data[at : at + n], 31)]))
            blocks.append(block)
        assert blocks == [*payloads, b""] and head["WARC-Refers-To"].endswith(":2>")
    with pytest.raises(ValueError):
        warc.normalise(gzip.compress(b"".join(records)[:-60]))
    assert warc.normalise(gzip.compress(b""))[1] == []


def test_union_of_spans_and_counts():
    assert wu_manber.union_spans([(5, 9), (0, 2), (2, 4), (6, 7)]) == [(0, 4), (5, 9)]
    assert Counter(wu_manber.words("A-b_é1 ")) == Counter([b"a", b"b", "é1 ".encode()])


def test_ordinal_fit_comes_to_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (400, 5))
    z = x @ np.array([2.0, 1.0, 0.0, -1.5, 0.5])
    grades = (z[:, None] + rng.logistic(0, 1, 400)[:, None] > np.array([0.5, 1.5, 3.0])).sum(1)
    weights, penalty = np.where(grades > 0, 0.5, 1.5), 1e-3

    def cost(w, t):
        return (weights * toxicity.loss_slopes(x @ w, grades, t)[0]).mean() + penalty * np.abs(w).sum()

    w, t = np.zeros(5), np.array([0.0, 1.0, 2.0])
    for _ in range(20_000):  # plain proximal steps over all rows
        _, by_z, by_t = toxicity.loss_slopes(x @ w, grades, t)
        moved = w - 0.2 * x.T @ (by_z * weights) / 400
        w, t = np.sign(moved) * np.maximum(0, np.abs(moved) - 0.2 * penalty), t - 0.2 * (by_t * weights[:, None]).mean(0)
    model = toxicity.fit([np.flatnonzero(r) for r in x], grades, weights, epochs=150, penalty=penalty)
    assert (np.diff(model.thresholds) > 0).all() and not model.weights[5:].any()
    assert cost(w, t) <= cost(model.weights[:5], model.thresholds) < cost(w, t) * 1.005
    # all thresholds share the weights: grades above the first move them
    assert abs(model.weights[:5] - w).max() < 0.3 and abs(model.thresholds - t).max() < 0.3


def test_slopes_of_the_ordinal_loss():
    z, t, e = np.array([0.3, -1.0, 2.0, 0.1]), np.array([-0.5, 0.4, 1.7]), 1e-6
    grades = np.array([0, 1, 2, 3])
    loss, by_z, by_t = toxicity.loss_slopes(z, grades, t)
    assert np.allclose((toxicity.loss_slopes(z + e, grades, t)[0] - loss) / e, by_z, atol=1e-4)
    for k in range(3):
        assert np.allclose((toxicity.loss_slopes(z, grades, t + e * (np.arange(3) == k))[0] - loss) / e, by_t[:, k], atol=1e-4)


def test_grades_of_labels_by_telling_words():
    slots = lambda text: np.array([s for w in text.split() for s in toxicity.slots_of(w, toxicity.WHOLE)], "<i4")
    rows = [slots(t) for t in ["bad"] * 4 + ["bad vile awful"] * 4 + ["bad vile awful nasty gross rotten"] * 4 + ["fine words here"] * 12 + [""]]
    toxic = np.array([True] * 12 + [False] * 13)
    assert toxicity.graded(rows, toxic).tolist() == [1] * 4 + [2] * 4 + [3] * 4 + [0] * 13


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(4)
    machine = quality_fm.Machine(0.3, rng.normal(0, 1, quality_fm.SIZE), rng.normal(0, 0.3, (quality_fm.SIZE, quality_fm.RANK)))
    all_texts = pa.array(["", "one", "One one two, three\nfour. one", "a b c " * 30, *texts(20, 40)], pa.large_string())
    got = machine.scores(all_texts)
    for z, (slots, x) in zip(got, quality_fm.sparse_rows(all_texts)):
        want = machine.w0 + sum(machine.w[s] * v for s, v in zip(slots, x))
        want += sum(machine.v[slots[i]] @ machine.v[slots[j]] * x[i] * x[j] for i in range(len(slots)) for j in range(i))
        assert abs(z - want) < 1e-6 * max(1, abs(want))
