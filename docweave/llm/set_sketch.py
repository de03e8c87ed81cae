"""Near-duplicate classes with SetSketch registers.

1. Every text becomes the set of its word shingles (64-bit hashes) and a sketch of REGISTERS values.
   Register i is floor(1 - log_b(min over the set of an exponential variate)), cut to a fixed range: an
   exponentially spaced, truncated minimum, so sketches of parts of a set merge by taking maxima.
2. Texts with equal sets form a class; only one of each class goes on.
3. Each band of registers gives a bucket; buckets of two are pairs. In larger ones the similarity is estimated
   jointly: the numbers of registers that are larger, smaller and equal, with both set sizes, have a
   likelihood in the similarity; pairs are candidates unless the threshold is far less likely than the
   likeliest similarity. Each block of a bucket gives a spanning forest, never all of its pairs.
4. Connected classes (a superset of the true links) are verified on full sets, again in bounded blocks:
   likeliest pairs first, pairs already connected need no test, all others that may be links are tested.

Groups of more members than a block are first compared with a few of their members (star()). Members that are
linked to the best of these are connected, so only the others still have to be compared, with all: a group
of n near copies of one text costs n comparisons, not n^2/2. Large buckets that have others (pages of one template,
say) are dealt anew by rare shingles: of two sets of similarity s either one's rarest n - ceil(s n) + 1 shingles meet
those of the other, whatever the order, so lists of members with a rare shingle in common hold every pair that may be
linked, and members that only share what their template has in common meet in none. Each block of a group is a
task of its own.

A pair at the threshold misses all bands with a probability under 1e-6 (banding() takes the longest bands
for which this holds), has too few equal registers with one under 1e-6 (least_equal()), and loses by
likelihood with a far smaller one.

Defined results: null and empty texts (and those without words) have empty sets and are linked with
nothing; rows with a null doc_id stand for themselves; rows that repeat a doc_id are rows of their own
(texts of one id are linked apart; those in one component with the smallest id are all kept).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import arrow_map, filled_text, slices, small, stored

REGISTERS = 128
BASE, RATE, TOP = 1.02, 20.0, 4000
#: Members of a block that are compared with each other at once; shingles of a block that are held.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1_500_000

_seeds = np.random.default_rng(20240517)
_FLIP = _seeds.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)
_ODD = _seeds.integers(0, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles. A-Z become lower case; words are runs
    without ASCII white space; a text of fewer words than `width` has its whole sequence as one shingle."""
    words = pc.ascii_split_whitespace(text)
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.translate(LOWER)) for w in names), np.uint64, len(names))
    empty = np.array([not w for w in names], bool)
    which = coded.indices.to_numpy(zero_copy_only=False)
    h = hashes[which] if len(which) else np.zeros(0, np.uint64)
    blank = empty[which] if len(which) else np.zeros(0, bool)
    ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
    out, a = [], 0
    for b in ends.tolist():
        x = h[a:b]
        if blank[a:b].any():
            x = x[~blank[a:b]]
        a = b
        if not len(x):
            out.append(x)
            continue
        n = len(x)
        k = min(width, n)
        s = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + x[j : n - k + 1 + j])
        out.append(np.unique(s))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    low = np.empty((len(sets), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        v = flat ^ _FLIP[i]
        v *= _ODD[i]
        low[:, i] = np.minimum.reduceat(v, starts)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def step_chance(share: np.ndarray) -> np.ndarray:
    """Chance that a register of one set is larger, if this share of the union lies in that set alone."""
    return -np.log1p(-share * (BASE - 1) / BASE) / np.log(BASE)


def equal_chance(similarity: float) -> float:
    """The least chance that a register of two sets is equal, over all pairs of set sizes (the convex
    step_chance() adds up to most if one set holds the other)."""
    return float(1 - step_chance(1 - similarity))


def chances(similarity: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chances that a register is larger in the left set, larger in the right set, equal; for set sizes."""
    u, v = left / (left + right), right / (left + right)
    larger, smaller = (np.maximum(step_chance(np.maximum(x, 0)), 1e-12) for x in (u - v * similarity, v - u * similarity))
    return larger, smaller, np.maximum(1 - larger - smaller, 1e-12)


def log_likelihood(similarity, larger, smaller, left, right) -> np.ndarray:
    a, b, c = chances(similarity, left, right)
    return larger * np.log(a) + smaller * np.log(b) + (REGISTERS - larger - smaller) * np.log(c)


def estimate(larger, smaller, left, right, start: float = 0.8, steps: int = 4) -> np.ndarray:
    """The likeliest similarity of pairs, given how many registers are larger in the left set and in the right
    set and the sizes of both: a few steps of Fisher scoring from `start`."""
    larger, smaller, left, right = (np.asarray(x, np.float64) for x in (larger, smaller, left, right))
    u, v, c = left / (left + right), right / (left + right), (BASE - 1) / BASE
    most = np.minimum(left, right) / np.maximum(left, right)
    j = np.minimum(start, most)
    for _ in range(steps):
        p, q, r = chances(j, left, right)
        dp = -v * c / ((1 - np.maximum(u - v * j, 0) * c) * np.log(BASE))
        dq = -u * c / ((1 - np.maximum(v - u * j, 0) * c) * np.log(BASE))
        score = larger * dp / p + smaller * dq / q - (REGISTERS - larger - smaller) * (dp + dq) / r
        information = REGISTERS * (dp * dp / p + dq * dq / q + (dp + dq) ** 2 / r)
        j = np.clip(j + score / information, 0, most)
    return j


#: Twice the log-likelihood that a pair may lose at the threshold; a chance of about exp(-18).
FAR = 36.0


def may_be_linked(share: float, larger, smaller, left, right) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs may have a similarity of `share` or more, and their estimates."""
    j = estimate(larger, smaller, left, right)
    lost = log_likelihood(j, larger, smaller, left, right) - log_likelihood(share, larger, smaller, left, right)
    return (j >= share) | (2 * lost <= FAR), j


def banding(share: float) -> tuple[int, int]:
    """Bands and registers in each, so that a pair at the threshold is missed with a chance under 1e-6."""
    for rows in range(8, 0, -1):
        if (1 - equal_chance(share) ** rows) ** (REGISTERS // rows) < 1e-6:
            return REGISTERS // rows, rows
    raise ValueError(f"a similarity of {share} is too low for {REGISTERS} registers")


def least_equal(share: float) -> int:
    """Equal registers below which a pair at the threshold falls with a chance under 1e-6 (exact binomial tail)."""
    p, below, least = equal_chance(share), 0.0, 0
    while least <= REGISTERS:
        below += math.comb(REGISTERS, least) * p**least * (1 - p) ** (REGISTERS - least)
        if below >= 1e-6:
            break
        least += 1
    return min(least, REGISTERS)


class Forest:
    """Union-find over the members of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _likely_pairs(regs: np.ndarray, sizes: np.ndarray, side: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of different sides, if there are two) that sketches and sizes allow, most alike first."""
    left, right, larger, equal = [], [], [], []
    two = side.min() != side.max()
    for i in range(len(regs) - 1):
        eq = (regs[i + 1 :] == regs[i]).sum(1)
        a, b = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        ok = (eq >= least) & (100 * a >= percent * b)
        if two:
            ok &= side[i + 1 :] != side[i]
        j = np.flatnonzero(ok)
        if len(j):
            left.append(np.full(len(j), i))
            right.append(j + i + 1)
            larger.append((regs[j + i + 1] < regs[i]).sum(1))
            equal.append(eq[j])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right, larger, equal = (np.concatenate(x) for x in (left, right, larger, equal))
    ok, alike = may_be_linked(percent / 100, larger, REGISTERS - larger - equal, sizes[left], sizes[right])
    order = np.argsort(-alike, kind="stable")
    order = order[ok[order]]
    return left[order], right[order]


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    x, y = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


EDGE = "a long, b long"


def _edges(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    both = np.sort(ids[pairs], axis=1) if len(pairs) else pairs
    return pa.table([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    regs = np.frombuffer(b"".join(t["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    return t["node"].to_numpy(), t["n"].to_numpy(), t["side"].to_numpy(), regs


def _once(t: pa.Table) -> pa.Table:
    """A row for each node and side: rows that repeat both id and text come several times."""
    t = t.sort_by([("side", "ascending"), ("node", "ascending")])
    node, side = t["node"].to_numpy(), t["side"].to_numpy()
    return t.filter(pa.array(np.concatenate([[True], (np.diff(node) != 0) | (np.diff(side) != 0)])))


def _sets(t: pa.Table) -> list[np.ndarray] | None:
    return [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()] if "hashes" in t.column_names else None


def _forest(percent: int):
    """Edges that connect all links of a block; by sketches, or verified if there are full sets."""
    least = least_equal(percent / 100)

    def f(t: pa.Table) -> pa.Table:
        t = _once(t)
        ids, sizes, side, regs = _columns(t)
        sets, forest, found = _sets(t), Forest(len(ids)), []
        for a, b in zip(*(x.tolist() for x in _likely_pairs(regs, sizes, side, least, percent))):
            if forest.find(a) != forest.find(b) and (sets is None or _linked(sets[a], sets[b], percent)):
                forest.join(a, b)
                found.append((a, b))
        return _edges(ids, found)

    return f


#: Members of a large group that all others are compared with.
CENTRES = 4


def _beams(percent: int):
    """node, mask: the centres (sides 0, 1, ...) that the members (side -1) of a part are linked with."""

    def f(t: pa.Table) -> pa.Table:
        t = _once(t)
        ids, sizes, side, regs = _columns(t)
        sets = _sets(t)
        at, mask = np.flatnonzero(side < 0), np.zeros(len(ids), np.int32)
        for c in np.flatnonzero(side >= 0):
            larger, smaller = (regs[at] < regs[c]).sum(1), (regs[at] > regs[c]).sum(1)
            a, b = np.minimum(sizes[at], sizes[c]), np.maximum(sizes[at], sizes[c])
            ok, _ = may_be_linked(percent / 100, larger, smaller, np.full(len(at), sizes[c]), sizes[at])
            ok &= (100 * a >= percent * b) & (REGISTERS - larger - smaller >= least_equal(percent / 100))
            hit = [k for k in at[ok].tolist() if sets is None or _linked(sets[c], sets[k], percent)]
            mask[hit] |= 1 << int(side[c])
        return pa.table([t["grp"].take(pa.array(at)), pa.array(ids[at]), pa.array(mask[at])], ["grp", "node", "mask"])

    return f


def star(members: DataFrame, sizes: DataFrame, group: str, percent: int, payload) -> DataFrame | None:
    """grp, node, centre of the members of large groups that are linked with the best of CENTRES members;
    None without large groups. payload adds what is compared to rows that have nodes."""
    large = sizes.filter((F.col("members") > BLOCK_ROWS) | (F.col("shingles") > BLOCK_SHINGLES)).withColumn("parts", F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
    large = stored(large.select(group, "parts"), "large-groups")
    if large.isEmpty():
        return None
    spread = F.xxhash64("node", F.lit("centre"))
    rows = members.join(small(large), group)
    centres = rows.groupBy(group, F.pmod(spread, F.lit(CENTRES)).cast("int").alias("side")).agg(F.min_by("node", spread).alias("node"), F.first("parts").alias("parts"))
    centres = stored(centres, "centres")
    sent = centres.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").join(members, [group, "node"])
    own = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("side", F.lit(-1)).drop("parts")
    every = payload(own.unionByName(sent)).withColumnRenamed(group, "grp")
    beams = stored(every.repartition("grp", "part").groupBy("grp", "part").applyInArrow(_beams(percent), f"grp {members.schema[group].dataType.simpleString()}, node long, mask int"), "beams")
    linked = [F.sum(F.col("mask").bitwiseAND(1 << c)).alias(f"c{c}") for c in range(CENTRES)]
    share = [F.struct((F.col(f"c{c}") / (1 << c)).alias("n"), F.lit(c).alias("side")) for c in range(CENTRES)]
    best = beams.groupBy("grp").agg(*linked).select("grp", F.greatest(*share)["side"].alias("side"))
    best = best.join(centres.select(F.col(group).alias("grp"), "side", F.col("node").alias("centre")), ["grp", "side"])
    near = beams.join(small(stored(best, "best-centres")), "grp").filter(F.expr("(mask & shiftleft(1, side)) <> 0 OR node = centre"))
    return stored(near.select("grp", "node", "centre"), "stars")


def _in_blocks(members: DataFrame, sizes: DataFrame, group: str, near: DataFrame | None) -> DataFrame:
    """Rows for each pair of blocks of a group (low, high, side) that has to be compared. Members of a star
    are compared with the others only, these with all. A group of ordinary size is one block."""
    if near is None:
        members = members.withColumn("near", F.lit(False))
        totals = sizes.filter("members > 1").withColumn("n_near", F.lit(0)).withColumn("near_shingles", F.lit(0))
    else:
        # large groups have stars; `near` names their members
        flags = near.select(F.col("grp").alias(group), "node", F.lit(True).alias("near"))
        members = members.join(small(flags), [group, "node"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
        of_stars = members.filter("near").groupBy(group).agg(F.count("*").alias("n_near"), F.sum("n").alias("near_shingles"))
        totals = sizes.filter("members > 1").join(small(stored(of_stars, "star-sizes")), group, "left").na.fill(0, ["n_near", "near_shingles"])
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    totals = totals.withColumn("others", blocks(F.col("members") - F.col("n_near"), F.col("shingles") - F.col("near_shingles"))).withColumn("stars", blocks(F.col("n_near"), F.col("near_shingles"))).filter("others > 0")
    spread = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    mine = F.when(F.col("near"), F.col("others") + spread(F.col("stars"))).otherwise(spread(F.col("others")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("near"), F.col("others")).otherwise(F.col("others") + F.col("stars")) - 1))
    rows = members.join(totals.select(group, "others", "stars"), group).withColumn("mine", mine).withColumn("other", other)
    return rows.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).withColumn("side", F.when(F.col("low") == F.col("high"), 0).otherwise((F.col("mine") == F.col("high")).cast("int"))).drop("mine", "other", "others", "stars", "near")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that sketches and sizes allow, so that chains of chance pairs make no large groups."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")

    def make():
        def f(batch):
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b")]
            n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            larger, smaller = (regs[0] > regs[1]).sum(1), (regs[0] < regs[1]).sum(1)
            ok, _ = may_be_linked(percent / 100, larger, smaller, *n)
            ok &= (100 * np.minimum(*n) >= percent * np.maximum(*n)) & (REGISTERS - larger - smaller >= least_equal(percent / 100))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

        return f

    return arrow_map(rows, make, EDGE)


def group_sizes(members: DataFrame, group: str) -> DataFrame:
    return members.groupBy(group).agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))


def _trees(rows: DataFrame, group: str, percent: int) -> DataFrame:
    # each block is a task of its own: a join by group alone would leave all blocks of a group in one task
    return rows.repartition(group, "low", "high").groupBy(group, "low", "high").applyInArrow(_forest(percent), EDGE)


def _of_stars(near: DataFrame) -> DataFrame:
    return near.select(F.col("centre").alias("a"), F.col("node").alias("b"))


def forests(members: DataFrame, group: str, percent: int, payload=lambda rows: rows) -> DataFrame:
    """Edges a, b that connect all links inside each group. members: group, node, n, registers; payload adds
    full sets to rows, if links are to be verified."""
    sizes = group_sizes(members, group)
    near = star(members, sizes, group, percent, payload)
    edges = _trees(payload(_in_blocks(members, sizes, group, near)), group, percent)
    return edges if near is None else edges.unionByName(_of_stars(near))


def candidates(members: DataFrame, group: str, percent: int, shingles) -> DataFrame:
    """Edges a, b that connect all likely links inside each group, by sketches. Large groups whose members are not all
    linked with one of them are dealt anew by rare shingles. shingles: nodes -> node, shingles."""
    sizes = group_sizes(members, group)
    near = star(members, sizes, group, percent, lambda rows: rows)
    if near is None:
        return _trees(_in_blocks(members, sizes, group, None), group, percent)
    large = small(stored(sizes.filter((F.col("members") > BLOCK_ROWS) | (F.col("shingles") > BLOCK_SHINGLES)).select(group), "large"))
    ordinary = members.join(large, group, "left_anti")
    edges = _trees(_in_blocks(ordinary, group_sizes(ordinary, group), group, None), group, percent).unionByName(_of_stars(near))
    flags = near.select(F.col("grp").alias(group), "node")
    others = stored(members.join(large, group).join(small(flags), [group, "node"], "left_anti").select(group, "node"), "others")
    if others.isEmpty():
        return edges
    groups = small(stored(others.select(group).distinct(), "groups-with-others"))
    nodes = stored(members.join(groups, group).select("node", "n", "registers").dropDuplicates(["node"]), "dealt-anew")
    lists = stored(rare_lists(nodes, others.select("node").distinct(), percent, shingles), "rare-lists")
    return edges.unionByName(forests(lists, "list", percent))


#: Nodes with a shingle from which it counts as frequent.
FREQUENT = 50


def rare_lists(nodes: DataFrame, others: DataFrame, percent: int, shingles) -> DataFrame:
    """list, node, n, registers: the nodes that have one of their rarest shingles in common, for lists in which one of
    `others` is. Frequent shingles come last in the order, by their number of nodes; all others come before, by hash."""
    sets = stored(shingles(nodes.select("node")), "shingles").select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("list"))
    often = stored(sets.groupBy("list").agg(F.count("*").alias("often")).filter(F.col("often") >= FREQUENT), "frequent-shingles")
    order = Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(0)), "list")
    reach = F.col("size") - F.ceil(F.col("size") * F.lit(percent) / 100) + 1
    rare = sets.join(small(often), "list", "left").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= reach).select("list", "node")
    rare = stored(rare.join(small(stored(others.withColumn("other", F.lit(True)), "other-nodes")), "node", "left"), "rare-shingles")
    found = rare.groupBy("list").agg(F.count("*").alias("members"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor(F.xxhash64("node")).alias("which"), F.bool_or(F.coalesce("other", F.lit(False))).alias("any"))
    # lists of the same members are one
    found = found.filter("members > 1 AND any").groupBy("members", "a", "b", "which").agg(F.min("list").alias("list")).select("list")
    return rare.join(small(stored(found, "lists")), "list").join(nodes, "node").select("list", "node", "n", "registers")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, root (smallest node reachable) of an edge table, by alternating large-star and small-star
    steps; each step is written to the shared folder, nothing is collected."""
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        up = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        star = up.join(least, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("u").alias("b")), F.struct(F.col("m").alias("a"), F.col("v").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = stored(star, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, component_key for every row; text_key tells rows with one
    id apart, component_key components with one smallest id (null for a row that stands alone).
    Texts are linked if 100 * intersection >= percent * union of their shingle sets."""
    texts = docs.select("doc_id", "text")
    keyed_texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def make():
        def f(batch):
            for part in slices(batch, 4 << 20):
                sets = shingle_sets(filled_text(part), width)
                full = [k for k, s in enumerate(sets) if len(s)]
                regs = sketch([sets[k] for k in full]) if full else None
                key, reg = [None] * len(sets), [None] * len(sets)
                for row, k in enumerate(full):
                    key[k], reg[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), regs[row].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(reg, pa.binary())], ["doc_id", "text_key", "n", "set_key", "registers"])

        return f

    rows = stored(arrow_map(keyed_texts, make, "doc_id long, text_key long, n long, set_key binary, registers binary"), "sketches")
    linked = rows.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    # a class is told by a number, as classes of one id differ; the number is fixed once it is stored
    classes = stored(linked.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("registers").alias("registers")).withColumn("node", F.monotonically_increasing_id()), "classes")

    # buckets: keys only; sketches follow for those that need them
    n_bands, n_rows = banding(percent / 100)
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * n_rows) + 1, F.lit(2 * n_rows)))))
    keyed = classes.select("node", bands.alias("bucket"))
    buckets = keyed.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor(F.xxhash64("node")).alias("which")).filter("members > 1")
    # buckets of the same members are one
    buckets = stored(buckets.groupBy("members", "a", "b", "which").agg(F.min("bucket").alias("bucket")), "buckets")
    pairs = likely(buckets.filter("members = 2").select("a", "b"), classes, percent)
    larger = keyed.join(small(buckets.filter("members > 2").select("bucket")), "bucket")
    larger = stored(larger.join(classes.select("node", "n", "registers"), "node"), "bucket-members")

    def make_lists():
        def f(batch):
            for part in slices(batch, 4 << 20):
                sets = shingle_sets(filled_text(part), width)
                cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], ["rep", "set_key", "shingles"])

        return f

    def shingles(nodes):
        """node, shingles of one text of each node."""
        rows = stored(classes.join(small(nodes), "node").select("node", "rep", "set_key"), "nodes-of-lists")
        wanted = small(stored(rows.select(F.col("rep").alias("doc_id")).distinct(), "wanted"))
        made = arrow_map(texts.join(wanted, "doc_id"), make_lists, "rep long, set_key binary, shingles array<long>")
        return made.join(rows, ["rep", "set_key"]).select("node", "shingles").dropDuplicates(["node"])

    groups = stored(components(pairs.unionByName(candidates(larger, "bucket", percent, shingles))), "groups")
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())

    # verification on full sets, made anew from the texts of the classes that have a possible partner
    members = stored(classes.join(groups.select("node", F.col("root").alias("group_id")), "node").select("node", "rep", "set_key", "n", "registers", "group_id"), "members")

    def make_sets():
        def f(batch):
            for part in slices(batch, 4 << 20):
                sets = shingle_sets(filled_text(part), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "set_key", "hashes"])

        return f

    def with_sets(rows):
        wanted = small(stored(rows.select(F.col("rep").alias("doc_id")).distinct(), "wanted"))
        return rows.join(arrow_map(texts.join(wanted, "doc_id"), make_sets, "rep long, set_key binary, hashes binary"), ["rep", "set_key"])

    links = stored(forests(members, "group_id", percent, with_sets), "links")
    final = stored(components(links), "final")
    final = final.unionByName(final.select(F.col("root").alias("node"), "root").distinct())

    # classes that have several rows or partners; the root's number tells components of one id apart
    placed = stored(final.join(classes.select("node", "rep"), "node"), "placed")
    placed = placed.select("node", "root").join(placed.groupBy("root").agg(F.min("rep").alias("smallest")), "root").select("node", "smallest", "root")
    shared = classes.join(placed, "node", "left").filter("copies > 1 OR root IS NOT NULL")
    shared = stored(shared.select("set_key", F.coalesce("smallest", "rep").alias("smallest"), F.coalesce("root", "node").alias("component_key")), "class-components")
    out = rows.drop("registers").join(small(shared), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    key = F.when(F.col("doc_id").isNotNull(), F.col("component_key"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), key.alias("component_key"))
