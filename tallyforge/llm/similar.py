"""Groups of texts whose word shingles are similar, by long SimHash prints with bit-sliced comparison.

``neardup`` links fingerprints within three bits. Texts with a Jaccard similarity of 0.8 on five-word
shingles differ in about 15 % of the bits, too many for exact blocks, so this form takes prints of
128 bits and the usual tables of sampled bits:

1. *Tables.* A table keys each distinct print by ``bits`` sampled positions. ``bits`` grows with the
   logarithm of the number of prints, so keys hold a bounded number of prints (about 64) at any size. There are so many
   tables that a pair at the similarity meets with the chance RECALL, taken over the whole binomial
   spread of its distance. Sets of few shingles differ in more bits and get more tables.
2. *Compare.* Prints of a key are compared with vertical bit planes and carry-save counters
   (``neardup.close_pairs``) within RADIUS bits, three deviations above the distance expected for the
   worst set sizes (4 of 5 shingles shared). A cell with more close pairs than DENSE times its prints gives
   the minimum spanning forest by distance: it connects what is connected at any lower distance, so no cell
   gives more edges than that.
3. *Sketch.* Prints at the radius may stand for half the similarity. Before any text moves, the ends of an edge are compared by
   sketches: the least shingle hash of each of BINS ranges of hashes, a byte each. Of the ranges that either text fills,
   the share in which both have the same is the similarity in expectation; an edge goes only if it is
   so low that a pair at the similarity has it with a chance of at most SURE.
4. *Verify.* Each edge left is verified on the two texts: the Jaccard similarity of their shingle sets.
5. Verified edges are linked to groups.
6. *Left out.* The forest knows distances, not similarities, so where a cell left pairs out, the
   texts its forest connects are a cluster. Groups of one cluster that step 5 left apart are compared by their
   sketches in blocks, and the texts that may have a partner in another group are compared with each other text by text, exactly;
   only pairs within the largest group of the cluster, which is one group already, need no block.

Defined results: texts are compared in lower case (A-Z); fewer than five words are one shingle, no word
is an empty set, and all texts without a word are one group; NULL counts as empty; NULL ids and
repeated rows take part like others; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle, small
from tallyforge.llm.common import LOWER, components, gram_hashes, keep_one, mixed, rows_of, thinned, word_hashes, words_of
from tallyforge.llm.neardup import close_in_cells, close_pairs

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 37
PRINT_BITS = 128
RECALL = 0.97
MIN_BITS = 12
KEY_BITS = 6
# Sets of at most so many shingles count as short.
SHORT = 32
PART = 1024
LOOK = 16
SMALL_CELL = 512
WORDS = 1 << 15
DENSE = 1
BINS = 128
SURE = 1e-5
BLOCK = 256
SKETCH_BLOCK = 2048


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    words = words_of(text.translate(LOWER) if text else text)
    return np.unique(gram_hashes(word_hashes(words), min(SHINGLE, len(words)))) if words else np.zeros(0, np.uint64)


def print_of(grams: np.ndarray) -> tuple[int, int]:
    """SimHash of a set of shingles as two signed words; the empty set has zeros."""
    if not len(grams):
        return 0, 0
    ones = np.zeros(PRINT_BITS, np.int64)
    for at in range(0, len(grams), 1 << 13):
        g = grams[at : at + (1 << 13)]
        two = np.stack([g, mixed(g + np.uint64(0x51ED270B))], axis=1)
        ones += np.unpackbits(two.view(np.uint8).reshape(len(g), 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    a, b = np.packbits(2 * ones > len(grams), bitorder="little").view("<i8").tolist()
    return a, b


_BIN_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def sketch_of(grams: np.ndarray) -> bytes:
    """A byte per range of hashes: 1 to 255 for its least shingle hash, 0 for none. ``grams`` are sorted."""
    out = np.zeros(BINS, np.uint8)
    if len(grams):
        first = grams[np.minimum(np.searchsorted(grams, _BIN_STARTS), len(grams) - 1)]
        full = first >> np.uint64(64 - BINS.bit_length() + 1) == np.arange(BINS, dtype=np.uint64)
        out[full] = (mixed(first[full]) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.tobytes()


@lru_cache
def least_shared(similarity: float) -> np.ndarray:
    """By the number of filled ranges: the fewest equal ones that a pair at the similarity has but for a chance of SURE.

    The least hash of a filled range is shared with the chance of the similarity; ranges draw from the union without
    replacement, so the binomial tail bounds the chance from above.
    """
    out = np.zeros(BINS + 1, np.int64)
    for n in range(BINS + 1):
        below = 0.0
        for k in range(n + 1):
            below += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
            if below > SURE:
                out[n] = k
                break
    return out


def may_be_similar(one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sketches (last axis: bytes) do not rule the similarity out."""
    same = np.count_nonzero((one == two) & (one != 0), axis=-1)
    return same >= least_shared(similarity)[np.count_nonzero(one | two, axis=-1)]


def _sketches(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), BINS)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        sets = [shingle_set(t) for t in b.column(2).to_pylist()]
        both = [print_of(x) for x in sets]
        cols = [pa.array([x[k] for x in both], pa.int64()) for k in (0, 1)]
        cols.append(pa.array([len(x) <= SHORT for x in sets], pa.bool_()))
        cols.append(pa.array([sketch_of(x) for x in sets], pa.binary()))
        yield pa.record_batch([b.column(0), b.column(1), *cols], names=["doc_id", "th", "a", "b", "short", "sketch"])


def differing(one: int, two: int, both: int) -> float:
    """The chance that a bit of the prints differs, for sets of ``one`` and ``two`` shingles that share ``both``."""

    def chances(n: int) -> np.ndarray:
        return np.array([math.comb(n, k) for k in range(n + 1)], float) / 2.0**n

    shared = np.arange(both + 1)
    first, second = ((2 * (shared[:, None] + np.arange(n - both + 1)) > n) @ chances(n - both) for n in (one, two))
    return float(chances(both) @ (first * (1 - second) + second * (1 - first)))


@lru_cache
def worst_differing(similarity: float, short: bool) -> float:
    """The largest chance of a differing bit among pairs of short (or other) sets at the similarity or above.

    The cosine of two equally large sets is 2 J / (1 + J); a bit differs with the angle's share of a
    half turn. That is the limit of large sets; up to 4 x SHORT shingles all sizes are tried.
    """
    found = [math.acos(2 * similarity / (1 + similarity)) / math.pi]
    for two in range(1, SHORT + 1) if short else range(SHORT + 1, 4 * SHORT + 1):
        for one in range(math.ceil(similarity * two), two + 1):
            both = math.ceil(similarity * (one + two) / (1 + similarity) - 1e-9)
            if both <= one:
                found.append(differing(one, two, both))
    return max(found)


def meeting(differ: float, bits: int, tables: int) -> float:
    """The chance that two prints are within RADIUS and agree in all sampled bits of a table, over the spread of their distance."""
    out = 0.0
    for d in range(RADIUS + 1):
        agree = math.comb(PRINT_BITS - d, bits) / math.comb(PRINT_BITS, bits)
        out += math.comb(PRINT_BITS, d) * differ**d * (1 - differ) ** (PRINT_BITS - d) * (1 - (1 - agree) ** tables)
    return out


def table_plan(prints: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(sampled bits, tables) for a number of distinct prints by the expected distance alone, for keys of one print.

    Half as many tables again make up for distances above the expected one; ``spread_plan`` counts with these distances.
    """
    bits = _log_bits(prints)
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits, math.ceil(1.5 * math.log(1 / (1 - recall)) / (1 - differ) ** bits)


def _log_bits(prints: int) -> int:
    return min(48, max(MIN_BITS, math.ceil(math.log2(max(prints, 2)))))


def spread_plan(prints: int, similarity: float = SIMILARITY, recall: float = RECALL, short: bool = False) -> tuple[int, int]:
    """(sampled bits, tables): the least tables by which a pair at the similarity meets with the chance ``recall``.

    KEY_BITS bits less than the logarithm of the number of prints are sampled: keys hold about 64 prints, and pairs
    above the expected distance need far fewer tables. Short sets take part in further tables; a pair
    of a short and another set meets in the tables of the other.
    """
    bits = max(MIN_BITS, _log_bits(prints) - KEY_BITS)
    differ = worst_differing(similarity, short)
    if meeting(differ, bits, 1 << 40) < recall:
        raise ValueError(f"RADIUS {RADIUS} is too small for similarity {similarity} and recall {recall}")
    low, high = 0, 1
    while meeting(differ, bits, high) < recall:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if meeting(differ, bits, middle) >= recall else (middle, high)
    return bits, high


def _table_keys(bits: int, tables: int, short_tables: int):
    places = np.stack([np.random.default_rng(t).choice(PRINT_BITS, bits, replace=False) for t in range(max(tables, short_tables))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for b in rows_of(batches, 4096):
            a, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            own = np.unpackbits(np.stack([a, c], axis=1).view(np.uint8).reshape(len(a), 16), axis=1, bitorder="little")
            short = b.column(2).to_numpy(zero_copy_only=False)
            for t in range(len(places)):
                if t == tables:
                    a, c, own = a[short], c[short], own[short]
                    if not len(a):
                        break
                value = own[:, places[t]] @ weights
                # the number of the table is mixed in, so that a key names both
                key = mixed(value.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t + 1)).view(np.int64)
                yield pa.record_batch([pa.array(key), pa.array(a), pa.array(c)], names=["key", "a", "b"])

    return run


def spanning_forest(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the edges of a minimum spanning forest: every component takes its lightest edge outwards, until none has any."""
    order = np.argsort(weight, kind="stable")
    left, right = left[order], right[order]
    label, taken = np.arange(n), np.zeros(len(order), bool)
    while True:
        out = np.flatnonzero(label[left] != label[right])
        if not len(out):
            return order[taken]
        left_, right_ = label[left[out]], label[right[out]]
        best = np.full(n, len(order))
        np.minimum.at(best, left_, out)
        np.minimum.at(best, right_, out)
        chosen = np.unique(best[best < len(order)])
        taken[chosen] = True
        u, v = label[left[chosen]], label[right[chosen]]
        root = np.arange(n)
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        label = root[label]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, x, y, side, a, b) sorted by (key, x, y): the close pairs of each cell, or their spanning forest where they are many.

    ``cut`` tells that the cell has close pairs that are not in its forest.
    """

    def out(p: np.ndarray, i: np.ndarray, j: np.ndarray, cut: bool = False) -> pa.RecordBatch:
        cols = [p[i, 0], p[i, 1], p[j, 0], p[j, 1]]
        return pa.record_batch([*[pa.array(c.view(np.int64)) for c in cols], pa.array(np.full(len(i), cut))], names=["a1", "b1", "a2", "b2", "cut"])

    def cells(key: np.ndarray, x: np.ndarray, y: np.ndarray, side: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        size = np.diff(np.r_[start, len(key)])
        little = (size > 1) & (size <= SMALL_CELL) & (x[start] == y[start])
        own = np.flatnonzero(little)
        ends = np.cumsum(size[own] * -(-size[own] // 64))
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
            some = own[at:to]
            at = to
            left, right = close_in_cells(p, start[some], size[some], RADIUS)
            of = np.searchsorted(start[some], left, "right") - 1
            dense = np.bincount(of, minlength=len(some)) > DENSE * size[some]
            plain = ~dense[of]
            if plain.any():
                yield out(p, left[plain], right[plain])
            for k in np.flatnonzero(dense):
                low, near = int(start[some[k]]), of == k
                l, r = left[near], right[near]
                e = spanning_forest(int(size[some[k]]), l - low, r - low, np.bitwise_count(p[l] ^ p[r]).sum(axis=1))
                yield out(p, l[e], r[e], len(e) < len(l))
        for k in np.flatnonzero((size > 1) & ~little):
            s = slice(start[k], start[k] + size[k])
            own, same = p[s], x[start[k]] == y[start[k]]
            one = np.arange(len(own)) if same else np.flatnonzero(side[s] == x[start[k]])
            two = one if same else np.flatnonzero(side[s] == y[start[k]])
            if not len(one) or not len(two):
                continue
            found = [close_pairs(own[one[at : at + 128]], own[two], RADIUS) for at in range(0, len(one), 128)]
            left = one[np.concatenate([l + 128 * i for i, (l, _) in enumerate(found)])]
            right = two[np.concatenate([r for _, r in found])]
            if same:
                left, right = left[left < right], right[left < right]
            if len(left) <= DENSE * len(own):
                if len(left):
                    yield out(own, left, right)
            else:
                far = np.bitwise_count(own[left] ^ own[right]).sum(axis=1)
                e = spanning_forest(len(own), left, right, far)
                yield out(own, left[e], right[e], len(e) < len(left))

    held = None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(6)]
        now = [*cols[:4], np.stack(cols[4:], axis=1).view(np.uint64)]
        if held is not None:
            now = [np.concatenate(c) for c in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        other = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]) | (now[2] != now[2][-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        held = [c[last:] for c in now]
        if last:
            yield from cells(*[c[:last] for c in now])
    if held is not None:
        yield from cells(*held)


def candidate_edges(prints: DataFrame, n: int, part: int = PART, similarity: float = SIMILARITY) -> DataFrame:
    """(a1, b1, a2, b2, cut) from distinct prints (a, b, short); keys above ``part`` prints are cut into parts that meet in pairs."""
    bits, tables = spread_plan(n, similarity)
    plan = _table_keys(bits, tables, spread_plan(n, similarity, short=True)[1])
    keyed = prints.select("a", "b", "short").mapInArrow(plan, "key bigint, a bigint, b bigint")
    # how keys are cut decides on the work of a task, not on what is found: one print in LOOK tells the large ones
    look = LOOK if part >= 16 * LOOK else 1
    some = prints.where(F.pmod(F.xxhash64("b", "a"), F.lit(look)) == 0).select("a", "b", "short").mapInArrow(plan, "key bigint, a bigint, b bigint")
    large = some.groupBy("key").agg((F.count("*") * look).alias("n")).where(F.col("n") > part // 2).select("key", F.ceil(F.col("n") / F.lit(part)).cast("int").alias("p"))
    large = settle(large, "large-keys")
    side = F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("p")).cast("int"), F.lit(0)).alias("side")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("p"), F.lit(1)) - 1)).alias("other")
    placed = keyed.join(large, "key", "left").select("key", "a", "b", side, "p").select("key", "a", "b", "side", other)
    cells = placed.select("key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "a", "b")
    dealt = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    found = dealt.mapInArrow(_edges, "a1 bigint, b1 bigint, a2 bigint, b2 bigint, cut boolean")
    return found.groupBy("a1", "b1", "a2", "b2").agg(F.max("cut").alias("cut"))


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 512):
            good = []
            for t1, t2 in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                one, two = shingle_set(t1), shingle_set(t2)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(both >= similarity * (len(one) + len(two) - both))
            yield pa.record_batch([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _alike(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of ``one`` x ``two`` (positions of ``sets``) have the similarity, by products of 0/1 matrices of the shared shingles."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[gram] > 1
    name = np.cumsum(times > 1) - 1
    owner, gram = owner[shared], name[gram[shared]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    both = np.zeros((len(one), len(two)))
    for at in range(0, int(gram[-1]) + 1 if len(gram) else 0, 4096):
        s = slice(*np.searchsorted(gram, [at, at + 4096]))
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[s], gram[s] - at] = 1
        both += has[one] @ has[two].T
    return both >= similarity * (sizes[one][:, None] + sizes[two][None, :] - both)


def _blocks(similarity: float):
    """Rows (cluster, x, y, side, root, text) sorted by (cluster, x, y): links (u, v) between the roots of similar texts."""

    def links(side: list[int], root: list[int], text: list[bytes | None], x: int, y: int) -> pa.RecordBatch:
        side, root = np.array(side), np.array(root, np.int64)
        one, two = np.flatnonzero(side == x), np.flatnonzero(side == y)
        u = v = np.zeros(0, np.int64)
        if len(one) and len(two):
            l, r = np.nonzero(_alike([shingle_set(t) for t in text], one, two, similarity))
            u, v = root[one[l]], root[two[r]]
            names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            e = spanning_forest(len(names), at[: len(u)], at[len(u) :], np.zeros(len(u), np.int64))
            u, v = u[e], v[e]
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for b in rows_of(batches, 512):
            for *cell, side, root, text in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if cell != now:
                    if now:
                        yield links(*held, *now[1:])
                    now, held = cell, ([], [], [])
                for have, new in zip(held, (side, root, text), strict=True):
                    have.append(new)
        if now:
            yield links(*held, *now[1:])

    return run


def _partners(similarity: float):
    """Rows (cluster, x, y, side, root, node, sketch) sorted by (cluster, x, y): nodes whose sketch allows a partner in another group."""

    def found(side: list[int], root: list[int], node: list[int], sketch: list[bytes], x: int, y: int) -> pa.RecordBatch:
        side, root, node, bins = np.array(side), np.array(root, np.int64), np.array(node, np.int64), _sketches(sketch)
        one, two = np.flatnonzero(side == x), np.flatnonzero(side == y)
        hit = np.zeros(len(side), bool)
        for at in range(0, len(one), 16):
            own = one[at : at + 16]
            for to in range(0, len(two), 1024):
                other = two[to : to + 1024]
                near = may_be_similar(bins[own][:, None], bins[other][None], similarity) & (root[own][:, None] != root[other][None])
                hit[own] |= near.any(axis=1)
                hit[other] |= near.any(axis=0)
        return pa.record_batch([pa.array(node[hit], pa.int64())], names=["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])
        for b in rows_of(batches, 512):
            for *cell, side, root, node, sketch in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
                if cell != now:
                    if now:
                        yield found(*held, *now[1:])
                    now, held = cell, ([], [], [], [])
                for have, new in zip(held, (side, root, node, sketch), strict=True):
                    have.append(new)
        if now:
            yield found(*held, *now[1:])

    return run


def _dealt(members: DataFrame, block: int) -> DataFrame | None:
    """(cluster, x, y, side, root, node) of the blocks in which the groups of each cluster meet; None if none has two.

    In a cluster the members outside its largest group are cut into parts that meet each other and all
    parts of the largest group, so a task holds two parts at a time.
    """
    sizes = members.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("groups")).where("groups > 1")
    p, q = (F.ceil(n / F.lit(block)).cast("int") for n in (F.col("n") - F.col("main.n"), F.col("main.n")))
    sizes = settle(sizes.select("cluster", F.col("main.root").alias("main"), p.alias("p"), q.alias("q")), "cluster-sizes")
    if sizes.isEmpty():
        return None
    is_main = F.col("root") == F.col("main")
    spot = F.xxhash64("node")
    side = F.when(is_main, F.col("p") + F.pmod(spot, F.col("q"))).otherwise(F.pmod(spot, F.col("p"))).cast("int")
    last = F.when(is_main, F.col("p")).otherwise(F.col("p") + F.col("q")) - 1
    placed = members.join(sizes, "cluster").select("cluster", "node", "root", side.alias("side"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return placed.select("cluster", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "root", "node")


def texts_of(docs: DataFrame, nodes: DataFrame, column: str = "text") -> DataFrame:
    """(th, ``column``) of the listed text hashes (th, distinct), one row each. Few hashes are broadcast, so only their texts are shuffled."""
    nodes = settle(nodes, "nodes")
    return docs.select("th", column).join(small(nodes, nodes.count()), "th", "left_semi").dropDuplicates(["th"])


def left_out_links(edges: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float, block: int | None = None, sketches: DataFrame | None = None) -> DataFrame | None:
    """Links (u, v) between groups that candidate cells left apart: (node, root) are the groups so far; None if there are none.

    ``texts`` has (th, text), ``sketches`` (th, sketch); without it they are made of the texts.
    """
    cut = edges.where("cut").select("u", "v")
    if cut.isEmpty():
        return None
    clusters = components(thinned(cut, "cut-edges"), "clusters").withColumnRenamed("root", "cluster")
    # a root may have no row of its own
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("node"), "cluster")).distinct()
    members = settle(clusters.join(roots, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("root")), "cluster-members")
    blocks = _dealt(members, block or SKETCH_BLOCK)
    if blocks is None:
        return None
    named = members.select(F.col("node").alias("th")).distinct()
    if sketches is None:
        sketches = texts.mapInArrow(_sketch_texts, "th bigint, sketch binary")
    bins = texts_of(sketches, named, "sketch").withColumnRenamed("th", "node")
    cells = blocks.join(bins, "node").select("cluster", "x", "y", "side", "root", "node", "sketch")
    dealt = cells.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    asked = settle(dealt.mapInArrow(_partners(similarity), "node bigint").distinct(), "possible-partners")
    blocks = _dealt(settle(members.join(asked, "node", "left_semi"), "asked-members"), block or BLOCK)
    if blocks is None:
        return None
    own = texts_of(texts, asked.withColumnRenamed("node", "th")).withColumnRenamed("th", "node")
    cells = blocks.join(own, "node").select("cluster", "x", "y", "side", "root", "text")
    dealt = cells.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    return settle(dealt.mapInArrow(_blocks(similarity), "u bigint, v bigint").where("u <> v"), "left-out-links")


def _sketch_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        yield pa.record_batch([b.column(0), pa.array([sketch_of(shingle_set(t)) for t in b.column(1).to_pylist()], pa.binary())], names=["th", "sketch"])


def _possible(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 4096):
            good = may_be_similar(_sketches(b.column(2).to_pylist()), _sketches(b.column(3).to_pylist()), similarity)
            yield pa.record_batch([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _with_ends(edges: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """(u, v, one, two): the edges with a column of (th, column) at both ends."""
    one = side.select(F.col("th").alias("u"), F.col(column).alias("one"))
    two = side.select(F.col("th").alias("v"), F.col(column).alias("two"))
    return edges.join(one, "u").join(two, "v").select("u", "v", "one", "two")


def _ends(edges: DataFrame) -> DataFrame:
    """(th): the nodes of the edges, each side reduced on its own first."""
    one, two = (edges.select(F.col(c).alias("th")).distinct() for c in ("u", "v"))
    return one.unionByName(two).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """(doc_id, th, root) per row of ``docs``: th is a hash of the text, root names the group."""
    text = F.col(text_col)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    rows = settle(d.mapInArrow(_prints, "doc_id bigint, th bigint, a bigint, b bigint, short boolean, sketch binary"), "prints")
    own = settle(rows.groupBy("a", "b").agg(F.min("th").alias("node"), F.max("short").alias("short")), "distinct-prints")
    n = own.count()
    found = candidate_edges(own, n, part, similarity)
    ends = own.select(F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("node").alias("u"))
    others = own.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("v"))
    edges = settle(found.join(ends, ["a1", "b1"]).join(others, ["a2", "b2"]).select("u", "v", "cut").where("u <> v"), "candidate-edges")
    # only what the sketches allow is verified, so only its texts move
    pairs = _with_ends(edges.select("u", "v"), texts_of(rows, _ends(edges), "sketch"), "sketch")
    likely = settle(pairs.mapInArrow(_possible(similarity), "u bigint, v bigint"), "likely-edges")
    pairs = _with_ends(likely, texts_of(d, _ends(likely)), "text")
    verified = pairs.mapInArrow(_verify(similarity), "u bigint, v bigint")
    roots = components(thinned(verified, "verified-edges"), "similar-links")
    more = left_out_links(edges, roots, d.select("th", "text"), similarity, sketches=rows.select("th", "sketch"))
    if more is not None:
        of = roots.select("node", F.col("root").alias("v")).where("node <> v").withColumnRenamed("node", "u")
        roots = components(thinned(of.unionByName(more), "all-links"), "similar-links")
    roots = roots.withColumnRenamed("root", "r")
    named = own.join(roots, own["node"] == roots["node"], "left").select("a", "b", F.coalesce("r", own["node"]).alias("root"))
    return rows.join(named, ["a", "b"]).select("doc_id", "th", "root")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, one of each group (see ``common.keep_one``)."""
    return keep_one(docs, similar_groups(docs, id_col, text_col, similarity), id_col, text_col)
