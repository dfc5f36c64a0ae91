"""Near-duplicate groups by SimHash with bit-sliced comparison.

Fingerprints of all texts are compared where they agree in one of 16 keys. A pair within 3 bits
agrees in one of four 16-bit blocks, and on the other 48 bits in one of four 12-bit blocks, so
the 28-bit keys find every pair. Rows of a key are compared with vertical bit planes: plane j
holds bit j of 64 fingerprints per machine word, differing bits are added by carry-save counters,
64 pairs at a time, and words in which all 64 pairs are over the radius are left out of the
further planes.

Defined results: NULL and empty texts and texts without a word have fingerprint zero and are
linked like any other; rows with a NULL id take part, and a group without any id has a NULL
component_id; repeated rows each give a row; a shingle bit set in exactly half the shingles (a tie) is 0; a very
long text is read whole, its shingles in blocks; an empty table gives an empty result. Only the id and
text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle
from tallyforge.llm.common import LOWER, components, keep_one, rows_of, words_of

RADIUS = 3
SHINGLE = 3
SEED = 42
# Fingerprints of one key that are compared in one cell; larger keys are cut into parts and
# every pair of parts is a cell of its own.
PART = 2048
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, each counted as often as it occurs, as a signed number."""
    words = words_of(text.translate(LOWER) if text else text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)), strict=False)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _fingerprint_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            fps = [fingerprint(t, size) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp) per row; th is a hash of the text that tells rows with one id apart."""
    text = F.col(text_col)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    return d.mapInArrow(_fingerprint_batches(size), "doc_id bigint, th bigint, fp bigint")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes of n prints of k words each: 64 k x ceil(n / 64) words, row j holds bit j of all prints, 64 to a word."""
    n, k = prints.shape
    padded = np.concatenate([prints, np.zeros((-n % 64, k), np.uint64)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8 * k), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close_pairs(queries: np.ndarray, stored: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, stored) within ``radius`` (2 or more) bits, by bit-sliced counting."""
    planes = planes_of(stored)
    width = planes.shape[1]
    # word (q, w) of the flat layout: query q against the stored words w
    left, right = close_lanes(queries, planes, np.repeat(np.arange(len(queries)), width), np.tile(np.arange(width), len(queries)), radius)
    ok = right < len(stored)
    return left[ok], right[ok]


def close_lanes(queries: np.ndarray, planes: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) within ``radius`` bits, for the listed queries ``q`` each against the 64 lanes of its word ``w`` of the planes.

    The counters of 64 pairs are one word per binary digit. They start so that they overflow when a
    pair has passed the radius. Two planes are added at a time: a half adder makes their sum and
    carry, the carry ripples up, and what overflows is marked in ``over``. Words in which all 64 pairs
    are marked leave the further planes.
    """
    digits = radius.bit_length()
    start = (1 << digits) - 1 - radius
    c = [np.full(len(q), ONES if start >> d & 1 else 0, np.uint64) for d in range(digits)]
    over = np.zeros(len(q), np.uint64)
    one = np.uint64(1)
    for j in range(0, len(planes), 2):
        mine = queries[q, j // 64]
        a = planes[j][w] ^ (np.uint64(0) - ((mine >> np.uint64(j % 64)) & one))
        b = planes[j + 1][w] ^ (np.uint64(0) - ((mine >> np.uint64(j % 64 + 1)) & one))
        total = a ^ b
        up = c[0] & total
        c[0] ^= total
        # the carry and ``up`` exclude each other: a carry needs a = b = 1, and then total is 0
        up |= a & b
        for d in range(1, digits):
            here = c[d]
            c[d] = here ^ up
            up &= here
        over |= up
        if j % 8 == 6 and j >= 2 * radius + 8:
            live = over != ONES
            if 4 * np.count_nonzero(live) < 3 * len(q):
                q, w, over = q[live], w[live], over[live]
                c = [x[live] for x in c]
            if not len(q):
                break
    live = over != ONES
    q, w, near = q[live], w[live], ~over[live]
    word, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return q[word], w[word] * 64 + lane


def close_in_cells(prints: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left < right) within ``radius`` bits in cells of neighbouring prints, all cells in one pass of the counters.

    Cells begin at a word of their own, so many cells of few prints fill the counters as one large cell would.
    """
    words = -(-size // 64)
    first = np.cumsum(words) - words
    cell = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(cell)) - np.repeat(np.cumsum(size) - size, size)
    at, lane = np.repeat(start, size) + place, 64 * first[cell] + place
    padded = np.zeros((64 * int(words.sum()), prints.shape[1]), np.uint64)
    padded[lane] = prints[at]
    owner = np.full(len(padded), -1)
    owner[lane] = at
    n = words[cell]
    w = np.repeat(first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left, lane = close_lanes(prints, planes_of(padded), np.repeat(at, n), w, radius)
    right = owner[lane]
    ok = left < right
    return left[ok], right[ok]


def near_lanes(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which XORs of two prints have at most ``radius`` bits: the same counters, one lane per pair."""
    _, right = close_pairs(np.zeros((1, x.shape[1]), np.uint64), x, radius)
    out = np.zeros(len(x), bool)
    out[right] = True
    return out


def forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) rows that connect what the pairs connect, one per member that is no root."""
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


SMALL_GROUP = 48
LANES = 1 << 16


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, side, fp) sorted by (key, a, b): edges of each cell, at most one per member."""

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def cells(key: np.ndarray, a: np.ndarray, b: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        size = np.diff(np.r_[start, len(key)])
        little = (size > 1) & (size <= SMALL_GROUP) & (a[start] == b[start])
        # little cells: lanes are the pairs (i, i + d) of one cell
        rest = np.repeat(np.where(little, size, 0), size)
        place = np.arange(len(key)) - np.repeat(start, size)
        for d in range(1, int(size[little].max()) if little.any() else 0):
            i = np.flatnonzero(place + d < rest)
            for at in range(0, len(i), LANES):
                own = i[at : at + LANES]
                near = own[near_lanes((fp[own] ^ fp[own + d]).view(np.uint64)[:, None])]
                if len(near):
                    yield out(fp[near], fp[near + d])
        for k in np.flatnonzero((size > 1) & ~little):
            s = slice(start[k], start[k] + size[k])
            one, two = fp[s], fp[s]
            if a[start[k]] != b[start[k]]:
                one, two = fp[s][side[s] == a[start[k]]], fp[s][side[s] == b[start[k]]]
            if not len(one) or not len(two):
                continue
            asked, stored = one.view(np.uint64)[:, None], two.view(np.uint64)[:, None]
            found = [(at + l, r) for at in range(0, len(one), 256) for l, r in [close_pairs(asked[at : at + 256], stored)]]
            l, r = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            if one is two or a[start[k]] == b[start[k]]:
                u, v = forest(one, l, r)
            else:
                u, v = forest(np.concatenate([one, two]), l, r + len(one))
            if len(u):
                yield out(u, v)

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(5)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        key, a, b = cols[:3]
        # the last cell may go on in the next batch
        last = int(np.flatnonzero((key != key[-1]) | (a != a[-1]) | (b != b[-1]))[-1]) + 1 if len(key) and ((key != key[-1]) | (a != a[-1]) | (b != b[-1])).any() else 0
        held = [c[last:] for c in cols]
        if last:
            yield from cells(*[c[:last] for c in cols])
    if held is not None and len(held[0]):
        yield from cells(*held)


def block_keys(fp: Column) -> Column:
    """The 16 keys of a fingerprint: block b (16 bits) and sub-block s (12 of the other 48 bits)."""
    keys = []
    for b in range(4):
        block = F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit(0xFFFF))
        high = F.lit(0).cast("bigint") if b == 3 else F.shiftleft(F.shiftrightunsigned(fp, 16 * (b + 1)), 16 * b)
        rest = high.bitwiseOR(fp.bitwiseAND(F.lit((1 << 16 * b) - 1)))
        for s in range(4):
            part = F.shiftrightunsigned(rest, 12 * s).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((b * 4 + s) << 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


def links(distinct_fps: DataFrame, part: int = PART) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within RADIUS bits.

    Keys with more than ``part`` rows are cut into parts by the hash of the fingerprint and every
    two parts meet in a cell, so no task holds more than 2 x ``part`` rows of a key (up to the
    hash's evenness) and no pair is left out.
    """
    keyed = distinct_fps.select(F.explode(block_keys(F.col("fp"))).alias("key"), "fp")
    parts = F.ceil(F.col("n") / F.lit(part)).cast("int").alias("p")
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > part).select("key", parts)
    placed = keyed.join(large, "key", "left").withColumn("side", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("p")).cast("int"), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("p"), F.lit(1)) - 1)).alias("other")
    cells = placed.select("key", "fp", "side", other)
    cells = cells.select("key", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "fp")
    dealt = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(_links, "u bigint, v bigint")


def near_dup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """(doc_id, th, fp, root, component_id) per row of ``docs``; root names the group."""
    prints = settle(fingerprints(docs, id_col, text_col), "simhash")
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(own.select("fp"), part), "simhash-links")
    named = own.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = settle(named, "simhash-named")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # groups meet distinct fingerprints, not rows: a group with a third of all rows is small here
    labelled = named.join(groups, "root").select("fp", "root", "component_id")
    return prints.join(labelled, "fp").select("doc_id", "th", "fp", "root", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group (see ``common.keep_one``)."""
    return keep_one(docs, near_dup_groups(docs, id_col, text_col).select("doc_id", "th", "root"), id_col, text_col)
