"""Benchmark decontamination by SimHash windows of the size of each item.

Words are compared in lower case and without ASCII punctuation; shingles are SHINGLE words. For
each text:

1. Places whose shingle occurs in no item lie in no similar window by themselves: a window without a
   common shingle has similarity 0. All windows of an item's size around a common shingle are kept.
2. Their fingerprints (128 bits, shingles weighted by how often the window has them) come from
   running sums of the bits.
3. A multi-index over the items' fingerprints has one table for each of 16 blocks of 8 bits.
   Fingerprints within RADIUS = 40 bits differ by at most 2 bits in some block, so probing the 37
   values next to the window's block, in all 16 tables, finds every item within the radius.
4. Candidates are verified: multiset Jaccard similarity of the shingles, at least SIMILARITY.

At similarity 0.8 the expected distance of two fingerprints is 19 bits with a deviation of about 4,
so the radius leaves five deviations.

Items are read in blocks of at most ``block_bytes`` of text, which bounds what a task holds; a
benchmark of several blocks takes one pass over the texts for each. No row is shuffled.

Items of fewer than SHINGLE words have no shingle; they are found as exact runs of words anywhere in a text (by the
hashes of runs of their size, then word by word), with similarity 1 and the first place. ``drop_leaks`` drops no
text for such a run unless it is the whole text: one to four words are no evidence of a leak.

Defined results: NULL and empty texts and items match nothing; a text shorter than the item is one window;
items with one text each match; of equally similar windows of an item the first counts; repeated rows each get
their result; a very long text is read whole, its windows in blocks of 4096; without items no row is marked.
The output column replaces an input column of its name, all other columns pass through unread.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyforge.llm.common import gram_hashes, mixed, packed, rows_of, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 40
BLOCKS = 16
BLOCK_BYTES = 16 << 20

#: ASCII punctuation to spaces; other bytes stay.
PLAIN = bytes(32 if 33 <= c < 127 and not chr(c).isalnum() else c for c in range(256))
#: The 37 changes of a byte by at most RADIUS // BLOCKS bits.
NEAR = np.array([m for m in range(256) if m.bit_count() <= RADIUS // BLOCKS], dtype=np.uint8)
# Bits of the shingle filter.
FILTER = 1 << 20

LEAKS = "array<struct<item_id: bigint, similarity: double, start_word: int, n_words: int>>"


def plain_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(PLAIN).split() if text else []


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def shingles(words: list[bytes]) -> Counter:
    return Counter(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def bit_sums(grams: np.ndarray) -> np.ndarray:
    """Running sums of the 128 bits of each shingle (row i: over the first i shingles)."""
    two = np.stack([grams, mixed(grams + np.uint64(0x51ED270B))], axis=1)
    bits = np.unpackbits(two.view(np.uint8).reshape(len(grams), 16), axis=1)
    out = np.zeros((len(grams) + 1, 128), np.int32)
    np.cumsum(bits, axis=0, out=out[1:], dtype=np.int32)
    return out


def prints(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints (n x 16 bytes) of the windows of ``size`` shingles at ``start``."""
    return np.packbits(2 * (sums[start + size] - sums[start]) > size, axis=1)


@dataclass
class SizeIndex:
    """The items of one length: fingerprints and, for each block, their order by its value."""

    items: np.ndarray
    prints: np.ndarray
    order: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(items: list[int], fps: np.ndarray) -> SizeIndex:
        order = np.argsort(fps, axis=0, kind="stable").T
        offset = np.stack([np.searchsorted(fps[order[j], j], np.arange(257)) for j in range(BLOCKS)])
        return SizeIndex(np.array(items), fps, order, offset)

    def within_radius(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of the item) of all pairs within RADIUS bits, each once."""
        pairs = []
        for j in range(BLOCKS):
            value = (windows[:, j, None] ^ NEAR[None, :]).astype(np.int64)
            first, last = self.offset[j][value].ravel(), self.offset[j][value + 1].ravel()
            n = last - first
            w = np.repeat(np.repeat(np.arange(len(windows)), len(NEAR)), n)
            at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(w * len(self.items) + self.order[j][at])
        code = np.unique(np.concatenate(pairs))
        w, i = code // len(self.items), code % len(self.items)
        near = np.bitwise_count(windows[w] ^ self.prints[i]).sum(axis=1) <= RADIUS
        return w[near], i[near]


class Index:
    """All items of a block of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = []
        # size -> words -> items
        self.short: dict[int, dict[tuple[bytes, ...], list[int | None]]] = {}
        by_size: dict[int, list[int]] = {}
        fps, grams_of, where = [], [], []
        for key, text in items:
            words = plain_words(text)
            if not words:
                continue
            if len(words) < SHINGLE:
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(key)
                continue
            by_size.setdefault(len(words), []).append(len(self.items))
            g = gram_hashes(word_hashes(words), SHINGLE)
            fps.append(prints(bit_sums(g), np.array([0]), len(g))[0])
            grams_of.append(np.unique(g))
            where.append(len(words))
            self.items.append((key, shingles(words)))
        self.sizes = {n: SizeIndex.of(own, np.stack([fps[i] for i in own])) for n, own in by_size.items()}
        self.short_grams = {n: np.unique([gram_hashes(word_hashes(list(w)), n)[0] for w in own]) for n, own in self.short.items()}
        # shingle -> sizes of the items that have it
        every = np.concatenate(grams_of) if grams_of else np.zeros(0, np.uint64)
        size = np.repeat(np.array(where, dtype=np.int64), [len(g) for g in grams_of]) if grams_of else np.zeros(0, np.int64)
        order = np.lexsort((size, every))
        self.grams, self.gram_sizes = every[order], size[order]
        self.filter = np.zeros(FILTER, bool)
        self.filter[(self.grams % np.uint64(FILTER)).astype(np.int64)] = True

    def short_runs(self, words: list[bytes]) -> list[tuple[int | None, float, int, int]]:
        """(item, 1.0, first place, words) of the items below SHINGLE words."""
        out = []
        hashes = word_hashes(words) if self.short else None
        for n, own in sorted(self.short.items()):
            if len(words) < n:
                continue
            seen = set()
            for at in np.flatnonzero(np.isin(gram_hashes(hashes, n), self.short_grams[n])).tolist():
                run = tuple(words[at : at + n])
                if run not in seen:
                    seen.add(run)
                    out += [(k, 1.0, at, n) for k in own.get(run, ())]
        return out

    def leaks(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each similar item."""
        words = plain_words(text)
        out = self.short_runs(words)
        if len(words) < SHINGLE or not self.items:
            return out
        grams = gram_hashes(word_hashes(words), SHINGLE)
        hit = np.flatnonzero(self.filter[(grams % np.uint64(FILTER)).astype(np.int64)])
        first = np.searchsorted(self.grams, grams[hit], "left")
        last = np.searchsorted(self.grams, grams[hit], "right")
        hit, first, last = hit[last > first], first[last > first], last[last > first]
        if not len(hit):
            return out
        n = last - first
        place = np.repeat(hit, n)
        size = self.gram_sizes[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        sums = bit_sums(grams)
        best: dict[int, tuple[float, int, int]] = {}
        for length in np.unique(size).tolist():
            width = min(length, len(words)) - SHINGLE + 1
            # a mark for every window that holds one of the places
            p = np.unique(place[size == length])
            mark = np.zeros(len(grams) - width + 2, np.int32)
            np.add.at(mark, np.maximum(p - width + 1, 0), 1)
            np.add.at(mark, np.minimum(p, len(grams) - width) + 1, -1)
            start = np.flatnonzero(np.cumsum(mark) > 0)
            index = self.sizes[length]
            for at in range(0, len(start), 4096):
                some = start[at : at + 4096]
                for w, i in zip(*index.within_radius(prints(sums, some, width)), strict=True):
                    a, item = int(some[w]), int(index.items[i])
                    found = weighted_jaccard(shingles(words[a : a + width + SHINGLE - 1]), self.items[item][1])
                    if found >= SIMILARITY and found > best.get(item, (0.0,))[0]:
                        best[item] = (found, a, width + SHINGLE - 1)
        return out + [(self.items[i][0], *best[i]) for i in sorted(best)]


def _mark(items: list[tuple[int | None, str | None]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        names = ("item_id", "similarity", "start_word", "n_words")
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int32()), ("n_words", pa.int32())]))
        for b in rows_of(batches, 512):
            found = [[dict(zip(names, x, strict=True)) for x in index.leaks(t)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, kind)], names=["_row", "_leaks"])

    return run


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with an array of (item_id, similarity, start_word, n_words), one per similar item."""
    items = benchmark.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    columns = [c for c in (docs.columns if keep is None else keep) if c != out]
    done = docs.withColumn(out, F.lit(None).cast(LEAKS))
    part: Column = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for k in range(blocks):
        own = sorted(((r.id, r.text) for r in items.where(part == k).collect()), key=repr)
        has_text = [text_col] if text_col not in columns and k < blocks - 1 else []
        rows, schema = packed(done, [*columns, *has_text, out], F.col(text_col))
        rows = rows.mapInArrow(_mark(own), StructType([StructField("_row", schema), StructField("_leaks", _leak_type(docs))]))
        before = F.coalesce(F.col("_row")[out], F.array().cast(LEAKS))
        done = rows.select(*[F.col("_row")[c].alias(c) for c in [*columns, *has_text]], F.concat(before, "_leaks").alias(out))
    return done


def _leak_type(docs: DataFrame):
    return docs.sparkSession.range(0).select(F.lit(None).cast(LEAKS).alias("x")).schema["x"].dataType


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a similar item; an item below SHINGLE words counts only where it is the whole text."""
    marked = mark_leaks(docs, benchmark, text_col, out="_leaks", **options)
    long = F.exists("_leaks", lambda x: x["n_words"] >= SHINGLE)
    # the words of a text that short: its letters and digits between anything else
    plain = F.trim(F.regexp_replace(F.col(text_col), r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", " "))
    whole = F.exists("_leaks", lambda x: x["n_words"] == F.size(F.split(plain, " ")))
    return marked.where(~(long | whole)).select(*docs.columns)
