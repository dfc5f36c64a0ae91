"""Periodic runs: stretches of a text that repeat one phrase over and over, found by seeds and diagonals.

A run with smallest period q is a stretch of at least max(LEAST, TIMES * q) words in which words q apart are
identical, and which no neighbouring word extends. On the diagonal of lag q it matches over its length less
q: at least 5 words for q = 1, 6 for q = 2, and 3 q in general. For one text:

1. *Seeds.* The lags are taken in classes [2**j, 2**(j+1)). All runs of a class match over k = max(5, 3 * 2**j)
   words or more, so the k-grams are indexed. As k >= q, two places of one k-gram within a run of smallest
   period q are a multiple of q apart (a shorter step would make the phrase a power of a shorter one).
   So the pairs of *neighbouring* places of a k-gram that lie a lag of the class apart hold a seed of every run:
   no pairs of all places are needed, and a phrase that stands ten thousand times gives ten thousand pairs.
   Grams are numbered exactly, by doubling the numbers of shorter grams; a class whose shorter half
   never recurs ends the search, which is after one or two classes for ordinary prose.
2. *Extend.* A seed is extended both ways along its diagonal. The table of the furthest covered place per lag
   skips the seeds that an earlier extension has passed over.
3. A stretch found at several lags keeps the smallest: it has the same bounds, as it has all these periods.

Texts are independent, so rows are only mapped, never shuffled, and one text costs about n log n. A text
of any length is one row: it is read whole, by one task.

Defined results: NULL and texts without a word have no runs and collapse to the empty text; ties are
ordered by start, then period; repeated rows repeat their results; an empty table gives an empty result.
Columns of any name are carried, added ones replace carried ones of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from tallyforge.llm.common import packed, rows_of, word_array, words_of

LEAST = 6
TIMES = 4
RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())


def _numbered(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Equal pairs get equal numbers."""
    both = one * (int(two.max()) + 1) + two
    return np.unique(both, return_inverse=True)[1]


def _reach(x: np.ndarray, i: int, lag: int) -> int:
    """The first place from ``i`` on where words ``lag`` apart differ (or the end)."""
    end, step = len(x) - lag, 32
    while i < end:
        stop = min(i + step, end)
        differ = np.flatnonzero(x[i:stop] != x[i + lag : stop + lag])
        if len(differ):
            return i + int(differ[0])
        i, step = stop, 2 * step
    return end


def _back(x: np.ndarray, i: int, lag: int) -> int:
    """The last place down from ``i`` up to which words ``lag`` apart are all the same."""
    step = 32
    while i > 0:
        low = max(0, i - step)
        differ = np.flatnonzero(x[low:i] != x[low + lag : i + lag])
        if len(differ):
            return low + int(differ[-1]) + 1
        i, step = low, 2 * step
    return 0


def seeds(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, lag) of neighbouring places of the indexed grams, class by class."""
    short, size, j = x, 1, 0  # short numbers the grams of ``size`` = 2**j words
    while TIMES * size <= len(x):
        k = LEAST - 1 if j == 0 else (TIMES - 1) * size
        twice = _numbered(short[:-size], short[size:])
        if k > len(x) - size:
            return
        if j == 0:
            four = _numbered(twice[:-2], twice[2:])
            grams = _numbered(four[:-1], x[4:])
        else:
            grams = _numbered(twice[: len(x) - k + 1], short[2 * size : 2 * size + len(x) - k + 1])
        order = np.argsort(grams, kind="stable")
        lag = np.diff(order)
        near = (np.diff(grams[order]) == 0) & (lag >= size) & (lag < 2 * size)
        place = order[:-1][near]
        first = np.argsort(place, kind="stable")
        yield from zip(place[first].tolist(), lag[near][first].tolist(), strict=True)
        if int(twice.max()) + 1 == len(twice):
            return  # no gram of 2 * size words recurs, so no longer one does
        short, size, j = twice, 2 * size, j + 1


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    if len(words) < LEAST:
        return []
    number: dict[bytes, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in words])
    if len(number) == len(x):
        return []
    covered: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    for i, lag in seeds(x):
        if i < covered.get(lag, 0):
            continue
        start, end = _back(x, i, lag), _reach(x, i, lag)
        covered[lag] = end
        length = end + lag - start
        if length >= max(LEAST, TIMES * lag):
            found[start, length] = min(lag, found.get((start, length), lag))
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    off = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        off[start + period] += 1
        off[start + length] -= 1
    return b" ".join(w for w, x in zip(words, np.cumsum(off).tolist(), strict=False) if not x)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in rows_of(batches, 512):
        runs, kept = [], []
        for t in b.column(1).to_pylist():
            words = words_of(t)
            own = find_runs(words)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            kept.append(collapse(words, own))
        yield pa.record_batch([b.column(0), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["_row", "runs", "collapsed"])


def mark_runs(docs: DataFrame, text: Column, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all) columns of ``docs`` with ``runs`` (array of start, length, period) and ``collapsed``, the text without repeats."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("runs", "collapsed")]
    rows, own = packed(docs, keep, text.cast("binary"))
    done = rows.mapInArrow(_find, StructType().add("_row", own).add("runs", ArrayType(RUN)).add("collapsed", BinaryType()))
    return done.select(*[F.col("_row")[c].alias(c) for c in keep], "runs", F.decode("collapsed", "UTF-8").alias("collapsed"))


def longest(runs: Column) -> Column:
    """The run of the greatest length; ties: smallest start, then period. NULL if there is none."""
    rank = lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))
    best = F.array_min(F.transform(runs, rank))
    return F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period"))


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The words of a text joined by one space; every tenth text (by the crc32 of its id) repeats a phrase from word a on."""
    words = word_array(text)
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    period = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    phrase = F.slice(words, a + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(phrase, F.ceil((n - a) / period).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)
