"""Exact ranks and cut-offs in hash order without putting a class into one task."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import attach_row, small
from tallyforge.functions.hashing import hash_hex

# Leading md5 digits that name a bucket: bucket order is hash order, and a class of n rows
# leaves about n / 65536 rows per bucket.
BUCKET_DIGITS = 4


def _hashed(df: DataFrame, key: str, seed: object, digits: int) -> DataFrame:
    d = df.withColumn("_h", hash_hex(seed, key))
    return d.withColumn("_b", F.substring("_h", 1, digits))


def _buckets(d: DataFrame, cls: str, weight: Column) -> DataFrame:
    """(class, bucket) weights with the weight before each bucket and the class total."""
    upto = Window.partitionBy(cls).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.groupBy(cls, "_b")
        .agg(F.sum(weight).alias("_w"))
        .withColumn("_before", F.coalesce(F.sum("_w").over(upto), F.lit(0)))
        .withColumn("_total", F.sum("_w").over(Window.partitionBy(cls)))
    )


def hash_cutoffs(
    df: DataFrame,
    cls: str,
    key: str,
    goals: Callable[[Column], list[Column]],
    seed: object = 42,
    weight: str | None = None,
    rows: int | None = None,
    side: DataFrame | None = None,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Per class the last (hash, key) whose earlier rows weigh less than each goal.

    ``goals(total)`` gives rising goals; without ``weight`` a goal is a row count. Two narrow
    passes: bucket weights, then only the rows of the buckets in which a goal is reached, so
    the rows themselves are never shuffled and no task sorts a whole class. The result is
    class-sized: (cls, cuts) with one entry per goal above 0, in order. ``df`` is read twice here,
    so settle it first if it is the outcome of heavy work. ``rows`` bounds the
    number of classes, ``side`` may bring per-class columns for ``goals``.
    """
    w = F.col(weight) if weight else F.lit(1)
    d = _hashed(df, key, seed, digits)
    hist = _buckets(d, cls, w)
    if side is not None:
        hist = hist.join(small(side, rows), cls, "left")
    listed = F.array(*[g.cast("double") for g in goals(F.col("_total"))])
    goal = hist.select("*", F.posexplode(listed).alias("_i", "_goal"))
    # the bucket in which the running weight reaches the goal, or the last one
    after = F.col("_before") + F.col("_w")
    cut = goal.where(
        (F.col("_before") < F.col("_goal")) & ((F.col("_goal") <= after) | (after == F.col("_total")))
    ).select(cls, "_b", "_before", "_i", "_goal")
    narrow = d.select(cls, "_b", "_h", F.col(key).alias("_key"), w.alias("_w"))
    inside = Window.partitionBy(cls, "_i").orderBy("_h", "_key").rowsBetween(Window.unboundedPreceding, -1)
    n_goals = len(goals(F.lit(1)))
    last = (
        narrow.join(small(cut, None if rows is None else rows * n_goals), [cls, "_b"])
        .withColumn("_run", F.col("_before") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .where(F.col("_run") < F.col("_goal"))
        .groupBy(cls, "_i")
        .agg(F.max(F.struct("_h", "_key")).alias("_last"))
    )
    cuts = F.array_sort(F.collect_list(F.struct("_i", "_last")))
    return last.groupBy(cls).agg(F.transform(cuts, lambda c: c["_last"]).alias("cuts"))


def cutoff_number(df: DataFrame, cls: str, key: str, cutoffs: DataFrame, seed: object, rows: int | None, out: str) -> DataFrame:
    """Adds the number of cut-offs that lie before the row (NULL for a class without any), map-side."""
    here = F.struct(F.col("_h").alias("_h"), F.col(key).alias("_key"))
    marked = df.withColumn("_h", hash_hex(seed, key)).join(small(cutoffs, rows), cls, "left")
    return marked.withColumn(out, F.when(F.col("cuts").isNotNull(), F.size(F.filter("cuts", lambda c: c < here)))).drop("_h", "cuts")


def take_in_hash_order(
    df: DataFrame,
    cls: str | None,
    key: str,
    target: Callable[[Column], Column],
    seed: object = 42,
    weight: str | None = None,
    rows: int | None = None,
    side: DataFrame | None = None,
    out: str = "taken",
    cutoffs: DataFrame | None = None,
) -> DataFrame:
    """Mark, per class, rows in hash order while the weight of earlier rows is below the target.

    With no weight this takes the first ``target(n)`` rows of each class. Without ``cls`` all rows are one
    class, whose cut-off reaches the rows as a scalar.
    """
    if cls is None:
        cuts = hash_cutoffs(df.withColumn("_all", F.lit(1)), "_all", key, lambda n: [target(n)], seed, weight, 1)
        d = attach_row(df.withColumn("_h", hash_hex(seed, key)), cuts.select("cuts"))
        here = F.struct(F.col("_h").alias("_h"), F.col(key).alias("_key"))
        return d.withColumn(out, F.coalesce(F.size(F.filter("cuts", lambda c: c < here)) == 0, F.lit(False))).drop("_h", "cuts")
    if cutoffs is None:
        cutoffs = hash_cutoffs(df, cls, key, lambda n: [target(n)], seed, weight, rows, side)
    marked = cutoff_number(df, cls, key, cutoffs, seed, rows, out)
    return marked.withColumn(out, F.coalesce(F.col(out) == 0, F.lit(False)))


def hash_rank(
    df: DataFrame,
    cls: str,
    key: str,
    seed: object = 42,
    out: str = "rank",
    total: str | None = None,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Exact 1-based rank of each row in its class by hash order.

    Rows are shuffled by (class, bucket), so a class with a third of all rows spreads over
    all its buckets; bucket offsets come from the bucket counts.
    """
    d = _hashed(df, key, seed, digits)
    offsets = _buckets(d, cls, F.lit(1)).select(cls, "_b", "_before", "_total")
    local = F.row_number().over(Window.partitionBy(cls, "_b").orderBy("_h", key))
    ranked = d.withColumn("_local", local).join(offsets, [cls, "_b"])
    ranked = ranked.withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint"))
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_h", "_b", "_local", "_before", "_total")


def smallest_hashes(groups: DataFrame, k: int, draws: int, seeds: Sequence[object], weight: str = "n") -> DataFrame:
    """(seed, draw, grp, n): for each seed and draw the ``k`` groups with the smallest md5 of ``seed:draw:grp``.

    ``groups`` has one row per group (grp, n). A task keeps the k smallest of all draws while its groups stream
    by, so no row is repeated per draw and at most seeds x draws x k rows a task are shuffled.
    """
    listed = [str(s) for s in seeds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [[hashlib.md5(f"{s}:{d}".encode()) for d in range(draws)] for s in listed]
        # per seed and draw a heap of the k smallest, the greatest of them on top
        kept: list[list[list[tuple[int, int]]]] = [[[] for _ in range(draws)] for _ in listed]
        own: dict[int, tuple[str | None, int]] = {}
        used: dict[int, int] = {}
        at = 0
        for b in batches:
            for grp, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tail = b"" if grp is None else b":" + grp.encode()
                at += 1
                for row, heaps in zip(starts, kept, strict=True):
                    for start, heap in zip(row, heaps, strict=True):
                        h = start.copy()
                        h.update(tail)
                        value = -int.from_bytes(h.digest(), "big")
                        if len(heap) == k:
                            if value < heap[0][0]:
                                continue
                            old = heapq.heapreplace(heap, (value, at))[1]
                            used[old] -= 1
                            if not used[old]:
                                del used[old], own[old]
                        else:
                            heapq.heappush(heap, (value, at))
                        used[at] = used.get(at, 0) + 1
                        own[at] = (grp, n)
        rows = [(s, d, f"{-v:032x}", *own[i]) for s, heaps in zip(listed, kept, strict=True) for d, heap in enumerate(heaps) for v, i in heap]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["seed", "draw", "h", "grp", "n"])

    part = groups.select(F.col("grp").cast("string").alias("grp"), F.col(weight).cast("bigint").alias("n")).mapInArrow(run, "seed string, draw int, h string, grp string, n bigint")
    order = Window.partitionBy("seed", "draw").orderBy("h", "grp")
    return part.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r", "h")


class RankIndex:
    """The rows of each class in hash order, addressable by rank without sorting or moving the rows.

    The index is the number of rows before each bucket, in two levels of 256: per class the starts of its leading
    digits, per (class, leading digits) the starts of its buckets. It has at most 65,536 entries a class,
    whatever the table holds, and comes from one narrow scan. A rank leads to its bucket; only the rows of
    the buckets that are asked for are read on and sorted.
    """

    def __init__(self, df: DataFrame, cls: str, key: str, seed: object = 42, rows: int | None = None):
        self.df, self.cls, self.key, self.seed, self.rows = df, cls, key, seed, rows
        half = BUCKET_DIGITS // 2
        self.buckets = _buckets(_hashed(df, key, seed, BUCKET_DIGITS), cls, F.lit(1)).withColumn("_c", F.substring("_b", 1, half))
        starts = F.sort_array(F.collect_list(F.struct("_before", "_b")))
        self.fine = self.buckets.groupBy(cls, "_c").agg(starts.alias("_fine"), F.min("_before").alias("_first"))
        self.coarse = self.fine.groupBy(cls).agg(F.sort_array(F.collect_list(F.struct("_first", "_c"))).alias("_coarse"))

    def numbers(self, out: str) -> DataFrame:
        """One row per row of the table, numbered from 0 without gaps; the numbers come from the bucket counts alone."""
        totals = self.buckets.groupBy(self.cls).agg(F.max("_total").alias("_n"))
        # one row per class
        ahead = Window.orderBy(self.cls).rowsBetween(Window.unboundedPreceding, -1)
        base = totals.withColumn("_base", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        b = self.buckets.join(small(base, self.rows), self.buckets[self.cls].eqNullSafe(base[self.cls]))
        low = F.col("_base") + F.col("_before")
        return b.select(F.explode(F.sequence(low, low + F.col("_w") - 1)).alias(out))

    def rows_at(self, draws: DataFrame, rank: str) -> DataFrame:
        """``draws`` (with the class and a 1-based rank in it) with the columns of the row at that rank."""
        cls = self.cls
        last = lambda entries, field: F.element_at(F.filter(entries, lambda e: e[field] < F.col(rank)), -1)
        d = draws.join(small(self.coarse, self.rows), cls).withColumn("_c", last("_coarse", "_first")["_c"]).drop("_coarse")
        fine = small(self.fine.drop("_first"), None if self.rows is None else 256 * self.rows)
        d = d.join(fine, [cls, "_c"]).withColumn("_at", last("_fine", "_before"))
        d = d.select(*draws.columns, F.col("_at._b").alias("_b"), (F.col(rank) - F.col("_at._before")).alias("_local"))
        asked = d.select(cls, "_b").distinct()
        rows = _hashed(self.df, self.key, self.seed, BUCKET_DIGITS).join(asked, [cls, "_b"], "left_semi")
        place = F.row_number().over(Window.partitionBy(cls, "_b").orderBy("_h", self.key))
        rows = rows.withColumn("_local", place).drop("_h")
        return d.join(rows, [cls, "_b", "_local"]).drop("_b", "_local")
