"""Shards of nearly equal size by sampled splitters.

Records are ordered by a key (the hash of the text, so equal texts are neighbours), then by a hash of the row:

1. One narrow pass writes (key, row hash, size) of every record; all planning reads this table, 20 bytes a record.
2. A sample of keys is drawn in which a record's chance grows with its size: OVERSAMPLE x RANGES
   keys in expectation, whatever the table's size.
3. Its quantiles are the splitters of RANGES ranges. A key that fills several quantiles becomes a
   range of its own.
4. Exact counts subdivide overfull ranges into cells: first by the key's place within the range, and what is still
   above ``cell_rows`` (copies of one text) by the hash of the row. So no task sorts more than about
   ``cell_rows`` records, unless fully equal rows are more than that: they share a cell.
5. The exact size before each cell places the cells on the line of all bytes. The slot at which a shard begins
   follows from the cells before it and from the records of the one cell in which it begins.
6. The wide rows are shuffled once, by cell. The size before a record within its cell places it on the line, and
   its midpoint decides the shard: shard sizes differ from the fair share by no more than the largest
   record, and a group of equal texts is cut only where a shard ends. No text is written but by the caller.

Defined results: a NULL or empty text has size 1; rows with a NULL id and repeated rows are records
like any other, each with its own slot (which of two fully equal rows gets which slot is open); an empty table
gives an empty result. Ties of the key are ordered by the hash of the row. Very long texts are records like any
other; only their size is summed. Shards may be empty if there are fewer records than shards. Output
columns replace carried columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle

RANGES = 256
OVERSAMPLE = 16
CELL_ROWS = 200_000
CHUNK = 32


def _range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below the key: first the chunk of splitters, then the place in it."""
    chunks = [splitters[i : i + CHUNK] for i in range(0, len(splitters), CHUNK)]
    if not chunks:
        return F.lit(0)
    bigints = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    below = lambda a: F.size(F.filter(a, lambda s: s <= key))
    chunk = below(bigints([c[0] for c in chunks]))
    own = F.element_at(F.array(*[bigints(c) for c in chunks]), F.greatest(chunk, F.lit(1)))
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * CHUNK + below(own))


def find_splitters(records: DataFrame, total: int, ranges: int = RANGES, seed: int = 1) -> list[int]:
    """At most 2 x ``ranges`` sorted splitters of ``records`` (_key, _h, size)."""
    if not total:
        return []
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_h", "_key"), 11).cast("double") / float(1 << 53)
    drawn = records.select("_key", F.floor(F.col("size") * (OVERSAMPLE * ranges / total) + u).alias("t")).where("t > 0")
    sample = sorted((r._key, r.t) for r in drawn.groupBy("_key").agg(F.sum("t").alias("t")).collect())
    goal, step, out = 0.0, sum(t for _, t in sample) / ranges, []
    run = 0
    for key, t in sample:
        run += t
        if run > goal + step:
            filled = int((run - goal) / step)
            # a key over two quantiles or more is a range of its own
            out += [key, key + 1] if filled > 1 and key < (1 << 63) - 1 else [key]
            goal += filled * step
    return sorted(set(out))


CELL = ["_range", "_sub", "_cell"]


def _placed(records: DataFrame, splitters: list[int], per_range: DataFrame, full: DataFrame) -> DataFrame:
    """``records`` (_key, _h) with their cell."""
    placed = records.withColumn("_range", _range_of(F.col("_key"), splitters)).join(F.broadcast(per_range), "_range")
    wide = F.greatest(F.col("_high").cast("double") - F.col("_low").cast("double"), F.lit(1.0))
    share = (F.col("_key").cast("double") - F.col("_low").cast("double")) / wide
    placed = placed.withColumn("_sub", F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1).cast("bigint")).drop("_low", "_high", "_parts")
    spot = F.coalesce(F.pmod(F.col("_h"), F.col("_copies")), F.lit(0).cast("bigint"))
    return placed.join(full, ["_range", "_sub"], "left").withColumn("_cell", spot).drop("_copies")


def _shard_of(middle: Column, total: int, shards: int) -> Column:
    """The shard of a point on the line, given as twice its place in bytes."""
    return F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(total, 1)))).cast("int")


def _run(placed: DataFrame) -> DataFrame:
    """Bytes and records of the cell before each record, as _b and _r."""
    own = Window.partitionBy(*CELL).orderBy("_key", "_h")
    return placed.withColumn("_r", F.row_number().over(own) - 1).withColumn("_b", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))


def first_slots(placed: DataFrame, starts: DataFrame, total: int, shards: int) -> list[int]:
    """The number of records before each shard; ``starts`` has the records and bytes before and in each cell."""
    low, high = _shard_of(2 * F.col("_b0") + 1, total, shards), _shard_of(2 * (F.col("_b0") + F.col("_bytes")) - 1, total, shards)
    cells = starts.withColumn("_low", low).withColumn("_high", high)
    whole = [F.coalesce(F.max(F.when(F.col("_high") < s, F.col("_r0") + F.col("_rows"))), F.lit(0)).alias(f"s{s}") for s in range(shards)]
    before = list(cells.agg(*whole).first())
    # at most one cell a shard is cut
    cut = F.broadcast(cells.where("_low < _high").select(*CELL, "_b0", "_r0"))
    inner = _run(placed.select(*CELL, "_key", "_h", "size").join(cut, CELL, "left_semi")).join(cut, CELL)
    inner = inner.select((F.col("_r0") + F.col("_r") + 1).alias("upto"), _shard_of(2 * (F.col("_b0") + F.col("_b")) + F.col("size"), total, shards).alias("shard"))
    found = {r["shard"]: r["upto"] for r in inner.groupBy("shard").agg(F.max("upto").alias("upto")).collect()}
    return [max([before[s], *(n for shard, n in found.items() if shard < s)]) for s in range(shards)]


def shard_records(docs: DataFrame, shards: int = 16, keep: list[str] | None = None, text_col: str = "text", ranges: int = RANGES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The columns ``keep`` of ``docs`` with size, text_crc32, law, shard, slot (from 0 in each shard) and grown_shard (NULL).

    ``docs`` is read twice: once for keys and sizes, once for the rows.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = [F.col(f"`{c}`") for c in keep if "map<" not in (kind := docs.schema[c].dataType.simpleString()) and "variant" not in kind]
    columns = [F.xxhash64(text).alias("_key"), F.xxhash64(F.lit(7), *hashed).alias("_h"), (F.octet_length(text) + 1).cast("bigint").alias("size")]
    records = settle(docs.select(*columns), "record-sizes")
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    splitters = find_splitters(records, total, ranges)

    # ranges and their cells, from exact counts; there are at most 2 x ranges + 1 ranges
    per_range = records.withColumn("_range", _range_of(F.col("_key"), splitters)).groupBy("_range").agg(
        F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.ceil(F.count("*") / F.lit(cell_rows)).alias("_parts")
    )
    per_range = settle(per_range, "ranges")
    none = records.sparkSession.createDataFrame([], "_range int, _sub bigint, _copies bigint")
    full = _placed(records, splitters, per_range, none).groupBy("_range", "_sub").agg(F.ceil(F.count("*") / F.lit(cell_rows)).alias("_copies"))
    full = settle(full.where("_copies > 1"), "full-ranges")
    placed = _placed(records, splitters, per_range, full)

    cells = settle(placed.groupBy(*CELL).agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")), "cells")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = [F.coalesce(F.sum(c).over(before), zero).alias(f"{c}_range") for c in ("_bytes", "_rows")]
    by_range = cells.groupBy("_range").agg(F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows")).select("_range", *sums)
    inner = Window.partitionBy("_range").orderBy("_sub", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(F.broadcast(by_range), "_range").select(
        *CELL,
        "_bytes",
        "_rows",
        (F.col("_bytes_range") + F.coalesce(F.sum("_bytes").over(inner), zero)).alias("_b0"),
        (F.col("_rows_range") + F.coalesce(F.sum("_rows").over(inner), zero)).alias("_r0"),
    )
    starts = settle(starts, "cell-starts")
    first = F.array(*[F.lit(n).cast("bigint") for n in first_slots(placed, starts, total, shards)])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.crc32(text.cast("binary")).alias("text_crc32"), *columns)
    line = _run(_placed(rows, splitters, per_range, full)).join(starts.select(*CELL, "_b0", "_r0"), CELL)
    shard = _shard_of(2 * (F.col("_b0") + F.col("_b")) + F.col("size"), total, shards)
    line = line.withColumn("shard", shard)
    return line.select(
        *[F.col("_row")[c].alias(c) for c in keep],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_r0") + F.col("_r") - F.get(first, F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
