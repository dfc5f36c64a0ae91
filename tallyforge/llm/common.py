"""What the operators of this package share: word rules, row keys, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.functions.bounds import settle, small

# White space that separates words, as characters and as a pattern: \x20 and \x09 to \x0D.
SPACE = " \t\n\u000b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"

#: A-Z to a-z on UTF-8 bytes; other characters stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: bytes.split() cuts at exactly \\x20 and \\x09 to \\x0D."""
    return text.split() if text else []


def word_array(text: Column) -> Column:
    """Words of a text as an array; NULL gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def id_part(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def text_digest(text: Column) -> Column:
    """32 bytes that stand for the text (NULL: those of no text at all)."""
    return F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.unhex(F.lit("00")))


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most``, so that Python holds few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


# Edges that one task thins out at a time.
EDGES = 500_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v): edges that connect what the task's edges connect, a forest of at most EDGES of them at a time."""
    held: list[np.ndarray] = []
    size = 0

    def reduced() -> np.ndarray:
        both = np.concatenate(held, axis=1)
        nodes, place = np.unique(both, return_inverse=True)
        left, right = place.reshape(both.shape)
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[left], label[right])
            new = label.copy()
            for ends in (left, right, label[left], label[right]):
                np.minimum.at(new, ends, low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return np.stack([nodes[moved], nodes[label[moved]]])

    out = lambda e: pa.record_batch([pa.array(e[0]), pa.array(e[1])], names=["u", "v"])
    for b in rows_of(batches, EDGES // 4):
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
        size += b.num_rows
        if size >= EDGES:
            held = [reduced()]
            size = held[0].shape[1]
            if 2 * size > EDGES:
                yield out(held[0])
                held, size = [], 0
    if size:
        yield out(reduced())


def thinned(edges: DataFrame, name: str) -> DataFrame:
    """Edges (u, v) with the same components: each task keeps a forest of its edges, at most one edge per node.

    Edges are written first, then dealt to tasks of about EDGES; up to that many, one forest is all that is left.
    """
    now = settle(edges.where("u <> v").select("u", "v").distinct(), name)
    n = now.count()
    return now.coalesce(max(1, -(-n // EDGES))).mapInArrow(_forests, "u bigint, v bigint")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: bigint); root is the least node reachable.

    Large-star and small-star rounds: each is a few aggregations with map-side combine and joins
    that the adaptive planner may split, so neither a large component nor a node with very many
    neighbours meets in one task, and the number of rounds grows with the logarithm of the
    longest chain. Each round is a table in the shared folder. Empty edges give an empty table.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = settle(pairs.distinct(), name)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is smaller than all its neighbours stays attached through their rows
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        up = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = small.select("u", F.col("m").alias("v"))
        now = settle(up.unionByName(own).distinct(), name)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def packed(df: DataFrame, columns: list[str], *inputs: Column) -> tuple[DataFrame, StructType]:
    """``df`` as (_row: struct of ``columns``, _0, _1 ...): rows travel whole through a batch function, so
    input columns of any name can neither clash with its own nor need a join afterwards.
    """
    own = df.select(*columns).schema
    return df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), *[x.alias(f"_{i}") for i, x in enumerate(inputs)]), own


#: Odd multipliers for the places of a phrase.
PLACES = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(32)], dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype="<u8")


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, from the hashes of the words."""
    n = max(len(h) - size + 1, 0)
    g = h[:n] * PLACES[0]
    for i in range(1, size):
        g += h[i : i + n] * PLACES[i]
    return mixed(g)


def _same(id_col: str, text_col: str) -> Column:
    return F.col(id_col).cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_th"))


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group (doc_id, th, root): the one with the smallest id (NULL ids last).

    Of fully repeated rows (same id, same text) one stays. The rows that go are what is joined to the documents: they
    are fewer than those that stay, and up to the bound of ``small`` no document is shuffled for them.
    """
    keys = settle(groups.groupBy("doc_id", "th").agg(F.min("root").alias("root"), F.count("*").alias("n")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best")
    best = keys.groupBy("root").agg(first).select(F.col("root").alias("_root"), F.col("best.doc_id").alias("_best"), F.col("best.th").alias("_th0"))
    told = keys.join(best, keys["root"] == best["_root"])
    stays = F.col("doc_id").eqNullSafe(F.col("_best")) & (F.col("th") == F.col("_th0"))
    # of a row that stays and is repeated, only one: its rows are taken out here and come back once
    out = settle(told.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), stays.alias("_again")), "leaving")
    n, again = out.agg(F.count("*"), F.count_if("_again")).first()
    rest = docs.join(small(out.drop("_again"), n), _same(id_col, text_col), "left_anti")
    if not again:
        return rest
    once = docs.join(small(out.where("_again").drop("_again"), again), _same(id_col, text_col), "left_semi")
    return rest.unionByName(once.dropDuplicates([id_col, text_col]))
