"""Manifest, ordered cleaning rules, existence filter and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes
from tallyforge.functions.skew import join_keyed

# The cleaning rules in the order in which they are applied.
RULES = ("unreadable", "copy", "cross_class", "within_dup", "kept")


def manifest(
    df: DataFrame,
    key: str,
    cls: str,
    grp: str,
    content: str,
    ok: Column | None = None,
    is_copy: Column | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per item: key, class, group, md5, bytes, ok, is_copy.

    The hash of unreadable content is NULL, so unreadable items never look like duplicates.
    """
    readable = F.col(content).isNotNull() & (F.octet_length(content) > 0)
    return df.select(
        F.col(key).alias("key"),
        F.col(cls).alias("class"),
        F.col(grp).alias("group"),
        F.md5(content).alias("md5"),
        F.octet_length(content).cast("bigint").alias("bytes"),
        (readable if ok is None else readable & ok).alias("ok"),
        (F.lit(False) if is_copy is None else is_copy).alias("is_copy"),
        *extra,
    )


def _per_hash(m: DataFrame) -> DataFrame:
    """One row per hash, by partial aggregation: a hash with any number of copies is fine."""
    alive = F.col("ok") & ~F.col("is_copy")
    return m.groupBy("md5").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("ok")).alias("n_unreadable"),
        F.count_if(F.col("ok") & F.col("is_copy")).alias("n_copy"),
        F.count_if(alive).alias("n_alive"),
        F.min("class").alias("class"),
        # conflicts are judged on the raw rows, before any other rule
        (F.col("md5").isNotNull() & (F.min("class") != F.max("class"))).alias("cross"),
        F.min(F.when(alive, F.struct("key", "group", "bytes"))).alias("first"),
    )


def clean_index(m: DataFrame, classes: Classes) -> DataFrame:
    """Rows that pass all rules: readable, not a copy, hash in one class only, first key per hash.

    A hash that lies in one class only has exactly one surviving row, so the whole index falls
    out of one aggregation by hash; no row is joined back.
    """
    kept = _per_hash(m).where(F.col("first").isNotNull() & ~F.coalesce("cross", F.lit(False)))
    kept = kept.select(
        F.col("first.key").alias("key"),
        "class",
        F.col("first.group").alias("group"),
        "md5",
        F.col("first.bytes").alias("bytes"),
    )
    return kept.join(classes.side, "class").select("key", "class", "label", "group", "md5", "bytes")


def cleaning_ledger(m: DataFrame, classes: Classes | None = None) -> DataFrame:
    """Rows lost to each rule (first failing rule wins), rows kept, in one pass.

    With the class universe (it must hold every class of the manifest) classes are compared as
    labels: the aggregation then has fixed-width buffers and needs no sort.
    """
    if classes is not None:
        m = m.join(classes.side, "class", "left").withColumn("class", F.col("label"))
    cross = F.coalesce("cross", F.lit(False))
    one = F.when(~cross & (F.col("n_alive") > 0), 1).otherwise(0)
    sums = _per_hash(m).agg(
        F.sum("n_unreadable").alias("unreadable"),
        F.sum("n_copy").alias("copy"),
        F.sum(F.when(cross, F.col("n_alive")).otherwise(0)).alias("cross_class"),
        F.sum(F.when(one == 1, F.col("n_alive") - 1).otherwise(0)).alias("within_dup"),
        F.sum(one).alias("kept"),
    )
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(r, F.lit(0)).cast("bigint").alias("n")) for r in RULES])
    rows = sums.select(F.inline(pairs))
    return rows


def existence_marks(idx: DataFrame, listing: DataFrame, key: str, on: str, out: str = "present") -> DataFrame:
    """Every row of an index with ``out``: whether the listing has its key. One join, one scan per side; a NULL key is absent."""
    have = listing.select(F.col(on).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(out, F.lit(True))
    return idx.join(have, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def existence_filter(idx: DataFrame, listing: DataFrame, key: str, on: str) -> tuple[DataFrame, DataFrame]:
    """(present, absent) rows of an index against a listing of stored items; ``existence_marks`` gives both in one pass."""
    marked = existence_marks(idx, listing, key, on, "_present")
    return marked.where("_present").drop("_present"), marked.where("not _present").drop("_present")


def reconcile_manifest(m: DataFrame, candidates: DataFrame) -> DataFrame:
    """Match manifest rows (key, name, md5) to candidate files (path, name, md5).

    One candidate of the name: take it. Several: the one with the right hash, else the first
    path. None: missing. Candidates are reduced per name and per (name, hash) before the
    joins, so a name shared by many files never meets the manifest pairwise.
    """
    exact = candidates.groupBy("name", "md5").agg(F.min("path").alias("exact_path"), F.count("*").alias("_n"))
    # from the same aggregation, so the candidates are read once
    by_name = exact.groupBy("name").agg(F.sum("_n").alias("n_candidates"), F.min(F.struct(F.col("exact_path").alias("path"), "md5")).alias("first"))
    exact = exact.drop("_n")
    named = join_keyed(m.select("key", "name", "md5"), by_name, ["name"], "key", "left")
    return (
        join_keyed(named, exact, ["name", "md5"], "key", "left")
        .select(
            "key",
            "name",
            F.coalesce("n_candidates", F.lit(0)).cast("bigint").alias("n_candidates"),
            F.coalesce("exact_path", "first.path").alias("path"),
            F.coalesce(F.col("exact_path").isNotNull(), F.lit(False)).alias("verified"),
        )
        .withColumn(
            "status",
            F.when(F.col("path").isNull(), "missing")
            .when(F.col("verified"), "verified")
            .otherwise("mismatch"),
        )
    )
