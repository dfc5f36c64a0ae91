"""Leak-free splits, folds and their checks; order comes from hashes, never from a generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, attach_row, small
from tallyforge.functions.ranking import cutoff_number, hash_cutoffs, hash_rank, smallest_hashes, take_in_hash_order


def val_quota(n: Column, frac: float = 0.2) -> Column:
    """Validation rows of a class with n rows: half-even share from 5 rows on, 1 for 2-4, else 0."""
    return (
        F.when(n >= 5, F.bround(F.lit(float(frac)) * n))
        .when(n >= 2, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def split_cutoffs(df: DataFrame, cls: str, key: str, seed: int = 42, frac: float = 0.2, rows: int | None = None) -> DataFrame:
    """The split as data: one hash cut-off per class. Worth settling when the split is used often."""
    return hash_cutoffs(df, cls, key, lambda n: [val_quota(n, frac)], seed, rows=rows)


def stratified_split(
    df: DataFrame, cls: str, key: str, seed: int | Column = 42, frac: float = 0.2, rows: int | None = None, cutoffs: DataFrame | None = None
) -> DataFrame:
    """Adds ``split`` (train / val), per class, exact sizes. ``rows`` bounds the class count."""
    marked = take_in_hash_order(df, cls, key, lambda n: val_quota(n, frac), seed, rows=rows, out="_val", cutoffs=cutoffs)
    return marked.withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def group_holdout_draws(
    df: DataFrame, grp: str, k: int = 4, draws: int = 200, target: float = 0.2, seeds: Sequence[object] = (42,)
) -> DataFrame:
    """(seed, grp, draw, held, total): for each seed the k groups of the draw whose row share is closest to the target.

    Every draw takes the k groups with the smallest hash; the first draw wins ties. All draws of all seeds
    share one aggregation of the group sizes (``smallest_hashes``).
    """
    sizes = df.groupBy(F.col(grp).alias("grp")).agg(F.count("*").alias("n"))
    picked = smallest_hashes(sizes, k, draws, seeds)
    # seeds x draws x k rows from here on
    total = sizes.agg(F.sum("n").alias("total"))
    per_draw = picked.groupBy("seed", "draw").agg(F.sum("n").alias("held"), F.collect_list(F.struct("grp")).alias("groups"))
    best = attach_row(per_draw, total).groupBy("seed").agg(
        F.min_by(
            F.struct("draw", "groups", "held", "total"),
            F.struct(F.abs(F.col("held") / F.col("total") - F.lit(target)), F.col("draw")),
        ).alias("_b")
    )
    out = best.select(
        "seed", F.explode("_b.groups.grp").alias("grp"), F.col("_b.draw").alias("draw"),
        F.col("_b.held").alias("held"), F.col("_b.total").alias("total"),
    )
    return out.withColumn("grp", F.col("grp").cast(df.schema[grp].dataType))


def group_holdout_groups(
    df: DataFrame, grp: str, k: int = 4, draws: int = 200, target: float = 0.2, seed: int = 42
) -> DataFrame:
    """The k groups of the seeded draw whose row share is closest to the target; first draw wins."""
    return group_holdout_draws(df, grp, k, draws, target, (seed,)).drop("seed")


def group_holdout_split(
    df: DataFrame, grp: str, k: int = 4, draws: int = 200, target: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``doc_split``: rows of the held-out groups are val."""
    held = group_holdout_groups(df, grp, k, draws, target, seed).select(
        F.col("grp").alias(grp), F.lit("val").alias("doc_split")
    )
    return df.join(small(held, k), grp, "left").withColumn(
        "doc_split", F.coalesce("doc_split", F.lit("train"))
    )


def group_fraction_holdout(
    df: DataFrame, kind: str | None, grp: str, frac: float = 0.15, seed: int = 42, kinds: int | None = None
) -> DataFrame:
    """Groups of each kind (None: all are one kind) in hash order, taken whole until ``frac`` of the kind's rows is held.

    Returns one row per group with its size and ``held``.
    """
    sizes = df.groupBy(*([kind] if kind else []), grp).agg(F.count("*").alias("n"))
    return take_in_hash_order(
        sizes, kind, grp, lambda total: F.lit(frac) * total, seed, weight="n", rows=kinds, out="held"
    )


def holdout_checks(df: DataFrame, held: str, grp: str, cls: str, classes: Classes, thin: int = 30, weight: str | None = None) -> DataFrame:
    """Per class: rows on both sides of ``held`` and a status; plus the number of groups on both sides.

    status: probe_only (untrainable), absent (no probe row), thin (< thin probe rows), ok. ``df`` may have one row per
    (group, class) with the number of its rows as ``weight``: a group with very many rows is then one row before any join.
    """
    n = F.col(weight) if weight else F.lit(1)
    side = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")
    counts = df.groupBy(F.col(cls).alias("class")).agg(side(~F.col(held)).alias("n_train"), side(F.col(held)).alias("n_probe"))
    sides = df.groupBy(grp).agg(F.max(held).alias("p"), F.max(~F.col(held)).alias("t"))
    leaks = sides.agg(F.count_if(F.col("p") & F.col("t")).alias("leaked_groups"))
    table = classes.side.select("class").join(counts, "class", "left")
    table = attach_row(table, leaks)
    n_train = F.coalesce("n_train", F.lit(0))
    n_probe = F.coalesce("n_probe", F.lit(0))
    return table.select(
        "class",
        n_train.alias("n_train"),
        n_probe.alias("n_probe"),
        F.when((n_probe > 0) & (n_train == 0), "probe_only")
        .when(n_probe == 0, "absent")
        .when(n_probe < thin, "thin")
        .otherwise("ok")
        .alias("status"),
        "leaked_groups",
    )


def seeded_splits(
    df: DataFrame, cls: str, key: str, grp: str, seeds: Sequence[int] = (42, 0, 1), rows: int | None = None, k: int = 4
) -> DataFrame:
    """Both split kinds for several seeds: one row per (seed, item). All seeds share each pass."""
    d = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    d = d.withColumn("_sc", F.concat_ws(":", "seed", cls))
    cuts = hash_cutoffs(d, "_sc", key, lambda n: [val_quota(n)], F.col("seed"), rows=None if rows is None else rows * len(seeds))
    d = stratified_split(d, "_sc", key, F.col("seed"), rows=None if rows is None else rows * len(seeds), cutoffs=cuts).drop("_sc")
    held = group_holdout_draws(df, grp, k, seeds=seeds).select(F.col("seed").cast(d.schema["seed"].dataType).alias("seed"), F.col("grp").alias(grp), F.lit("val").alias("doc_split"))
    out = d.join(small(held, k * len(seeds)), ["seed", grp], "left")
    return out.withColumn("doc_split", F.coalesce("doc_split", F.lit("train")))


def kfold(df: DataFrame, cls: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``: position in the class's hash order modulo k."""
    ranked = hash_rank(df, cls, key, seed, out="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def range_folds(df: DataFrame, cls: str, key: str, k: int = 5, seed: int = 42, rows: int | None = None, cutoffs: DataFrame | None = None) -> DataFrame:
    """Adds ``fold``: k runs of the class's hash order, as long as the folds of ``kfold``.

    The fold of a row follows from k - 1 cut-offs per class, so wide rows stay where they are.
    """
    cuts = cutoffs if cutoffs is not None else fold_cutoffs(df, cls, key, k, seed, rows)
    d = cutoff_number(df, cls, key, cuts, seed, rows, "fold")
    return d.withColumn("fold", F.coalesce("fold", F.lit(0)))


def fold_cutoffs(df: DataFrame, cls: str, key: str, k: int = 5, seed: int = 42, rows: int | None = None) -> DataFrame:
    """Cut-offs after fold 0 .. k-2; the first n mod k folds have one row more."""
    each = lambda n: F.floor(n / k)
    goals = lambda n: [(f + 1) * each(n) + F.least(n - k * each(n), F.lit(f + 1)) for f in range(k - 1)]
    return hash_cutoffs(df, cls, key, goals, seed, rows=rows)


def kfold_table(folded: DataFrame, cls: str, k: int = 5) -> DataFrame:
    """Per class: rows, rows per fold, and whether the class is smaller than k."""
    return folded.groupBy(F.col(cls).alias("class")).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("fold") == f).alias(f"fold{f}") for f in range(k)],
        (F.count("*") < k).alias("too_small"),
    )


def split_overlap_check(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Keys found on both sides of each split column (0 everywhere for a sound split)."""
    sides = df.select(
        F.col(key).alias("key"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("split_kind"), F.col(c).alias("side")) for c in cols])),
    )
    per_key = sides.groupBy("split_kind", "key").agg(
        F.max((F.col("side") == "train").cast("int")).alias("t"),
        F.max((F.col("side") == "val").cast("int")).alias("v"),
    )
    return per_key.groupBy("split_kind").agg(
        F.sum(F.col("t") * F.col("v")).alias("n_both"),
        F.sum("t").alias("n_train"),
        F.sum("v").alias("n_val"),
    )


def split_table(df: DataFrame, classes: Classes, cls: str = "class") -> DataFrame:
    """Per class: n_clean and the sizes of both split kinds; zero_val flags classes without val rows."""
    agg = df.groupBy(F.col(cls).alias("class")).agg(
        F.count("*").alias("n_clean"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "val").alias("n_val"),
        F.count_if(F.col("doc_split") == "train").alias("n_doc_train"),
        F.count_if(F.col("doc_split") == "val").alias("n_doc_val"),
    )
    cols = ["n_clean", "n_train", "n_val", "n_doc_train", "n_doc_val"]
    full = classes.side.select("class").join(agg, "class", "left").fillna(0, cols)
    return full.withColumn("zero_val", F.col("n_val") == 0)
