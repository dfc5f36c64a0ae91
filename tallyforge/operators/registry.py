"""Queries over tables of runs and their epoch logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import attach_row, small


def leaderboard(
    exp: DataFrame, prefix: str | None = None, contains: str | None = None, split_kind: str | None = None, short: Column | None = None
) -> DataFrame:
    """Runs that fit the filters, best balanced accuracy first, with a rank and a short name."""
    d = exp
    if prefix:
        d = d.where(F.col("exp_id").startswith(prefix))
    if contains:
        d = d.where(F.col("exp_id").contains(contains))
    if split_kind:
        d = d.where(F.col("split_kind") == split_kind)
    d = d.withColumn("short", F.col("exp_id") if short is None else short)
    # a table of runs: one row per run, ordered as a whole
    order = Window.orderBy(F.desc_nulls_last("balanced_acc"), "exp_id")
    return d.withColumn("rank", F.row_number().over(order))


def pair_split_gap(exp: DataFrame, metrics: Sequence[str] = ("top1", "balanced_acc")) -> DataFrame:
    """Runs X_doc next to X_T4: both values and their gap in points."""
    base = F.regexp_replace("exp_id", r"_(doc|T4)$", "")
    side = lambda suffix, tag: exp.where(F.col("exp_id").endswith(suffix)).select(
        base.alias("base"), *[F.col(m).alias(f"{m}_{tag}") for m in metrics]
    )
    both = side("_doc", "doc").join(side("_T4", "strat"), "base")
    return both.select("*", *[(100 * (F.col(f"{m}_doc") - F.col(f"{m}_strat"))).alias(f"{m}_gap") for m in metrics])


def grid_runs(exp: DataFrame, rows: DataFrame, row_col: str, col_col: str, cols: Sequence[str], prefer: Column, value: str) -> DataFrame:
    """One preferred run per cell of (row dimension x column dimension), empty cells NULL.

    ``rows`` lists the row dimension; ``prefer`` orders the runs of a cell (lower first).
    """
    best = exp.withColumn("_p", prefer).groupBy(row_col, col_col).agg(
        F.min_by(F.struct(F.col(value).alias("v"), F.col("exp_id").alias("id")), F.struct("_p", "exp_id")).alias("_b")
    )
    cells = best.select(row_col, F.col(col_col).cast("string").alias("_c"), F.col("_b.v").alias("v"))
    wide = cells.groupBy(row_col).pivot("_c", list(cols)).agg(F.first("v"))
    return rows.join(wide, row_col, "left")


def delta_vs_baseline(exp: DataFrame, baseline: str, metrics: Sequence[str] = ("top1", "balanced_acc")) -> DataFrame:
    """Each run's metrics minus those of one run, in points."""
    base = exp.where(F.col("exp_id") == baseline).select(*[F.col(m).alias(f"_{m}") for m in metrics]).limit(1)
    d = attach_row(exp, base)
    return d.select("exp_id", *[(100 * (F.col(m) - F.col(f"_{m}"))).alias(f"delta_{m}") for m in metrics])


def best_epoch(log: DataFrame, metric: str = "val_bal_acc", ema: str = "ema_val_bal_acc") -> DataFrame:
    """Best epoch per run: a later one must be strictly better; raw goes before averaged weights."""
    cand = log.select(
        "exp_id", "epoch",
        F.inline(F.array(F.struct(F.lit("raw").alias("which"), F.lit(0).alias("o"), F.col(metric).alias("metric")), F.struct(F.lit("ema").alias("which"), F.lit(1).alias("o"), F.col(ema).alias("metric")))),
    ).where("metric is not null")
    best = F.max_by(F.struct("epoch", "which", "metric"), F.struct(F.col("metric"), -F.col("epoch"), -F.col("o")))
    return cand.groupBy("exp_id").agg(best.alias("_b")).select("exp_id", "_b.*")


def curves_of_best(exp: DataFrame, log: DataFrame, metric: str = "balanced_acc", also: Sequence[str] = ()) -> DataFrame:
    """Epoch curves of the best run and of some named runs."""
    best = exp.agg(F.max_by("exp_id", F.struct(F.col(metric), "exp_id")).alias("exp_id"))
    names = best.unionByName(exp.where(F.col("exp_id").isin(list(also))).select("exp_id")).distinct() if also else best
    return log.join(small(names, 1 + len(also)), "exp_id", "left_semi")


def tau_grid(runs: DataFrame) -> DataFrame:
    """The tau sweep of run records as rows."""
    d = runs.select("exp_id", F.explode("tau_sweep").alias("tau", "m"))
    return d.select("exp_id", F.col("tau").cast("double").alias("tau"), "m.*")


def remaining_runs(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """Configured runs without a finished record."""
    return configs.join(runs.where("top1 is not null").select("exp_id"), "exp_id", "left_anti")
