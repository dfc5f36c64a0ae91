"""Classification metrics. Items are counted once into confusion cells; the rest is cell-sized."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, settle, small
from tallyforge.operators.score import logit_adjust, predict


def confusion(pred: DataFrame, keys: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Sparse confusion cells (keys, y, pred, n, hits): the only pass over items."""
    return pred.groupBy(*keys, "y", "pred").agg(
        F.count("*").alias("n"), F.count_if(F.col("rank_true") <= k).alias("hits")
    )


def confusion_norm(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``share``: the cell's part of its true class."""
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "y")))


def confusion_dense(cells: DataFrame, classes: Classes, keys: Sequence[str]) -> DataFrame:
    """Every (y, pred) cell of the universe, zeros included."""
    n = len(classes.require_names())
    labels = F.sequence(F.lit(0), F.lit(n - 1))
    grid = cells.select(*keys).distinct().withColumn("y", F.explode(labels)).withColumn("pred", F.explode(labels))
    return grid.join(cells.select(*keys, "y", "pred", "n"), [*keys, "y", "pred"], "left").fillna(0, ["n"])


def class_metrics(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per (keys, label): n_true, tp, n_pred, hits, recall, precision, f1; NULL where undefined."""
    zero = F.lit(0).cast("bigint")
    same = F.col("y") == F.col("pred")
    roles = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("t"), F.when(same, F.col("n")).otherwise(zero).alias("tp"), zero.alias("p"), F.col("hits").alias("h")),
        F.struct(F.col("pred").alias("label"), zero.alias("t"), zero.alias("tp"), F.col("n").alias("p"), zero.alias("h")),
    )
    sums = cells.select(*keys, F.inline(roles)).groupBy(*keys, "label").agg(
        F.sum("t").alias("n_true"), F.sum("tp").alias("tp"), F.sum("p").alias("n_pred"), F.sum("h").alias("hits")
    )
    return sums.select(
        "*",
        F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).alias("recall"),
        F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).alias("precision"),
        F.when(F.col("n_true") > 0, 2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))).alias("f1"),
    )


def summarise(per_class: DataFrame, keys: Sequence[str], counts: DataFrame | None = None, rows: int | None = None, minority: int = 50) -> DataFrame:
    """One row per keys: n, top1, topk, balanced_acc, macro_f1, minority_acc (micro) and
    minority_macro, n_classes_present. ``counts`` = (label, n) of the training rows."""
    d = per_class
    if counts is not None:
        d = d.join(small(counts.select("label", F.col("n").alias("n_train")), rows), "label", "left")
        few = F.coalesce(F.col("n_train"), F.lit(0)) < minority
    else:
        few = F.lit(False)
    few_true = F.sum(F.when(few, F.col("n_true")))
    # recalls are added as decimals, so that equal ones give one value in any order and ties stay ties
    exact = F.sum(F.when(F.col("n_true") > 0, F.col("tp").cast("decimal(14,0)") / F.col("n_true").cast("decimal(23,0)")))
    agg = [
        F.sum("n_true").alias("n"),
        (F.sum("tp") / F.sum("n_true")).alias("top1"),
        (F.sum("hits") / F.sum("n_true")).alias("topk"),
        (exact.cast("double") / F.count("recall")).alias("balanced_acc"),
        F.avg("f1").alias("macro_f1"),
        F.when(few_true > 0, F.sum(F.when(few, F.col("tp"))) / few_true).alias("minority_acc"),
        F.avg(F.when(few, F.col("recall"))).alias("minority_macro"),
        F.count_if(F.col("n_true") > 0).alias("n_classes_present"),
    ]
    return d.groupBy(*keys).agg(*agg) if keys else d.agg(*agg)


def compute_metrics(
    scores: DataFrame, keys: Sequence[str], counts: DataFrame, rows: int | None, minority: int = 50, k: int = 5
) -> DataFrame:
    """All metrics of a score table, one row per keys."""
    return metrics_of(predict(scores), keys, counts, rows, minority, k)


def metrics_of(
    pred: DataFrame, keys: Sequence[str], counts: DataFrame | None = None, rows: int | None = None, minority: int = 50, k: int = 5
) -> DataFrame:
    return summarise(class_metrics(confusion(pred, keys, k), keys), keys, counts, rows, minority)


def tau_sweep(
    scores: DataFrame, log_priors: DataFrame, keys: Sequence[str], counts: DataFrame, rows: int | None,
    taus: Sequence[float] = (0, 0.25, 0.5, 0.75), minority: int = 50,
) -> DataFrame:
    """Metrics per tau of the prior adjustment, all taus in one job."""
    return compute_metrics(logit_adjust(scores, log_priors, taus), [*keys, "tau"], counts, rows, minority)


def tau_best(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The tau with the best balanced accuracy; the first one wins ties."""
    best = F.max_by(F.struct("tau", "balanced_acc"), F.struct("balanced_acc", -F.col("tau")))
    return sweep.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.tau", "_b.balanced_acc")


def slice_metrics(pred: DataFrame, keys: Sequence[str], slice_col: str) -> DataFrame:
    """n, classes, top-1, balanced accuracy and worst class recall, per slice and overall (is_total, slice 'all')."""
    both = F.array(F.struct(F.lit(True).alias("is_total"), F.lit("all").alias("slice")), F.struct(F.lit(False).alias("is_total"), F.col(slice_col).cast("string").alias("slice")))
    sliced = pred.select("*", F.inline(both))
    by = [*keys, "is_total", "slice"]
    return class_metrics(confusion(sliced, by), by).groupBy(*by).agg(
        F.sum("n_true").alias("n"),
        F.count_if(F.col("n_true") > 0).alias("n_classes"),
        (F.sum("tp") / F.sum("n_true")).alias("top1"),
        F.avg("recall").alias("balanced_acc"),
        F.min("recall").alias("worst_recall"),
    )


def slice_confusions(pred: DataFrame, keys: Sequence[str], slice_col: str, k: int = 10) -> DataFrame:
    """The k most frequent (y, pred) mistakes per slice; ties by labels."""
    by = [*keys, slice_col]
    n = pred.where("y <> pred").groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "y", "pred")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bucket_of(col: Column, edges: Sequence[float]) -> Column:
    """Half-open size bucket as text: <e0, e0-e1, ..., >=en."""
    out = F.when(col < edges[0], f"<{edges[0]}")
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(col < hi, f"{lo}-{hi}")
    return out.otherwise(f">={edges[-1]}")


def bucket_accuracy(pred: DataFrame, keys: Sequence[str], col: str, edges: Sequence[float] = (9, 12, 16, 24)) -> DataFrame:
    """Accuracy by size bucket."""
    return pred.groupBy(*keys, bucket_of(F.col(col), edges).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.avg(F.col("correct").cast("int")).alias("accuracy")
    )


def auroc(df: DataFrame, score: str, is_pos: Column, by: Sequence[str]) -> DataFrame:
    """P(positive scores higher than negative), ties half; NULL if a side is empty.

    Equal scores are merged first. The distinct scores are range-partitioned over the cluster
    and settled; each range counts its own negatives and adds those of the ranges below.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = df.groupBy(*by, score).agg(F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg"))
    ranged = merged.repartitionByRange(parts, *by, score).withColumn("_p", F.spark_partition_id())
    ranged = settle(ranged, "auroc")
    below = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*by, "_p").agg(F.sum("neg").alias("_neg"))
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_neg").over(below), F.lit(0))).drop("_neg")
    inside = Window.partitionBy(*by, "_p").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = ranged.withColumn("_in", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(ranges, [*by, "_p"])
    won = F.sum(F.col("pos") * (F.col("_base") + F.col("_in") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return wins.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.when(pairs > 0, won / pairs).alias("auroc")
    )


def confident_at(pred: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = (0.5, 0.7, 0.9)) -> DataFrame:
    """Mean confidence and the share of items at or above each threshold."""
    return pred.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("p1").alias("mean_conf"),
        *[F.avg((F.col("p1") >= t).cast("int")).alias(f"conf_{str(t).replace('.', '_')}") for t in thresholds],
    )


def threshold_tradeoff(clean: DataFrame, junk: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Per (model, threshold): share of clean items kept, their accuracy, worst junk kind leaking."""
    ts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    keep = F.col("p1") >= F.col("threshold")
    good = clean.select("model", "p1", "correct", ts).groupBy("model", "threshold").agg(
        F.avg(keep.cast("int")).alias("clean_kept"),
        F.avg(F.when(keep, F.col("correct").cast("int"))).alias("kept_accuracy"),
    )
    bad = junk.select("model", "kind", "p1", ts).groupBy("model", "threshold", "kind").agg(F.avg(keep.cast("int")).alias("leak"))
    worst = bad.groupBy("model", "threshold").agg(F.max("leak").alias("worst_leak"))
    return good.join(worst, ["model", "threshold"], "left")


def eval_split(pred: DataFrame, side: Column, keys: Sequence[str], counts: DataFrame, rows: int | None, fitted_on: str, kind: str, minority: int = 50) -> DataFrame:
    """Metrics of the rows on one side of a split, flagged when the model saw another split kind."""
    out = metrics_of(pred.where(side), keys, counts, rows, minority)
    return out.withColumn("split_kind", F.lit(kind)).withColumn("mismatch", F.lit(fitted_on != kind))
