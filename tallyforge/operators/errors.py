"""Error analysis over confusion cells and prediction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, attach_row, small
from tallyforge.operators.metrics import class_metrics


def confused_directed(cells: DataFrame, keys: Sequence[str], counts: DataFrame, rows: int | None, k: int = 20) -> DataFrame:
    """The k largest off-diagonal cells per keys with their share of the true class."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "y"))
    d = cells.withColumn("pct", 100.0 * share).where("y <> pred")
    d = d.join(small(counts.select(F.col("label").alias("y"), F.col("n").alias("n_train")), rows), "y", "left")
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("pct"), "y", "pred")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("hits")


def confused_symmetric(cells: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """The k most confused unordered pairs: both directions and their sum."""
    a, b = F.least("y", "pred"), F.greatest("y", "pred")
    d = cells.where("y <> pred").groupBy(*keys, a.alias("a"), b.alias("b")).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("y") < F.col("pred"), F.col("n")).otherwise(0)).alias("a_to_b"),
        F.sum(F.when(F.col("y") > F.col("pred"), F.col("n")).otherwise(0)).alias("b_to_a"),
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("total"), F.desc(F.greatest("a_to_b", "b_to_a")), "a", "b")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def worst_classes(cells: DataFrame, keys: Sequence[str], counts: DataFrame, rows: int | None, n: int = 15) -> DataFrame:
    """The n classes with the lowest recall and their three most frequent predictions."""
    by = Window.partitionBy(*keys, "y").orderBy(F.desc("n"), "pred")
    top = cells.withColumn("_r", F.row_number().over(by)).where("_r <= 3").groupBy(*keys, F.col("y").alias("label")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "pred", "n"))), lambda x: F.struct(x["pred"].alias("pred"), x["n"].alias("n"))).alias("top")
    )
    per = class_metrics(cells, keys).where("n_true > 0").select(*keys, "label", F.col("n_true").alias("n_val"), "recall")
    per = per.join(top, [*keys, "label"]).join(small(counts.select("label", F.col("n").alias("n_train")), rows), "label", "left")
    w = Window.partitionBy(*keys).orderBy("recall", F.desc("n_val"), F.desc("n_train"), "label")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def unevaluated_classes(cells: DataFrame, classes: Classes) -> DataFrame:
    """Classes without a single evaluated row."""
    return classes.side.join(cells.select(F.col("y").alias("label")).distinct(), "label", "left_anti")


def per_class_report(cells: DataFrame, keys: Sequence[str], counts: DataFrame, rows: int | None) -> DataFrame:
    """Recall, precision, n_train and n_val of every class, blind ones (n_val = 0) included."""
    dim = counts.select("class", "label", F.col("n").alias("n_train"))
    labels = dim.agg(F.collect_list("label").alias("labels"))
    grid = attach_row(cells.select(*keys).distinct(), labels).select(*keys, F.explode("labels").alias("label"))
    grid = grid.join(small(dim, rows), "label")
    per = class_metrics(cells, keys).select(*keys, "label", "n_true", "recall", "precision")
    out = grid.join(per, [*keys, "label"], "left").withColumn("n_val", F.coalesce("n_true", F.lit(0))).drop("n_true")
    return out.withColumn("blind", F.col("n_val") == 0)


def confusion_zoom(cells: DataFrame, k: int = 18, keys: Sequence[str] = ()) -> DataFrame:
    """Per keys the sub-matrix of the k classes with the most errors, counted as true and as predicted."""
    off = cells.where("y <> pred")
    errors = off.select(*keys, F.explode(F.array("y", "pred")).alias("label"), "n").groupBy(*keys, "label").agg(F.sum("n").alias("errors"))
    # cell-sized
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("errors"), "label"))
    top = errors.withColumn("_r", place).where(F.col("_r") <= k).select(*keys, "label")
    rows, cols = top.withColumnRenamed("label", "y"), top.withColumnRenamed("label", "pred")
    return cells.join(rows, [*keys, "y"], "left_semi").join(cols, [*keys, "pred"], "left_semi")


def show_class(pred: DataFrame, label: int, keys: Sequence[str] = ("model",), order: str = "item_id") -> DataFrame:
    """All mistakes of one true class with ``n_mistaken``, how often it was taken for the same class; ordered by
    keys, the most frequent mistake first, the surest rows first.
    """
    wrong = pred.where((F.col("y") == label) & (F.col("pred") != label))
    counts = wrong.groupBy(*keys, "pred").agg(F.count("*").alias("n_mistaken"))
    return wrong.join(counts, [*keys, "pred"]).orderBy(*keys, F.desc("n_mistaken"), "pred", F.desc("p1"), order)


def confident_mistakes(pred: DataFrame, key: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per keys the k surest wrong rows and the k least sure correct rows.

    A partition keeps its own k of each list before the exchange, so k rows per task and list move.
    """

    def first(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order, key)
        return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r").withColumn("list", F.lit(name))

    return first(pred.where("y <> pred"), "wrong_sure", F.desc("p1")).unionByName(first(pred.where("y = pred"), "right_unsure", "p1"))
