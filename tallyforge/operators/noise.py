"""Label-noise mining from out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.ranking import take_in_hash_order


def oof_assemble(pred: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    """Per keys: rows, items, items seen twice, accuracy, disagreements of out-of-fold predictions."""
    per = pred.groupBy(*keys, key).agg(
        F.count("*").alias("c"), F.max((F.col("y") == F.col("pred")).cast("int")).alias("ok"), (F.min("y") != F.max("y")).alias("clash")
    )
    return per.groupBy(*keys).agg(
        F.sum("c").alias("n_rows"),
        F.count("*").alias("n_items"),
        F.count_if((F.col("c") > 1) | F.col("clash")).alias("n_repeated"),
        F.avg("ok").alias("accuracy"),
        F.count_if(F.col("ok") == 0).alias("n_disagree"),
    )


def noise_candidates(pred: DataFrame, min_conf: float = 0.70) -> DataFrame:
    """Rows where a sure model contradicts the label; margin = p_pred - p_true."""
    d = pred.where((F.col("y") != F.col("pred")) & (F.col("p1") >= min_conf))
    return d.withColumn("p_pred", F.col("p1")).withColumn("margin", F.col("p1") - F.col("p_true"))


def noise_pairs(cand: DataFrame, keys: Sequence[str] = (), conf: float = 0.85, least: int = 5) -> DataFrame:
    """(true, predicted) pairs with counts, means and a suggestion."""
    d = cand.groupBy(*keys, "y", "pred").agg(
        F.count("*").alias("n"), F.avg("p_pred").alias("mean_conf"), F.avg("margin").alias("mean_margin")
    )
    return d.withColumn("suggestion", F.when((F.col("mean_conf") > conf) & (F.col("n") >= least), "relabel").otherwise("review"))


def undisputed_reference(
    df: DataFrame, cand: DataFrame, key: str, cls: str, pair: tuple[str, str], n: int = 8, seed: int = 42, models: Sequence[str] | None = None
) -> DataFrame:
    """n undisputed rows of class a, the n most disputed a -> b rows, n undisputed rows of b.

    With ``models`` (``cand`` then has a column model) for each of them, in one pass: a row counts for the models that do
    not dispute it.
    """
    a, b = pair
    rows = df.where(F.col(cls).isin(a, b)).select(key, cls)
    hot = cand.where((F.col("y_class") == a) & (F.col("pred_class") == b))
    if models is None:
        calm, by, roles = rows.join(cand.select(key), key, "left_anti"), cls, 2
        hot = hot.orderBy(F.desc("p_pred"), key).limit(n)
        keep = [key]
    else:
        listed = F.array(*[F.lit(m) for m in models])
        disputed = cand.groupBy(key).agg(F.collect_set("model").alias("_by"))
        free = F.when(F.col("_by").isNull(), listed).otherwise(F.array_except(listed, F.col("_by")))
        calm = rows.join(disputed, key, "left").select(key, cls, F.explode(free).alias("model"))
        calm, by, roles = calm.withColumn("_mc", F.concat_ws(":", "model", cls)), "_mc", 2 * len(models)
        first = Window.partitionBy("model").orderBy(F.desc("p_pred"), key)
        hot = hot.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
        keep = ["model", key]
    sample = take_in_hash_order(calm, by, key, lambda _: F.lit(n), seed, rows=roles).where("taken")
    sample = sample.select(*keep, F.when(F.col(cls) == a, "reference_a").otherwise("reference_b").alias("role"))
    return sample.unionByName(hot.select(*keep, F.lit("disputed").alias("role")))
