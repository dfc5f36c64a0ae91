"""Combining score tables: members, subsets, views, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import attach_row, small
from tallyforge.functions.vectors import mean_vector, with_softmax
from tallyforge.operators.metrics import metrics_of
from tallyforge.operators.score import prior_vector


def mean_over(df: DataFrame, keys: Sequence[str], member: str, vector: str, width: int, out: str | None = None) -> DataFrame:
    """Element-wise mean of a vector over the members of an item (a few rows per item).

    Members are ordered by name before the sum. ``y`` must agree between members.
    """
    pairs = F.array_sort(F.collect_list(F.struct(member, vector)))
    aggs = [F.transform(pairs, lambda p: p[vector]).alias("_v"), F.count("*").alias("n_members")]
    if "y" in df.columns:
        same = F.min("y") == F.max("y")
        aggs.append(F.when(same, F.min("y")).otherwise(F.raise_error(F.lit("members disagree on y"))).cast("int").alias("y"))
    d = df.groupBy(*keys).agg(*aggs)
    return d.withColumn(out or vector, mean_vector(F.col("_v"), width)).drop("_v")


def ensemble(scores: DataFrame, keys: Sequence[str], how: str, width: int) -> DataFrame:
    """soft: log of the mean softmax; logit: mean score. Returns (keys, y, scores, n_members)."""
    if how == "logit":
        return mean_over(scores, keys, "model", "scores", width)
    if how != "soft":
        raise ValueError(f"how is 'soft' or 'logit', got {how!r}")
    d = mean_over(with_softmax(scores), keys, "model", "probs", width)
    return d.withColumn("scores", F.transform("probs", lambda p: F.log(p + F.lit(1e-9)))).drop("probs")


def subset_lattice(scores: DataFrame, models: Sequence[str], keys: Sequence[str], vectors: Sequence[str]) -> DataFrame:
    """(keys, y, subset, n_members, a mean per vector) for every subset of two or more of ``models``.

    An item's vectors meet once, in one row: the lattice of subsets grows there, a model at a time, each new
    subset's sum being one addition away from a smaller one. So score rows are shuffled once, by item, for any
    number of models, and subsets appear after the exchange. An item takes part in the subsets whose
    members have all scored it. Sums add members in the order of their names.
    """
    names = F.array(*[F.lit(m) for m in sorted(set(models))])
    of = F.struct("model", *vectors)
    aggs = [F.array_sort(F.collect_list(of)).alias("_m")]
    if "y" in scores.columns:
        same = F.min("y") == F.max("y")
        aggs.append(F.when(same, F.min("y")).otherwise(F.raise_error(F.lit("members disagree on y"))).cast("int").alias("y"))
    items = scores.where(F.array_contains(names, F.col("model"))).groupBy(*keys).agg(*aggs)
    none = F.struct(F.lit("").alias("subset"), F.lit(0).alias("n_members"), *[F.array().cast("array<double>").alias(v) for v in vectors])

    def joined(s: Column, m: Column) -> Column:
        first = s["n_members"] == 0
        name = F.when(first, m["model"]).otherwise(F.concat(s["subset"], F.lit("+"), m["model"]))
        sums = [F.when(first, m[v]).otherwise(F.zip_with(s[v], m[v], lambda a, b: a + b)).alias(v) for v in vectors]
        return F.struct(name.alias("subset"), (s["n_members"] + 1).alias("n_members"), *sums)

    lattice = F.aggregate("_m", F.array(none), lambda have, m: F.concat(have, F.transform(have, lambda s: joined(s, m))))
    rows = items.select(*keys, *[c for c in ("y",) if c in scores.columns], F.inline(F.filter(lattice, lambda s: s["n_members"] > 1)))
    return rows.withColumns({v: F.transform(v, lambda x: x / F.col("n_members")) for v in vectors})


def _log_vote(v: str) -> Column:
    return F.transform(v, lambda p: F.log(p + F.lit(1e-9)))


def ensemble_subsets(scores: DataFrame, models: Sequence[str], keys: Sequence[str], how: str, width: int) -> DataFrame:
    """Ensembles of every subset of two or more models, keyed by ``subset``."""
    if how == "logit":
        return subset_lattice(scores, models, keys, ["scores"])
    if how != "soft":
        raise ValueError(f"how is 'soft' or 'logit', got {how!r}")
    d = subset_lattice(with_softmax(scores), models, keys, ["probs"])
    return d.withColumn("scores", _log_vote("probs")).drop("probs")


def subset_sweep(scores: DataFrame, models: Sequence[str], keys: Sequence[str], log_priors: DataFrame, taus: Sequence[float] = (0, 0.25, 0.5, 0.75)) -> DataFrame:
    """(keys, y, subset, n_members, how, tau, scores): every subset as a soft vote at each tau of the prior adjustment, and
    as mean scores (logit, tau 0). Votes and taus spread from the item's one row, behind its one exchange.
    """
    both = attach_row(subset_lattice(with_softmax(scores), models, keys, ["probs", "scores"]), prior_vector(log_priors))
    both = both.withColumn("_soft", _log_vote("probs"))
    row = lambda how, tau, v: F.struct(F.lit(how).alias("how"), F.lit(float(tau)).alias("tau"), v.alias("scores"))
    adjusted = lambda tau: F.transform("_soft", lambda s, i: s - F.lit(float(tau)) * F.get("log_priors", i))
    forms = F.array(*[row("soft", t, adjusted(t)) for t in taus], row("logit", 0, F.col("scores")))
    return both.select(*[c for c in both.columns if c not in ("probs", "scores", "_soft", "log_priors")], F.inline(forms))


def view_average(scores: DataFrame, keys: Sequence[str], view: str, width: int) -> DataFrame:
    """Mean softmax over the views of an item, as ``probs``."""
    return mean_over(with_softmax(scores), keys, view, "probs", width)


def best_of_views(pred: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per item the view with the highest confidence; the first view wins ties."""
    best = F.max_by(F.struct(order, "pred", "p1", "y"), F.struct(F.col("p1"), -F.col(order)))
    return pred.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def guarded_view_search(pred: DataFrame, keys: Sequence[str], order: str, tau: float = 0.85, margin: float = 0.30) -> DataFrame:
    """Leave view 0 only when it is unsure (< tau) and another view is more than ``margin`` surer.

    The surest other view decides, the earliest on ties; ``searched`` marks unsure items.
    """
    base = F.max(F.when(F.col(order) == 0, F.struct("p1", "pred", "y")))
    other = F.max_by(F.struct(order, "pred", "p1"), F.when(F.col(order) != 0, F.struct(F.col("p1"), -F.col(order))))
    d = pred.groupBy(*keys).agg(base.alias("_b"), other.alias("_o"))
    searched = F.col("_b.p1") < tau
    moved = F.coalesce(searched & (F.col("_o.p1") > F.col("_b.p1") + margin), F.lit(False))
    return d.select(
        *keys,
        F.col("_b.y").alias("y"),
        searched.alias("searched"),
        F.when(moved, F.col(f"_o.{order}")).otherwise(0).alias(order),
        F.when(moved, F.col("_o.pred")).otherwise(F.col("_b.pred")).alias("pred"),
        F.when(moved, F.col("_o.p1")).otherwise(F.col("_b.p1")).alias("p1"),
    )


def compare_predictions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: accuracy of two scoring paths on the same items and how they disagree."""
    d = a.select(key, "y", F.col("pred").alias("a")).join(b.select(key, F.col("pred").alias("b")), key)
    a_ok, b_ok = F.col("a") == F.col("y"), F.col("b") == F.col("y")
    return d.agg(
        F.count("*").alias("n"),
        F.avg(a_ok.cast("int")).alias("acc_a"),
        F.avg(b_ok.cast("int")).alias("acc_b"),
        F.count_if(F.col("a") != F.col("b")).alias("n_disagree"),
        F.count_if(a_ok & ~b_ok).alias("n_only_a"),
        F.count_if(b_ok & ~a_ok).alias("n_only_b"),
    )


def rank_models(pred: DataFrame, balance: int = 3) -> DataFrame:
    """Models by top-1 on one labelled batch, with the verdict whether its classes are balanced."""
    m = metrics_of(pred, ["model"]).select("model", "n", "top1", "balanced_acc")
    sizes = pred.groupBy("model", "y").agg(F.count("*").alias("n"))
    even = sizes.groupBy("model").agg((F.max("n") <= balance * F.min("n")).alias("balanced_batch"))
    return m.join(even, "model").withColumn("rank", F.rank().over(Window.orderBy(F.desc("top1"))))


def weakest_classes(per_class: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """The k classes with the lowest recall of the top model (first by name on ties)."""
    best = ranked.agg(F.min_by("model", F.struct("rank", "model")).alias("model"))
    rows = per_class.where("n_true > 0").join(small(best, 1), "model", "left_semi")
    return rows.orderBy("recall", "label").limit(k)
