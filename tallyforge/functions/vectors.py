"""Row-local maths on score vectors (array<double>, position = class label)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    The optimiser copies a column that is used once into its user, even into a lambda that
    runs per element; binding it as a lambda variable keeps per-element work constant.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_max(v: Column) -> Column:
    """Label of the best score; ties go to the lowest label."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def at(v: Column, label: Column) -> Column:
    return F.get(v, label)


def softmax_of(v: Column, temperature: float = 1.0) -> Column:
    """softmax(v / temperature), shifted by the maximum for stability."""
    t = F.lit(float(temperature))
    exps = lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda e: F.exp((e - m) / t)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return let(v, lambda x: let(exps(x), lambda e: let(total(e), lambda s: F.transform(e, lambda p: p / s))))


def with_softmax(df: DataFrame, scores: str = "scores", out: str = "probs", temperature: float = 1.0) -> DataFrame:
    """Adds the softmax of a score vector."""
    return df.withColumn(out, softmax_of(F.col(scores), temperature))


def rank_of(v: Column, label: Column) -> Column:
    """1-based rank of ``label``: higher scores first, then lower labels."""

    def count(x: Column) -> Column:
        ahead = lambda own: F.transform(x, lambda e, i: ((e > own) | ((e == own) & (i < label))).cast("int"))
        return let(F.get(x, label), lambda own: F.aggregate(ahead(own), F.lit(1), lambda a, e: a + e))

    return let(v, count)


def ordered(v: Column) -> Column:
    """array<struct(score, label)> best first, ties by lower label."""
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("neg"), i.alias("label")))
    return F.transform(
        F.array_sort(pairs), lambda p: F.struct((-p["neg"]).alias("score"), p["label"].alias("label"))
    )


def mean_vector(vectors: Column, width: int) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    cells = F.sequence(F.lit(0), F.lit(width - 1))
    return let(
        vectors,
        lambda vs: F.transform(cells, lambda i: F.aggregate(vs, F.lit(0.0), lambda a, v: a + F.get(v, i)) / F.size(vs)),
    )
