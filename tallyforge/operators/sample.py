"""Class-balanced samples, top-up and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, attach_row, small
from tallyforge.functions.hashing import hash_hex, uniform
from tallyforge.functions.ranking import RankIndex, take_in_hash_order


def class_counts(df: DataFrame, classes: Classes, cls: str) -> DataFrame:
    """(class, label, n) for every class of the universe, absent ones with 0."""
    n = df.groupBy(F.col(cls).alias("class")).agg(F.count("*").alias("n"))
    return classes.side.join(n, "class", "left").fillna(0, ["n"])


def log_prior(counts: DataFrame) -> DataFrame:
    """log(max(n, 1) / total): the total is taken before the clip."""
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("log_prior", F.log(F.greatest("n", F.lit(1)) / total))


def subset_per_class(df: DataFrame, cls: str, key: str, frac: float, seed: int = 42, rows: int | None = None) -> DataFrame:
    """max(1, half-even n * frac) rows of each class; everything for frac >= 1."""
    if frac >= 1.0:
        return df
    quota = lambda n: F.greatest(F.lit(1.0), F.bround(F.lit(float(frac)) * n))
    return take_in_hash_order(df, cls, key, quota, seed, rows=rows).where("taken").drop("taken")


def sample_n_per_class(df: DataFrame, cls: str, key: str, n: int, seed: int = 42, rows: int | None = None) -> DataFrame:
    """At most n rows of each class."""
    return take_in_hash_order(df, cls, key, lambda _: F.lit(n), seed, rows=rows).where("taken").drop("taken")


def fill_extra(
    extra: DataFrame,
    real_counts: DataFrame,
    cls: str,
    key: str,
    mode: str = "fill",
    fill_to: int = 200,
    max_real: int | None = None,
    max_per_class: int | None = None,
    seed: int = 42,
    rows: int | None = None,
) -> DataFrame:
    """Rows of ``extra`` that top real classes up.

    fill: need = fill_to - real rows, nothing where real rows exceed ``max_real``; all: every
    row; both then limited to ``max_per_class`` and to what is available.
    """
    real = F.coalesce(F.col("n_real"), F.lit(0))

    def need(available: Column) -> Column:
        want = F.greatest(F.lit(0), F.lit(fill_to) - real) if mode == "fill" else available
        if mode == "fill" and max_real is not None:
            want = F.when(real > max_real, 0).otherwise(want)
        if max_per_class is not None:
            want = F.least(want, F.lit(max_per_class))
        return F.least(want, available)

    side = real_counts.select(F.col("class").alias(cls), F.col("n").alias("n_real"))
    marked = take_in_hash_order(extra, cls, key, need, seed, rows=rows, side=side)
    return marked.where("taken").drop("taken")


def weight_table(counts: DataFrame, power: float, cap: float = 10.0) -> DataFrame:
    """Per class: the sampling weight of one of its rows (row mean 1, then capped)."""
    everything = Window.partitionBy()
    raw = F.pow(F.greatest("n", F.lit(1)).cast("double"), F.lit(-float(power)))
    mean = F.sum(raw * F.col("n")).over(everything) / F.sum("n").over(everything)
    return counts.where("n > 0").withColumn("weight", F.least(raw / mean, F.lit(float(cap))))


def sample_weights(df: DataFrame, classes: Classes, cls: str, power: float, cap: float = 10.0) -> DataFrame:
    """Every row with its sampling weight."""
    w = weight_table(class_counts(df, classes, cls), power, cap)
    side = small(w.select(F.col("class").alias(cls), "weight"), classes.rows)
    return df.join(side, cls)


def class_cdf(weights: DataFrame) -> DataFrame:
    """Half-open ranges [lo, hi) of the cumulative class mass n * weight, scaled to 1."""
    everything = Window.partitionBy()
    upto = Window.partitionBy().orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("n") * F.col("weight")
    d = weights.withColumn("_mass", mass)
    share = F.sum("_mass").over(upto) / F.sum("_mass").over(everything)
    # the last range ends at 1 whatever the rounding of the sums
    d = d.withColumn("hi", F.when(F.col("class") == F.max("class").over(everything), 1.0).otherwise(share))
    return d.withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy().orderBy("class")), F.lit(0.0))).drop("_mass")


def range_draw(draws: DataFrame, u: str, cdf: DataFrame) -> DataFrame:
    """Adds the ``class`` whose [lo, hi) holds u, and its ``n``. The ranges follow each other, so
    the class is found by counting upper ends; the class-sized table travels as one row."""
    ends = cdf.agg(F.array_sort(F.collect_list(F.struct("hi", "class", "n"))).alias("_cdf"))
    d = attach_row(draws, ends)
    hit = F.get("_cdf", F.size(F.filter("_cdf", lambda c: c["hi"] <= F.col(u))))
    d = d.withColumn("_hit", hit).drop("_cdf")
    return d.select("*", F.col("_hit")["class"].alias("class"), F.col("_hit")["n"].alias("n")).drop("_hit")


def weighted_resample(
    df: DataFrame, classes: Classes, cls: str, key: str, n: int | None, power: float, cap: float = 10.0, seed: int = 42
) -> DataFrame:
    """n draws with replacement (as many as rows for None): class by its mass, then a row of the class by rank.

    A ``RankIndex`` leads from the rank to the bucket of the row; rows of buckets without a draw stay where they are.
    """
    index = RankIndex(df, cls, key, seed, classes.rows)
    cdf = class_cdf(weight_table(class_counts(df, classes, cls), power, cap))
    ids = index.numbers("id") if n is None else df.sparkSession.range(n)
    h = hash_hex(seed, F.lit("draw"), F.col("id"))
    draws = ids.withColumn("_h", h)
    draws = draws.select(F.col("id").alias("draw"), uniform(F.col("_h"), 1).alias("u1"), uniform(F.col("_h"), 9).alias("u2"))
    chosen = range_draw(draws, "u1", cdf).select(
        "draw", F.col("class").alias(cls), (F.floor(F.col("u2") * F.col("n")) + 1).alias("rank")
    )
    return index.rows_at(chosen, "rank").drop("rank")


def class_weights(counts: DataFrame, power: float) -> DataFrame:
    """n^-power, normalised to class mean 1."""
    raw = F.pow(F.greatest("n", F.lit(1)).cast("double"), F.lit(-float(power)))
    return counts.withColumn("weight", raw / F.avg(raw).over(Window.partitionBy()))


def cb_weights(counts: DataFrame, beta: float = 0.999) -> DataFrame:
    """Effective-number weights (1 - beta) / (1 - beta^n), normalised to class mean 1."""
    raw = (1 - F.lit(beta)) / (1 - F.pow(F.lit(beta), F.greatest("n", F.lit(1)).cast("double")))
    return counts.withColumn("weight", raw / F.avg(raw).over(Window.partitionBy()))


def balance_sources(real: DataFrame, extra: DataFrame, classes: Classes, cls: str) -> DataFrame:
    """Per class: rows from the real and from the extra pool after merging both."""
    both = real.select(cls, F.lit(0).alias("extra")).unionByName(extra.select(cls, F.lit(1).alias("extra")))
    n = both.groupBy(F.col(cls).alias("class")).agg(
        F.count_if(F.col("extra") == 0).alias("n_real"),
        F.count_if(F.col("extra") == 1).alias("n_extra"),
        F.count("*").alias("n_total"),
    )
    return classes.side.select("class").join(n, "class", "left").fillna(0)
