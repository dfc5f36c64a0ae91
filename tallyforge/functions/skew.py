"""Equi-join on a key of which a single value may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle, small


def join_keyed(
    rows: DataFrame,
    side: DataFrame,
    on: list[str],
    spread: str,
    how: str = "inner",
    sizes: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join ``rows`` with ``side`` (at most one row per key).

    The adaptive planner splits the partitions of ``rows`` that a hot key fills (spark.sql.adaptive.skewJoin) and
    repeats only their side; no job runs while the plan is made. Where it is off, ``hot_rows`` cuts by
    hand: keys with more rows are found by one partial aggregation (or taken from ``sizes``: on + n), each is cut into
    ceil(n / hot_rows) parts by the hash of ``spread``, and only that key's side row is repeated, once per
    part. The result is the plain join's either way.
    """
    if hot_rows is None:
        return rows.join(side, on, how)
    if sizes is None:
        sizes = rows.groupBy(*on).agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / F.lit(hot_rows)).cast("bigint").alias("_parts")
    hot = settle(sizes.where(F.col("n") > hot_rows).select(*on, parts), "hot-keys")
    n_hot = hot.count()
    if n_hot == 0:
        return rows.join(side, on, how)
    hot = small(hot, n_hot)
    zero = F.lit(0).cast("bigint")
    salted = rows.join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), zero))
    copies = side.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(zero, F.coalesce(F.col("_parts") - 1, zero))))
    return salted.drop("_parts").join(copies.drop("_parts"), [*on, "_salt"], how).drop("_salt")
