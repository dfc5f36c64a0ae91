"""Exact medians of any column: equal values are merged, ranges of values are counted, one range is looked into."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle


def value_cells(df: DataFrame, by: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """(by, column, value: double, n): how often each value of each column occurs, in one scan with map-side combine."""
    pairs = F.array(*[F.struct(F.lit(name).alias("column"), c.cast("double").alias("value")) for name, c in columns.items()])
    return df.select(*by, F.inline(pairs)).groupBy(*by, "column", "value").agg(F.count("*").alias("n"))


def medians_of(cells: DataFrame, by: Sequence[str], columns: Sequence[str], name: str = "med_{}") -> DataFrame:
    """(by, a median per column) from ``value_cells``: the mean of the two middle values; NULL values do not count.

    The cells are range-partitioned by group, column and value, and settled. The rows before each range tell
    which one or two ranges hold the middle; only these are sorted by value, so a task never holds more
    than one range, however many distinct values a group has.
    """
    keys = [*by, "column"]
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cells.where("value is not null").repartitionByRange(parts, *keys, "value").withColumn("_p", F.spark_partition_id())
    ranged = settle(ranged, "value-ranges")
    below = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*keys, "_p").agg(F.sum("n").alias("_rows"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(below), F.lit(0))).withColumn("_total", F.sum("_rows").over(Window.partitionBy(*keys)))
    # 1-based places of the middle values
    ranges = ranges.withColumn("_low", F.floor((F.col("_total") + 1) / 2)).withColumn("_high", F.floor(F.col("_total") / 2) + 1)
    middle = ranges.where("_before < _high and _before + _rows >= _low").drop("_rows", "_total")
    a, b = ranged.alias("a"), middle.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_p"]])
    inside = Window.partitionBy(*keys, "_p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    held = a.join(b, same).select("a.*", "_before", "_low", "_high").withColumn("_upto", F.col("_before") + F.sum("n").over(inside))
    holds = lambda place: (F.col("_upto") - F.col("n") < F.col(place)) & (F.col(place) <= F.col("_upto"))
    of = lambda c, place: F.max(F.when((F.col("column") == c) & holds(place), F.col("value")))
    found = [((of(c, "_low") + of(c, "_high")) / 2).alias(name.format(c)) for c in columns]
    return held.groupBy(*by).agg(*found) if by else held.agg(*found)


def exact_medians(df: DataFrame, by: Sequence[str], columns: Mapping[str, Column], name: str = "med_{}") -> DataFrame:
    """(by, a median per column) of the rows of each group; groups without any value have no row."""
    return medians_of(value_cells(df, by, columns), by, list(columns), name)
