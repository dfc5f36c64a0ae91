"""Writers: splits, pixel stores, reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StructType

from tallyforge.functions.bounds import attach_row
from tallyforge.operators.split import split_overlap_check


def _file_system(spark: SparkSession, path: str):
    """(file system of the path, function from a string to a path of it)."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def write_splits(df: DataFrame, path: str, key: str, kinds: Sequence[str] = ("split", "doc_split")) -> DataFrame:
    """Write a table of splits (with ``seed``), partitioned by seed and first split column.

    The rows are written once, to a staging folder beside ``path``; what was written is checked, and a
    sound table is published by renaming the folder. A key on both sides of a split fails the write, and
    a failed write or check leaves nothing behind. An existing ``path`` is an error.
    """
    spark = df.sparkSession
    fs, of = _file_system(spark, path)
    if fs.exists(of(path)):
        raise FileExistsError(path)
    stage = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy("seed", kinds[0]).parquet(stage)
        stored = spark.read.schema(df.schema).parquet(stage)
        check = split_overlap_check(stored.withColumn("_k", F.concat_ws(":", "seed", key)), "_k", list(kinds))
        for row in check.where("n_both > 0").take(1):
            raise ValueError(f"{row['n_both']} keys are on both sides of {row['split_kind']}")
        if not fs.rename(of(stage), of(path)):
            raise OSError(f"cannot publish {stage} as {path}")
    except BaseException:
        fs.delete(of(stage), True)
        raise
    return spark.read.parquet(path)


def write_glyphs(df: DataFrame, path: str, keys: Sequence[str], parts: int | None = None) -> None:
    """A store of pixel arrays with their size and keys, made for reads by the first key.

    Rows are range-partitioned by the keys and sorted, a folder per range, with a Bloom filter on the first key; a
    sidecar table has the least and greatest first key of each folder. ``glyph_rows`` reads all, ``read_glyphs``
    only folders and row groups in reach of the keys asked for.
    """
    out = df.select(*keys, F.transform("pixels", lambda p: p.cast("smallint")).alias("pixels"), "w", "h")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = out.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id())
    writer = ranged.sortWithinPartitions("part", *keys).write.partitionBy("part")
    writer.option(f"parquet.bloom.filter.enabled#{keys[0]}", "true").parquet(f"{path}/rows")
    ends = F.struct(F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high"))
    glyph_rows(df.sparkSession, path, df.schema, keys).groupBy("part").agg(ends.alias("ends"), F.count("*").alias("n")).write.parquet(f"{path}/ranges")


def glyph_rows(spark: SparkSession, path: str, schema: StructType | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """All rows of a store, with the number of their folder (``part``)."""
    reader = spark.read
    if schema is not None:  # an empty store has no files to read the columns from
        kinds = StructType([schema[k] for k in keys]).add("pixels", ArrayType(ShortType())).add(schema["w"]).add(schema["h"])
        reader = reader.schema(kinds.add("part", IntegerType()))
    return reader.parquet(f"{path}/rows")


def read_glyphs(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """The stored images of some keys.

    The sidecar (one row per folder) tells which folders and which span of keys are in reach; at most that many
    rows come to the driver. The scan then has a partition filter, which skips all other folders,
    and a pushed range, which skips row groups.
    """
    ranges = spark.read.parquet(f"{path}/ranges")
    listed = ranges.agg(F.collect_list(F.struct("part", "ends")).alias("_ranges"))
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    reach = F.filter("_ranges", lambda r: (r["ends"]["low"] <= F.col(key)) & (F.col(key) <= r["ends"]["high"]))
    hits = attach_row(wanted, listed).select(key, F.explode(F.transform(reach, lambda r: r["part"])).alias("part"))
    found = hits.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    rows = glyph_rows(spark, path) if ranges.limit(1).count() else None
    if rows is None:
        raise FileNotFoundError(f"{path} has no rows")
    if not found:
        return rows.where(F.lit(False)).drop("part")
    low, high = min(r["low"] for r in found), max(r["high"] for r in found)
    near = rows.where(F.col("part").isin([r["part"] for r in found]) & F.col(key).between(low, high))
    return near.join(wanted, key, "left_semi").drop("part")


def markdown_table(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A table as the lines of a Markdown table, in order: (value). Sorted by range, not in one task."""
    cols = df.columns
    names = "| " + " | ".join(cols) + " |"
    head = df.limit(0).select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.lit(0).alias("_s"), F.lit("").alias("value"))
    for s, text in enumerate((names, "|" + "---|" * len(cols))):
        line = df.sparkSession.range(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)], F.lit(s).alias("_s"), F.lit(text).alias("value"))
        head = head.unionByName(line)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.lit(2).alias("_s"), line.alias("value"))
    return head.unionByName(rows).orderBy("_s", *[f"_o{i}" for i in range(len(order))]).select("value")


def write_report(df: DataFrame, path: str, fmt: str, order: Sequence[str]) -> None:
    """A table as csv, json or markdown: part files whose names follow the order. A small one is one file."""
    if fmt == "csv":
        df.orderBy(*order).write.option("header", True).csv(path)
    elif fmt == "json":
        df.orderBy(*order).write.json(path)
    elif fmt == "markdown":
        markdown_table(df, order).write.text(path)
    else:
        raise ValueError(f"fmt is csv, json or markdown, got {fmt!r}")
