"""Size-checked sides for joins, and tables settled in the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is hinted for broadcast only when its row count is known and at most this.
SMALL_ROWS = 50_000

_own_scratch: str | None = None
_owners: list[list[str]] = []


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast hint when ``rows`` is a known upper bound within SMALL_ROWS; else Spark decides."""
    return F.broadcast(df) if rows is not None and rows <= SMALL_ROWS else df


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery (no join)."""
    row = one.select(F.struct(*[F.col(c) for c in one.columns])).scalar()
    return df.withColumn("_one", row).select("*", *[F.col("_one")[c].alias(c) for c in one.columns]).drop("_one")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder (spark.checkpoint.dir)."""
    global _own_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # a folder of this machine will do only where all tasks run on it
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_scratch is None:
            _own_scratch = tempfile.mkdtemp(prefix="tallyforge-")
        root = _own_scratch
    return f"{root.rstrip('/')}/tallyforge/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, scan: DataFrame) -> DataFrame:
    """Rows of ``df`` over all cores when its ``scan`` has fewer files than there are cores.

    For heavy per-row work on a few unsplittable files; with enough files ``df`` is returned as it is,
    without a shuffle. Only the file list is looked at; no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(scan.inputFiles()) < cores else df


@contextmanager
def settled_tables(spark: SparkSession) -> Iterator[None]:
    """Own the tables that are settled within the block and remove them at its end.

    For jobs that write their result within the block: what reads a removed table afterwards fails.
    """
    _owners.append([])
    try:
        yield
    finally:
        of = spark._jvm.org.apache.hadoop.fs.Path
        for path in _owners.pop():
            of(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(of(path), True)


@contextmanager
def configured(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """The settings ``own`` hold within the block; those before it come back at its end."""
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> AbstractContextManager[None]:
    """Jobs within the block hand Python batches of at most ``rows`` rows and about ``size`` bytes (a larger row alone)."""
    return configured(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)})


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of a query that runs within the block go when it is done, not when the driver next collects garbage."""
    return configured(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def settle(df: DataFrame, name: str, owned: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a place that survives lost executors, and gives the planner the
    true size of the result, so broadcast decisions on it rest on bytes, not on guesses. Within a
    ``settled_tables`` block the table goes at its end, unless ``owned`` is False.
    """
    path = scratch_path(df.sparkSession, name)
    if owned and _owners:
        _owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_labels(names: DataFrame, col: str) -> DataFrame:
    """``names`` (one row per value of ``col``) with ``label`` = rank of the value from 0.

    The values are range-partitioned; a label is the number of values in the ranges before plus
    the place in the own range, so no task sees all of them.
    """
    ranges = settle(names.repartitionByRange(col).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row per range
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(col)) - 1
    return ranges.withColumn("_place", place).join(start, "_p").withColumn("label", (F.col("_start") + F.col("_place")).cast("int")).drop("_p", "_place", "_start")


@dataclass(frozen=True)
class Classes:
    """The class universe: ``df`` has (class, label); label = rank of the class name.

    ``names`` is set when the universe is known to be small; ``rows`` is then a proven bound
    for every table that has one row per class. A universe above SMALL_ROWS is a written table with
    the same dense labels and is joined without hints.
    """

    df: DataFrame
    names: tuple[str, ...] | None

    @property
    def rows(self) -> int | None:
        return len(self.names) if self.names is not None else None

    @property
    def side(self) -> DataFrame:
        return small(self.df, self.rows)

    def require_names(self) -> tuple[str, ...]:
        if self.names is None:
            raise ValueError("score vectors need a class universe that was listed or proven small")
        return self.names

    @staticmethod
    def of(spark: SparkSession, names: Sequence[str]) -> Classes:
        ordered = tuple(sorted(set(names)))
        df = spark.createDataFrame(
            [(c, i) for i, c in enumerate(ordered)], "class string, label int"
        )
        return Classes(df, ordered)  # a listed universe is as small as the list

    @staticmethod
    def from_column(df: DataFrame, col: str) -> Classes:
        found = df.select(F.col(col).cast("string").alias("class")).where("class is not null").distinct()
        head = found.limit(SMALL_ROWS + 1).collect()
        if len(head) <= SMALL_ROWS:
            return Classes.of(df.sparkSession, [r[0] for r in head])
        return Classes(dense_labels(found, "class"), None)
