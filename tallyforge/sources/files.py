"""Readers: corpus listings, run records, epoch logs, experiment tables."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.bounds import Classes

# Fields of a run record that carry metrics.
METRIC_FIELDS = ("top1", "top5", "balanced_acc", "macro_f1", "minority_acc")
TAU_STRUCT = "struct<top1:double,balanced_acc:double,macro_f1:double,minority_acc:double>"
# The layout of a run record and of an epoch log.
CFG_SCHEMA = (
    "struct<model:string,img_size:int,mode:string,channel_mode:string,aug:string,loss:string,sampler:string,mixup:double,"
    "cutmix:double,extra_mode:string,extra_train_index:string,split_kind:string,subset_frac:double,seed:int>"
)
RUN_SCHEMA = (
    f"exp_id string, cfg {CFG_SCHEMA}, top1 double, top5 double, balanced_acc double, macro_f1 double, minority_acc double,"
    f" tau_sweep map<string,{TAU_STRUCT}>, tta struct<top1:double,balanced_acc:double>, confusion array<array<bigint>>,"
    " per_class_recall array<double>, class_counts_train array<bigint>, epochs_done int, best_epoch int, best_which string,"
    " params_total bigint, sec_per_epoch double, latency_ms_bs1 double, device string"
)
EPOCH_FIELDS = (
    "epoch", "lr", "train_loss", "train_acc", "val_top1", "val_bal_acc", "val_macro_f1", "val_minority_acc",
    "ema_val_top1", "ema_val_bal_acc", "epoch_seconds", "train_seconds",
)
# Experiment columns with the default of each when the file lacks it.
EXPERIMENT_DEFAULTS: dict[str, object] = {
    "exp_id": "", "model": "resnet18", "img_size": 64, "mode": "full", "channel_mode": "gray3", "aug": "none",
    "loss": "ce", "sampler": "none", "mixup": 0.0, "cutmix": 0.0, "extra": "-", "split_kind": "strat",
    "subset_frac": 1.0, "epochs": 6, "seed": 42, "top1": None, "balanced_acc": None, "macro_f1": None,
    "minority_acc": None, "top5": None, "tau_best": None, "tau_best_bal": None, "tta_top1": None, "tta_bal": None,
    "params_M": None, "sec_per_epoch": None, "latency_ms": None, "device": "cuda",
}
TEXT_FIELDS = ("exp_id", "model", "mode", "channel_mode", "aug", "loss", "sampler", "extra", "split_kind", "device")


def scan_files(spark: SparkSession, root: str, extension: str, classes: Classes, with_hash: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) files below ``root``: the parent folder names the class.

    Kept: a class of the universe and the right extension; path, class, name, bytes and, ``with_hash``,
    the md5 of the content (files of 2 GiB and more cannot be hashed this way). Only then contents
    are read. Skipped has every other file with its ``reason``, class or extension. Hidden files
    (names that begin with a dot or an underscore) are not listed at all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    columns = [F.md5("content").alias("md5")] if with_hash else []
    f = files.select("path", F.element_at(parts, -2).alias("class"), F.element_at(parts, -1).alias("name"), F.col("length").alias("bytes"), *columns)
    known = f.join(classes.side.select("class", F.lit(True).alias("_known")), "class", "left")
    reason = F.when(F.col("_known").isNull(), "class").when(~F.lower("name").endswith(extension.lower()), "extension")
    told = known.withColumn("reason", reason).drop("_known")
    return told.where("reason is null").drop("reason"), told.where("reason is not null").drop("md5")


def collect_runs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Run records as one flat table, best balanced accuracy first; unreadable ones are in ``rejected_runs``."""
    return flatten_runs(read_runs(spark, path)).orderBy(F.desc("balanced_acc"), "exp_id")


def _parsed_runs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, text, run) of every record: a file is one record in any layout, or one record per line.

    A file that parses as one record is one; only another is cut at its lines.
    """
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    parsed = lambda c: F.from_json(c, RUN_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", ""))), lambda x: x != "")
    brace = lambda x, end: x.startswith("{") & x.endswith(end)
    one = F.from_json("value", "exp_id string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # a file of records one to a line parses as its first record: its first line is whole; of damaged ones each line begins one
    listed = F.exists(lines, lambda x: brace(x, "}")) | F.forall(lines, lambda x: x.startswith("{"))
    by_line = (F.size(lines) > 1) & (brace(F.get(lines, F.lit(0)), "}") | (one["_bad"].isNotNull() & listed))
    texts = F.when(by_line, lines).otherwise(F.array("value"))
    rows = whole.select(F.col("_metadata.file_path").alias("path"), F.explode(texts).alias("text")).where(F.trim("text") != "")
    return rows.withColumn("run", parsed(F.col("text")))


_GOOD = "run is not null and run._bad is null and run.exp_id is not null and run.cfg is not null"


def read_runs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The nested run records, pretty-printed or one per line."""
    return _parsed_runs(spark, path).where(_GOOD).select("run.*").drop("_bad")


def rejected_runs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, text) of what does not parse or has no id or configuration."""
    return _parsed_runs(spark, path).where(f"not coalesce({_GOOD}, false)").select("path", "text")


def flatten_runs(runs: DataFrame) -> DataFrame:
    """One row per run with the best tau of its sweep (the first on ties; NULL if none has a value)."""
    # a tau without a value is no candidate
    entries = F.array_sort(
        F.transform(F.filter(F.map_entries("tau_sweep"), lambda e: e["value"]["balanced_acc"].isNotNull()), lambda e: F.struct((-e["value"]["balanced_acc"]).alias("neg"), e["key"].cast("double").alias("tau")))
    )
    best = F.get(entries, F.lit(0))
    cfg = [F.col(f"cfg.{c}").alias(c) for c in ("model", "img_size", "mode", "channel_mode", "aug", "loss", "sampler", "mixup", "cutmix")]
    return runs.select(
        "exp_id", *cfg,
        F.when(F.coalesce("cfg.extra_train_index", F.lit("")) != "", F.col("cfg.extra_mode")).otherwise("-").alias("extra"),
        F.col("cfg.split_kind").alias("split_kind"), F.col("cfg.subset_frac").alias("subset_frac"), F.col("epochs_done").alias("epochs"),
        F.col("cfg.seed").alias("seed"), *METRIC_FIELDS,
        best["tau"].alias("tau_best"), (-best["neg"]).alias("tau_best_bal"),
        F.col("tta.top1").alias("tta_top1"), F.col("tta.balanced_acc").alias("tta_bal"), "best_epoch", "best_which",
        F.round(F.col("params_total") / 1e6, 2).alias("params_M"), F.round("sec_per_epoch", 1).alias("sec_per_epoch"),
        F.round("latency_ms_bs1", 2).alias("latency_ms"), "device",
    )


def _number(col: Column) -> Column:
    return col.try_cast("double")


def epoch_logs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Per-run epoch tables as one: numbers coerced (bad ones NULL), averaged-model columns optional,
    ``exp_id`` from the folder of the file."""
    raw = _csv_by_name(spark, path, EPOCH_FIELDS)
    # file names are given as URLs
    exp = F.url_decode(F.replace(F.element_at(F.split("_file", "/"), -2), F.lit("+"), F.lit("%2B")))
    # a folder written as exp_id=<name> or just <name>
    numbers = [_number(F.col(c)).alias(c) for c in EPOCH_FIELDS if c != "epoch"]
    return raw.select(F.regexp_replace(exp, "^exp_id=", "").alias("exp_id"), F.col("epoch").try_cast("int").alias("epoch"), *numbers)


def csv_headers(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Column names to the files that have them: the first line of each file, found where its first block begins.

    One pass of Spark's text reader; what comes to the driver is a line per file, as its list of files does.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    seen = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("id"))
    heads = seen.where("start = 0").groupBy("file").agg(F.min_by("value", "id").alias("head"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in heads.collect():
        names = next(csv.reader([r["head"].removeprefix("\ufeff")]), [])
        groups.setdefault(tuple(x.strip() for x in names), []).append(r["file"])
    return groups


def _csv_by_name(spark: SparkSession, path: str | Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Columns of CSV files by the name in each file's own header, as text, with ``_file``; missing ones are NULL.

    Files may differ in columns and their order: those with the same header are read together by Spark's
    reader, which splits large files, and the groups are joined by name. Of columns with the same name
    the last counts; a cell does not span lines.
    """
    out = None
    for names, paths in sorted(csv_headers(spark, path).items()):
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(max(len(names), 1))])
        reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("recursiveFileLookup", "true")
        place = {name: i for i, name in enumerate(names)}
        cells = [F.nullif(F.col(f"_c{place[c]}"), F.lit("")).alias(c) for c in fields if c in place]
        own = reader.csv([unquote(p) for p in paths]).select(*cells, F.col("_metadata.file_path").alias("_file"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("_file", T.StringType())]))
    missing = {c: F.lit(None).cast("string") for c in fields if c not in out.columns}
    return out.withColumns(missing).select(*fields, "_file")


def load_experiments(spark: SparkSession, path: str | Sequence[str], defaults: Mapping[str, object] = EXPERIMENT_DEFAULTS) -> DataFrame:
    """Experiment table of one or more files: columns by name, missing values get their default, numbers
    are coerced (bad ones are NULL), the split kind follows the id suffix (_doc, _T4) where there is one."""
    raw = _csv_by_name(spark, path, list(defaults))
    cols = []
    for name, default in defaults.items():
        kind = "string" if name in TEXT_FIELDS else "double"
        value = F.col(name) if kind == "string" else _number(F.col(name))
        cols.append(F.when(F.col(name).isNull(), F.lit(default).cast(kind)).otherwise(value).alias(name))
    return with_split_kind(raw.select(*cols))


def with_split_kind(exp: DataFrame) -> DataFrame:
    kind = F.when(F.col("exp_id").endswith("_doc"), "doc").when(F.col("exp_id").endswith("_T4"), "strat")
    return exp.withColumn("split_kind", kind.otherwise(F.coalesce("split_kind", F.lit("strat"))))


def run_schema() -> T.StructType:
    """RUN_SCHEMA as a type."""
    return T.StructType.fromDDL(RUN_SCHEMA)
