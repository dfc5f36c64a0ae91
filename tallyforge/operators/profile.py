"""Corpus profiling: duplicates, class tables, coverage, distributions, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, attach_row, settle
from tallyforge.functions.quantiles import exact_medians, medians_of
from tallyforge.functions.skew import join_keyed


def dup_groups(m: DataFrame) -> DataFrame:
    """Groups of identical content: size, first key, classes (at most the universe), conflict flag.

    Members are in ``dup_members``, one row each: a group may be too big for one array.
    """
    per = m.where("md5 is not null").groupBy("md5").agg(
        F.count("*").alias("n"),
        F.min("key").alias("first_key"),
        F.sort_array(F.collect_set("class")).alias("classes"),
    )
    return per.where("n > 1").withColumn("cross_class", F.size("classes") > 1)


def dup_members(m: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Every row that belongs to a duplicate group, with the size of its group."""
    groups = m.where("md5 is not null").groupBy("md5").agg(F.count("*").alias("n")).where("n > 1")
    rows = m.where("md5 is not null").select("key", "class", "md5")
    return join_keyed(rows, groups, ["md5"], spread="key", sizes=groups, hot_rows=hot_rows)


def dup_summary(m: DataFrame) -> DataFrame:
    """One row: duplicate groups, redundant rows, conflicting groups, distinct contents, copies."""
    per = m.groupBy("md5").agg(
        F.count("*").alias("n"),
        (F.min("class") != F.max("class")).alias("cross"),
        F.count_if("is_copy").alias("copies"),
    )
    real = F.col("md5").isNotNull()
    dup = real & (F.col("n") > 1)
    return per.agg(
        F.count_if(dup).alias("n_groups"),
        F.coalesce(F.sum(F.when(dup, F.col("n") - 1)), F.lit(0)).alias("n_redundant"),
        F.count_if(dup & F.col("cross")).alias("n_cross_class"),
        F.count_if(real).alias("n_unique"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_copies"),
    )


def class_stats(m: DataFrame, classes: Classes, w: str, h: str, ink: str) -> DataFrame:
    """Per class: sizes, distinct hashes and groups, size medians and ranges, share; zeros if empty."""
    per = m.groupBy("class").agg(
        F.count("*").alias("n"),
        F.count_if("ok").alias("n_ok"),
        F.count_distinct("md5").alias("n_unique_md5"),
        F.count_distinct("group").alias("n_groups"),
        F.min(w).alias("min_w"),
        F.max(w).alias("max_w"),
        F.min(h).alias("min_h"),
        F.max(h).alias("max_h"),
        F.round(F.avg(ink), 6).alias("mean_ink"),
    )
    per = per.join(exact_medians(m, ["class"], {"w": F.col(w), "h": F.col(h)}), "class", "left")
    full = classes.side.join(per, "class", "left")
    full = full.fillna(0, [c for c in per.columns if c != "class"])
    n_train = F.bround(F.lit(0.8) * F.col("n")).cast("bigint")
    return full.select(
        *per.columns,
        F.when(F.col("med_h") > 0, F.round(F.col("med_w") / F.col("med_h"), 4)).otherwise(0.0).alias("med_aspect"),
        F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share_pct"),
        n_train.alias("n_train_80"),
        (F.col("n") - n_train).alias("n_val_20"),
    )


def gini(sizes: DataFrame, col: str = "n") -> DataFrame:
    """Gini coefficient of a class-sized table; 0 for empty or all-zero input."""
    ranked = sizes.select(F.col(col).cast("double").alias("x")).withColumn(
        "i", F.row_number().over(Window.orderBy("x"))
    )
    n, total = F.count("*"), F.sum("x")
    value = F.try_divide(2 * F.sum(F.col("i") * F.col("x")), n * total) - F.try_divide(n + 1, n)
    return ranked.agg(F.coalesce(F.when(total > 0, value), F.lit(0.0)).alias("gini"))


def corpus_summary(
    m: DataFrame, classes: Classes, w: str, h: str, thresholds: tuple[int, ...] = (50, 10, 5), top: int = 10,
    prefix: Column | None = None, category: Column | None = None, doc: Column | None = None, grey: Column | None = None,
) -> DataFrame:
    """One row: totals, imbalance, Gini, share of the biggest classes, small classes, medians; rows per class and,
    where given, per prefix and category as maps (NULL values apart, as n_no_prefix and n_no_category), distinct
    documents and the mean share of mid-grey.

    All of it comes from one scan: every row counts into one cell of each grouping set, with map-side combine. Cells
    of documents, groups and sizes may be as many as rows; they are merged, never gathered. Per-prefix and
    per-category cells fold into one row, so these are for columns with a bounded number of values.
    """
    text = lambda name, c: F.struct(F.lit(name).alias("column"), c.cast("string").alias("key"), F.lit(None).cast("double").alias("value"))
    size = lambda name, c: F.struct(F.lit(name).alias("column"), F.lit(None).cast("string").alias("key"), c.cast("double").alias("value"))
    asked = {"prefix": prefix, "category": category, "doc": doc}
    sets = [text("all", F.lit("")), text("class", F.col("class")), text("group", F.col("group")), size("w", F.col(w)), size("h", F.col(h))]
    sets += [text(name, c) for name, c in asked.items() if c is not None]
    own = grey.cast("double") if grey is not None else F.lit(None).cast("double")
    cells = m.select("ok", own.alias("_grey"), F.inline(F.array(*sets))).groupBy("column", "key", "value")
    measure = F.when(F.col("column") == "all", F.col("_grey"))
    cells = settle(cells.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.sum(measure).alias("grey"), F.count(measure).alias("n_grey")), "summary-cells")

    named = cells.where("column = 'class'").select(F.col("key").alias("class"), "n")
    sizes = classes.side.join(named, "class", "left").fillna(0, ["n"])
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "class")))
    folded = lambda name: F.map_from_entries(F.sort_array(F.collect_list(name)))
    from_classes = ranked.agg(
        F.count("*").alias("n_classes"),
        F.when(F.min("n") > 0, F.round(F.try_divide(F.max("n"), F.min("n")), 2)).alias("imbalance"),
        F.round(F.try_divide(100.0 * F.sum(F.when(F.col("_r") <= top, F.col("n"))), F.sum("n")), 2).alias("top_share_pct"),
        *[F.count_if(F.col("n") < t).alias(f"n_classes_lt_{t}") for t in thresholds],
        folded(F.struct("class", "n")).alias("per_class"),
    )
    of = lambda name: F.col("column") == name
    distinct = lambda name: F.count_if(of(name) & F.col("key").isNotNull())
    entry = lambda name: F.when(of(name) & F.col("key").isNotNull(), F.struct("key", "n"))
    zero = F.lit(0).cast("bigint")
    facts = [
        F.coalesce(F.max(F.when(of("all"), F.col("n"))), zero).alias("n_total"),
        F.coalesce(F.max(F.when(of("all"), F.col("n_ok"))), zero).alias("n_ok"),
        distinct("group").alias("n_groups"),
    ]
    for name in ("prefix", "category"):
        if asked[name] is not None:
            facts.append(folded(entry(name)).alias(f"per_{name}"))
            facts.append(F.coalesce(F.sum(F.when(of(name) & F.col("key").isNull(), F.col("n"))), zero).alias(f"n_no_{name}"))
    if doc is not None:
        facts.append(distinct("doc").alias("n_docs"))
    if grey is not None:
        facts.append(F.round(F.try_divide(F.sum("grey"), F.sum("n_grey")), 4).alias("mid_grey"))
    medians = medians_of(cells.where("column in ('w', 'h')").select("column", "value", "n"), [], ["w", "h"])
    g = gini(sizes).select(F.round("gini", 4).alias("gini"))
    return attach_row(attach_row(attach_row(cells.agg(*facts), medians), from_classes), g)


def grouped_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts by each column on its own, in one pass: (dimension, value, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def coverage_matrix(
    df: DataFrame, entity: str, cls: str, ok: Column, classes: Classes, max_missing: int = 6
) -> DataFrame:
    """Per entity: classes it covers, classes present but bad, classes missing, and a flag.

    An entity without any class of the universe covers none of them and misses all.
    """
    per_cell = df.groupBy(entity, cls).agg(F.max(ok.cast("int")).alias("ok"))
    listed = classes.side.select(F.col("class").alias(cls), F.lit(True).alias("_known"))
    known = per_cell.join(listed, cls, "left").withColumn("ok", F.when(F.col("_known"), F.coalesce("ok", F.lit(0))))
    total = classes.side.agg(F.count("*").alias("n_classes"))
    per = known.groupBy(F.col(entity).alias("entity")).agg(
        F.coalesce(F.sum("ok"), F.lit(0)).alias("n_ok"), F.count_if(F.col("ok") == 0).alias("n_blank")
    )
    per = attach_row(per, total)
    n_bad = F.col("n_classes") - F.col("n_ok")
    return per.select(
        "entity",
        "n_ok",
        "n_blank",
        (n_bad - F.col("n_blank")).alias("n_missing"),
        n_bad.alias("n_bad"),
        (n_bad > max_missing).alias("flagged"),
    )


def class_support(df: DataFrame, entity: str, cls: str, ok: Column, classes: Classes) -> DataFrame:
    """Per class: number of entities that cover it, least supported first."""
    good = df.where(ok).select(entity, F.col(cls).alias("class")).distinct()
    n = good.groupBy("class").agg(F.count("*").alias("n_entities"))
    return classes.side.select("class").join(n, "class", "left").fillna(0).orderBy("n_entities", "class")


def source_coverage(df: DataFrame, cls: str, src: str, classes: Classes, sources: list[str]) -> DataFrame:
    """Class x source counts with totals and a status; classes outside the universe are 'unmapped'."""
    table = df.groupBy(F.col(cls).alias("class")).agg(
        *[F.count_if(F.col(src) == s).alias(f"n_{s}") for s in sources], F.count("*").alias("total")
    )
    known = classes.side.select("class", F.lit(True).alias("_known"))
    full = known.join(table, "class", "full").fillna(0, [f"n_{s}" for s in sources] + ["total"])
    status = (
        F.when(F.col("_known").isNull(), "unmapped").when(F.col("total") == 0, "no_samples").otherwise("ok")
    )
    return full.withColumn("status", status).drop("_known")


def source_ranges(df: DataFrame, cls: str, src: str, classes: Classes) -> DataFrame:
    """Per source: min / median / mean / max rows over the classes it has."""
    n = df.join(classes.side.select(F.col("class").alias(cls)), cls, "left_semi").groupBy(src, cls).agg(F.count("*").alias("n"))
    return n.groupBy(F.col(src).alias("source")).agg(
        F.count("*").alias("n_classes"),
        F.min("n").alias("min_n"),
        F.percentile("n", F.lit(0.5)).alias("median_n"),
        F.round(F.avg("n"), 6).alias("mean_n"),
        F.max("n").alias("max_n"),
    )


def compare_distributions(real: DataFrame, other: DataFrame, cls: str, col: str, tol: float = 0.35) -> DataFrame:
    """Per class: medians and means of both sides, and whether the medians agree within ``tol``."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        per = df.groupBy(F.col(cls).alias("class")).agg(F.count("*").alias(f"n_{tag}"), F.round(F.avg(col), 4).alias(f"mean_{tag}"))
        medians = exact_medians(df.select(F.col(cls).alias("class"), F.col(col).alias("_v")), ["class"], {tag: F.col("_v")})
        return per.join(medians, "class", "left")

    both = side(real, "real").join(side(other, "other"), "class")
    ratio = F.col("med_other") / F.col("med_real")
    return both.select("*", F.round(ratio, 6).alias("ratio"), (F.abs(ratio - 1) <= tol).alias("within"))


def leakage_report(train: DataFrame, val: DataFrame, kind: str, grp: list[str]) -> DataFrame:
    """Per kind: share of val rows whose group also has train rows. One aggregation, no join."""
    cols = list(dict.fromkeys([kind, *grp]))
    both = train.select(*cols, F.lit("train").alias("_side")).unionByName(val.select(*cols, F.lit("val").alias("_side")))
    return leakage_by_side(both, "_side", kind, grp)


def leakage_by_side(df: DataFrame, side: str, kind: str, grp: list[str]) -> DataFrame:
    """``leakage_report`` of one table whose column ``side`` says train or val: the split is worked out once."""
    cols = list(dict.fromkeys([kind, *grp]))
    is_ = lambda s: F.col(side) == s
    per = df.where(is_("train") | is_("val")).groupBy(*cols).agg(F.max(F.when(is_("train"), 1).otherwise(0)).alias("t"), F.count_if(is_("val")).alias("v"))
    leaked = F.sum(F.col("t") * F.col("v"))
    return per.groupBy(F.col(kind).alias("kind")).agg(
        F.sum("v").alias("n_val"),
        leaked.alias("n_leaked"),
        F.round(F.try_divide(leaked, F.sum("v")), 6).alias("leak_share"),
    )


def audit_overlap(a: DataFrame, b: DataFrame, on: str, cls: str) -> DataFrame:
    """How much of b is in a by ``on``: shared, new, relabelled (a row of b whose class no row of a with
    that content has); and what a lost. Rows without content are counted apart, as null_a and null_b.
    """
    one, none = F.lit(1), F.lit(0)
    sides = a.select(on, F.col(cls).alias("c"), one.alias("na"), none.alias("nb")).unionByName(b.select(on, F.col(cls).alias("c"), none.alias("na"), one.alias("nb")))
    cells = sides.groupBy(on, "c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    other = F.sum(F.when(F.col("na") == 0, F.col("nb")).otherwise(none)).alias("other")
    per = cells.groupBy(on).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), other)
    known = F.col(on).isNotNull()
    total = lambda cond, n: F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0).cast("bigint"))
    return per.agg(
        total(F.lit(True), "na").alias("n_a"),
        total(F.lit(True), "nb").alias("n_b"),
        total(known & (F.col("na") > 0), "nb").alias("n_shared"),
        total(known & (F.col("na") == 0), "nb").alias("n_new"),
        total(known & (F.col("na") > 0), "other").alias("n_moved"),
        total(known & (F.col("nb") == 0), "na").alias("n_dropped"),
        total(~known, "na").alias("null_a"),
        total(~known, "nb").alias("null_b"),
    )


def per_class_delta(a: DataFrame, b: DataFrame, cls: str) -> DataFrame:
    """Class sizes before and after, changed classes only."""
    sides = a.select(cls, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(cls, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    per = sides.groupBy(F.col(cls).alias("class")).agg(F.sum("a").alias("before"), F.sum("b").alias("after"))
    return per.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0")


def seed_stats(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population standard deviation of each metric over the runs of a group."""
    aggs = [F.count("*").alias("n_runs")]
    for m in metrics:
        aggs += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_pop(m), 6).alias(f"{m}_std")]
    return runs.groupBy(*by).agg(*aggs)
