"""Label-free look at an incoming batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, attach_row, settle
from tallyforge.functions.quantiles import medians_of, value_cells
from tallyforge.operators.raster import _ring, normalise_rasters, sharpness


def resolve_labels(df: DataFrame, label: str, classes: Classes) -> DataFrame:
    """One row: items with and without a label, classes present and absent, rows per class."""
    per = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    # class-sized from here on
    known = classes.side.select("class", F.lit(1).alias("known")).join(per, "class", "full")
    has = F.col("class").isNotNull() & F.col("n").isNotNull()
    n = F.coalesce("n", F.lit(0))
    return known.agg(
        F.sum(n).alias("n_items"),
        F.sum(F.when(has, n).otherwise(0)).alias("n_resolved"),
        F.sum(F.when(F.col("class").isNull(), n).otherwise(0)).alias("n_unresolved"),
        F.count_if(has).alias("n_classes_present"),
        F.count_if((F.col("known") == 1) & F.col("n").isNull()).alias("n_classes_absent"),
        F.min(F.when(has, n)).alias("min_per_class"),
        F.percentile(F.when(has, n), F.lit(0.5)).alias("median_per_class"),
        F.max(F.when(has, n)).alias("max_per_class"),
    )


def describe_batch(df: DataFrame) -> DataFrame:
    """One row of medians: size, ink share of the cropped glyph, grey levels, sharpness; and the
    share of dark borders.

    One scan counts how often each value occurs; medians are read off these counts by ranges of values
    (``quantiles.medians_of``), so any number of images and of distinct values will do.
    """
    d = normalise_rasters(df.withColumn("_dark", _ring(F.col("pixels"), corners_twice=True) < 127.5), polarity="none")
    columns = {"height": F.col("h"), "width": F.col("w"), "ink_frac": F.round("ink_frac", 4), "levels": F.size(F.array_distinct("pixels")), "sharpness": sharpness()}
    cells = settle(value_cells(d, [], columns | {"all": F.lit(0), "dark": F.col("_dark").cast("int")}), "batch-values")
    of = lambda name, c: F.coalesce(F.sum(F.when(F.col("column") == name, c)), F.lit(0))
    known = of("dark", F.when(F.col("value").isNotNull(), F.col("n")))
    facts = cells.agg(of("all", F.col("n")).cast("bigint").alias("n_images"), F.try_divide(of("dark", F.col("n") * F.col("value")), known).alias("share_dark_border"))
    return attach_row(facts, medians_of(cells, [], list(columns), "median_{}"))


def view_probe(pred: DataFrame, keys: Sequence[str], by: Sequence[str], view: str, tau: float = 0.85, near: int = 15) -> DataFrame:
    """Does another view make the batch surer? Per ``by``: mean confidences, lift, share of unsure
    items, the most frequent winning view other than 0 and how many items agree with it.

    View 0 wins ties, then the lowest view.
    """
    best = F.max_by(F.struct(F.col(view).alias("v"), "p1"), F.struct(F.col("p1"), -F.col(view)))
    item = pred.groupBy(*by, *keys).agg(best.alias("_b"), F.max(F.when(F.col(view) == 0, F.col("p1"))).alias("up"))
    item = item.select(*by, F.col("_b.v").alias("v"), F.col("_b.p1").alias("best"), "up")
    # per winning view: a handful of rows
    per = item.groupBy(*by, "v").agg(
        F.count("*").alias("n"), F.sum("up").alias("up"), F.sum("best").alias("best"),
        F.count_if(F.col("up") < tau).alias("unsure"), F.count_if(F.col("up") >= F.col("best") - 0.05).alias("ok"),
    )
    tot = per.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("up").alias("s_up"), F.sum("best").alias("s_best"), F.sum("unsure").alias("unsure"), F.sum("ok").alias("ok"),
        F.max_by("v", F.when(F.col("v") != 0, F.struct(F.col("n"), -F.col("v")))).alias("modal"),
        F.collect_list(F.struct("v", "n")).alias("wins"),
    )
    agree = F.aggregate(
        F.filter("wins", lambda x: (x["v"] != 0) & (F.abs(x["v"] - F.col("modal")) <= near)), F.lit(0).cast("bigint"), lambda a, x: a + x["n"]
    )
    n = F.col("n")
    return tot.select(
        *by, "n",
        (F.col("s_up") / n).alias("mean_conf_upright"),
        (F.col("s_best") / n).alias("mean_conf_best"),
        ((F.col("s_best") - F.col("s_up")) / n).alias("lift"),
        (F.col("unsure") / n).alias("share_unsure"),
        F.coalesce("modal", F.lit(0)).alias("modal_view"),
        F.when(F.col("modal").isNull(), 0.0).otherwise(agree / n).alias("modal_share"),
        (F.col("ok") / n).alias("share_upright_ok"),
    )


# Ink share of the training corpus and its tolerance.
REF_INK = 0.44
INK_TOLERANCE = 0.12


def verdict(description: DataFrame, probe: DataFrame) -> DataFrame:
    """The ordered findings on a batch as (step, finding) per probe row; both inputs are tiny."""
    d = attach_row(probe, description)
    lift, share = F.col("lift"), F.col("modal_share")
    height, ink = F.col("median_height"), F.col("median_ink_frac")
    rules = F.array_compact(
        F.array(
            F.when((share >= 0.60) & (lift >= 0.08), "rotated").when(lift >= 0.08, "degraded").otherwise("upright"),
            F.when(height < 12, "very_low_resolution").when(height < 18, "low_resolution").when(height > 120, "high_resolution"),
            F.when(F.col("share_dark_border") > 0.3, "dark_border"),
            F.when(F.col("median_levels") > 32, "greyscale"),
            F.when(ink < REF_INK - INK_TOLERANCE, "thin_strokes").when(ink > REF_INK + INK_TOLERANCE, "thick_strokes"),
            F.when(F.col("share_unsure") > 0.5, "unconfident"),
        )
    )
    keep = [c for c in probe.columns if c in ("model", "batch")]
    return d.select(*keep, F.posexplode(rules).alias("step", "finding"))
