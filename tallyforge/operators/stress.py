"""Perturbation sweeps and the robustness tables built on them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.hashing import hash_hex, uniform
from tallyforge.operators.metrics import metrics_of

# name -> (word, u, severity) -> perturbed word; u is the word's hash as a number in [0, 1) and
# NULL drops the word
PERTURBATIONS: dict[str, Callable[[Column, Column, float], Column]] = {
    "clean": lambda w, u, s: w,
    "clip": lambda w, u, s: F.substring(w, 1, int(s)),
    "drop": lambda w, u, s: F.when(u >= s, w),
    "strip": lambda w, u, s: F.nullif(F.substring(w, F.lit(1), F.greatest(F.length(w) - int(s), F.lit(0))), F.lit("")),
    "mirror": lambda w, u, s: F.reverse(w),
}
# the same in Python: ``variants`` gives the forms of one word, for scoring by distinct words
FORMS: dict[str, Callable[[str, float, float], str | None]] = {
    "clean": lambda w, u, s: w,
    "clip": lambda w, u, s: w[: int(s)],
    "drop": lambda w, u, s: w if u >= s else None,
    "strip": lambda w, u, s: w[: max(len(w) - int(s), 0)] or None,
    "mirror": lambda w, u, s: w[::-1],
}
# condition -> severities, mildest first
GRID: dict[str, tuple[float, ...]] = {
    "clean": (0.0,),
    "clip": (6.0, 4.0, 3.0),
    "drop": (0.25, 0.5, 0.75),
    "strip": (1.0, 2.0, 3.0),
    "mirror": (1.0,),
}


def perturbed(words: DataFrame, grid: Mapping[str, Sequence[float]] = GRID, registry: Mapping = PERTURBATIONS) -> DataFrame:
    """Every item under every (condition, severity), its ``words`` perturbed in place: one row per item and cell."""
    hashed = F.transform("words", lambda w: F.struct(w.alias("w"), uniform(hash_hex("drop", w)).alias("u")))
    d = words.withColumn("_hashed", hashed)
    changed = lambda c, s: F.transform("_hashed", lambda x: registry[c](x["w"], x["u"], s))
    cells = [F.struct(F.lit(c).alias("condition"), F.lit(float(s)).alias("severity"), changed(c, s).alias("_words")) for c, sevs in grid.items() for s in sevs]
    return d.select("*", F.inline(F.array(*cells))).withColumn("words", F.col("_words")).drop("_words", "_hashed")


def variants(grid: Mapping[str, Sequence[float]] = GRID) -> Callable[[str], list[str | None]]:
    """word -> its forms in the cells of the grid, in order; None where it is dropped."""
    cells = [(FORMS[c], float(s)) for c, sevs in grid.items() for s in sevs]

    def run(word: str) -> list[str | None]:
        u = int(md5(f"drop:{word}".encode()).hexdigest()[:8], 16) / 4294967296.0
        return [form(word, u, s) for form, s in cells]

    return run


def with_cell(df: DataFrame, grid: Mapping[str, Sequence[float]] = GRID) -> DataFrame:
    """``cell``, the number of a cell of the grid, replaced by its condition and severity."""
    cells = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(float(s)).alias("severity")) for c, sevs in grid.items() for s in sevs])
    return df.withColumn("_at", F.get(cells, F.col("cell"))).select("*", "_at.condition", "_at.severity").drop("_at", "cell")


def sweep_table(pred: DataFrame, by: Sequence[str] = ("model", "condition", "severity")) -> DataFrame:
    """Per model and grid cell: n, rejected items (nothing readable left), top-1, balanced, macro-F1."""
    by = list(by)
    kept = pred.where("known > 0") if "known" in pred.columns else pred
    m = metrics_of(kept, by).select(*by, "n", "top1", "balanced_acc", "macro_f1")
    if "known" not in pred.columns:
        return m
    lost = pred.groupBy(*by).agg(F.count_if(F.col("known") == 0).alias("n_rejected"))
    return lost.join(m, by, "left").fillna(0, ["n"])


def harshness(condition: Column, severity: Column) -> Column:
    """Sort key (a, b) with harsher later, although some severities count downwards."""
    zero = F.lit(0.0)
    return (
        # less kept is harsher
        F.when(condition.isin("jpeg", "pixelate", "clip"), F.struct(zero.alias("a"), (-severity).alias("b")))
        # further from 1 is harsher
        .when(condition == "aspect_stretch", F.struct(zero.alias("a"), F.abs(severity - 1).alias("b")))
        # erosion (below 0) is harsher than any dilation
        .when(condition == "stroke_extreme", F.struct(F.when(severity > 0, 0.0).otherwise(1.0).alias("a"), F.abs(severity).alias("b")))
        .otherwise(F.struct(zero.alias("a"), severity.alias("b")))
    )


def retention(sweep: DataFrame, metric: str = "top1", clean: str = "clean") -> DataFrame:
    """Adds the metric of the model's clean row and the part of it that is retained."""
    base = sweep.where(F.col("condition") == clean).select("model", F.col(metric).alias("clean_value"))
    return sweep.join(base, "model").withColumn("retention", F.try_divide(metric, "clean_value"))


def crossing_points(ret: DataFrame, levels: Sequence[float] = (0.9, 0.5)) -> DataFrame:
    """First severity, in order of harshness, at which retention falls below each level; NULL = never."""
    key = harshness(F.col("condition"), F.col("severity"))
    return ret.where("condition <> 'clean'").groupBy("model", "condition").agg(
        *[F.min_by(F.when(F.col("retention") < v, F.col("severity")), F.when(F.col("retention") < v, key)).alias(f"below_{round(v * 100)}") for v in levels]
    )


def worst_severity(sweep: DataFrame) -> DataFrame:
    """Per model and condition the row with the lowest balanced accuracy, its drops against clean,
    the grid mean of the model and the rank of the condition by damage."""
    clean = sweep.where("condition = 'clean'").select("model", F.col("top1").alias("c_top1"), F.col("balanced_acc").alias("c_bal"))
    rest = sweep.where("condition <> 'clean'")
    mean = rest.groupBy("model").agg(F.avg("top1").alias("mean_top1"), F.avg("balanced_acc").alias("mean_balanced"))
    order = Window.partitionBy("model", "condition").orderBy("balanced_acc", harshness(F.col("condition"), F.col("severity")))
    worst = rest.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    d = worst.join(clean, "model").join(mean, "model")
    rank = F.row_number().over(Window.partitionBy("model").orderBy("balanced_acc", "condition"))
    return d.select(
        "model", "condition", F.col("severity").alias("worst_severity"), "top1", "balanced_acc", "macro_f1",
        (F.col("c_top1") - F.col("top1")).alias("drop_top1"), (F.col("c_bal") - F.col("balanced_acc")).alias("drop_balanced"),
        "mean_top1", "mean_balanced", rank.alias("damage_rank"),
    )


def identity_map(pred: DataFrame, transform: str = "condition") -> DataFrame:
    """Per model, transform and true class: where most items go, how many of them, and how surely.

    Ties for the modal prediction go to the lowest label; the confidence is over the whole class.
    """
    cells = pred.groupBy("model", transform, "y", "pred").agg(F.count("*").alias("n"), F.sum("p1").alias("_c"))
    per = cells.groupBy("model", transform, "y").agg(
        F.max_by("pred", F.struct(F.col("n"), -F.col("pred"))).alias("maps_to"),
        F.max("n").alias("n_modal"), F.sum("n").alias("n"), F.sum("_c").alias("_c"),
    )
    return per.select(
        "model", transform, "y", "maps_to", (F.col("maps_to") == F.col("y")).alias("maps_to_self"), "n",
        (F.col("n_modal") / F.col("n")).alias("rate"), (F.col("_c") / F.col("n")).alias("mean_conf"),
    )


def silent_failures(m: DataFrame, transform: str = "condition", rate: float = 0.6, conf: float = 0.8) -> DataFrame:
    """Confident wrong mappings and the number of models that agree on each."""
    d = m.where(~F.col("maps_to_self") & (F.col("rate") >= rate) & (F.col("mean_conf") >= conf))
    return d.groupBy(transform, "y", "maps_to").agg(F.count("*").alias("n_models"))


def dangerous_counts(m: DataFrame, models: Sequence[str], transform: str = "condition", rate: float = 0.5, conf: float = 0.7) -> DataFrame:
    """Per transform: number of dangerous classes of each model, one column per model."""
    bad = ~F.col("maps_to_self") & (F.col("rate") >= rate) & (F.col("mean_conf") >= conf)
    return m.groupBy(transform).pivot("model", list(models)).agg(F.count_if(bad))


def best_under(ret: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Mean retention of each model over a set of conditions, best first."""
    d = ret.where(F.col("condition").isin(*conditions)).groupBy("model").agg(F.avg("retention").alias("mean_retention"))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_retention"), "model")))


def sweep_cross(items: DataFrame, grid: Mapping[str, Sequence[float]] = GRID) -> DataFrame:
    """Every item under every (condition, severity) of a listed grid."""
    cells = [F.struct(F.lit(c).alias("condition"), F.lit(float(s)).alias("severity")) for c, sevs in grid.items() for s in sevs]
    return items.select("*", F.inline(F.array(*cells)))
